"""A corpus pipeline of five stages over ``documents``: quality, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder
and reads it back as the next one's docs. All stages but the last return the columns of ``documents``. Models are fitted on
the stage's own docs, with the labels of the training folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelworks.llm import decontaminate, language, ngram_join, packing, quality
from labelworks.llm.common import stored
from labelworks.llm.tokens import vocabulary_path

#: A document goes if its quality score is lower.
LEAST_QUALITY = 0.3
#: A document goes if the cosine with its language's prototype, moved to 0..1, is lower.
LEAST_LANGUAGE = 0.51


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id, text and lang under names that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text", "lang") else f"column_{i}" for i, c in enumerate(docs.columns)])


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were, without those that an operator has added."""
    return found.select(*aside(docs).columns).toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; nulls and empty texts are scored like others.

    Repeated rows stay as often as they are kept, and without labels all score 0.5 and stay.
    """
    hidden = aside(docs)
    stats = stored(quality.with_statistics(hidden, hidden.columns), "pipeline-stats")
    model = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(stats.where(quality.score_column(model)("stats") >= LEAST_QUALITY), docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID takes to be in one of the learned languages; null, empty and letterless texts go."""
    hidden = aside(docs)
    found = language.identify(hidden, language.fit(hidden))
    return restored(found.where(f"lang_pred <> 'und' and score >= {LEAST_LANGUAGE}"), docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents those with the smallest id; texts without words and rows without an id stay."""
    return restored(ngram_join.first_of_groups(aside(docs)), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; texts without words stay."""
    return restored(decontaminate.find_contamination(aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places; a null or empty text is one piece with the end id."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
