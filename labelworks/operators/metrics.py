"""Evaluation, calibration and cost (A1 to A18).

Metrics run over a long table (attribute, pred, truth, conf, error): one pass for all attributes. A row counts as valid when
it has no error, a prediction and a truth other than null and "nan".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_substring_length, normalize, similar_text, tokens
from ..sources.scratch import stored
from .scan import prefix_sums
from .vectors import small

ATTRIBUTE = "attribute"


def long_table(df: DataFrame, attributes: dict[str, tuple[str, str, str]], error: str = "error", keys: list[str] = ()) -> DataFrame:
    """attributes: name -> (prediction, truth, confidence) columns."""
    parts = [F.struct(F.lit(a).alias(ATTRIBUTE), F.col(p).cast("string").alias("pred"), F.col(t).cast("string").alias("truth"), F.col(c).cast("double").alias("conf")) for a, (p, t, c) in attributes.items()]
    return df.select(*keys, F.col(error).alias("error"), F.explode(F.array(*parts)).alias("x")).select(*keys, "error", "x.*")


def valid() -> Column:
    return F.col("error").isNull() & F.col("pred").isNotNull() & F.col("truth").isNotNull() & (F.col("truth") != "nan")


def scalar_metrics(long: DataFrame) -> DataFrame:
    """attribute, support, completion_rate and accuracy."""
    hit = F.when(valid(), (F.col("pred") == F.col("truth")).cast("double"))
    return long.groupBy(ATTRIBUTE).agg(
        F.count_if(F.col("error").isNull() & F.col("pred").isNotNull()).alias("support"), F.avg(F.col("error").isNull().cast("double")).alias("completion_rate"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy")
    )


def metric_rows(long: DataFrame, names: list[str] = ("support", "completion_rate", "accuracy")) -> DataFrame:
    """attribute, metric, value; and the plain mean over attributes as attribute ``Macro``."""
    wide = scalar_metrics(long)
    rows = wide.select(ATTRIBUTE, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(ATTRIBUTE, "m.*")
    return rows.unionByName(rows.groupBy("metric").agg(F.avg("value").alias("value")).select(F.lit("Macro").alias(ATTRIBUTE), "metric", "value"))


def matched(long: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Valid rows with ``match``: nearly equal texts, or exactly equal ones without ``fuzzy``; no confidence is 0."""
    match = similar_text(F.col("pred"), F.col("truth")) if fuzzy else (F.col("pred") == F.col("truth")) & (F.col("pred") != "")
    return long.where(valid()).withColumn("match", match).withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def threshold_table(long: DataFrame, fuzzy: bool = True, digits: int | None = None, parts: int | None = None) -> DataFrame:
    """For each attribute and distinct confidence: positives and negatives at and above it, the rates, and the share of rows
    strictly above it (completion).

    Counts of distinct confidences are dealt to ranges of them, and each range adds what the ranges above it hold: no task sees
    all confidences of an attribute. ``digits`` rounds them.
    """
    conf = F.col("conf") if digits is None else F.round("conf", digits)
    counts = matched(long, fuzzy).groupBy(ATTRIBUTE, conf.alias("threshold")).agg(F.count_if("match").alias("pos"), F.count_if(~F.col("match")).alias("neg"))
    x = prefix_sums(stored(counts, "thresholds"), [ATTRIBUTE], [-F.col("threshold")], {"tp": "pos", "fp": "neg"}, parts)
    x = x.withColumnsRenamed({"all_tp": "p", "all_fp": "n"})
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return x.select(ATTRIBUTE, "threshold", rate("tp", "p").alias("tpr"), rate("fp", "n").alias("fpr"), ((F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")) / (F.col("p") + F.col("n"))).alias("completion"), "pos", "neg", "tp", "fp", "p", "n")


def auroc(long: DataFrame, fuzzy: bool = True, digits: int | None = None) -> DataFrame:
    """attribute and the area under the curve, ties half; one class only: 1 if all match, else 0."""
    t = threshold_table(long, fuzzy, digits)
    won = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") * 0.5))
    return t.groupBy(ATTRIBUTE).agg(won.alias("w"), F.first("p").alias("p"), F.first("n").alias("n")).select(ATTRIBUTE, F.when(F.col("n") == 0, 1.0).when(F.col("p") == 0, 0.0).otherwise(F.col("w") / (F.col("p") * F.col("n"))).alias("auroc"))


def confidence_histogram(long: DataFrame, bins: int = 98, low: float = -3.0, high: float = 1.0, fuzzy: bool = True) -> DataFrame:
    """Rows by match and bin of the confidence's z-score; bins from 1, the last one closed, values outside left out."""
    m = matched(long, fuzzy)
    stats = m.agg(F.avg("conf").alias("mean"), F.stddev_pop("conf").alias("std"))
    z = F.when(F.col("std") > 0, F.round((F.col("conf") - F.col("mean")) / F.col("std"), 9)).otherwise(0.0)
    b = F.when(F.col("z") == high, bins).otherwise(F.floor((F.col("z") - low) / (high - low) * bins) + 1)
    return m.join(F.broadcast(stats)).withColumn("z", z).where(F.col("z").between(low, high)).groupBy("match", b.cast("long").alias("bin")).agg(F.count("*").alias("rows"))


def token_f1(df: DataFrame, pred: Column, truth: Column, ok: Column, name: str = "text_partial_match") -> DataFrame:
    """Adds the row's token F1: distinct shared tokens over both token lists' lengths; null where the row isn't valid."""
    a, b = tokens(normalize(pred)), tokens(normalize(truth))
    both = F.size(F.array_intersect(a, b))
    f1 = F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)
    return df.withColumn(name, F.when(ok, f1))


def multilabel_f1(df: DataFrame, pred: str, truth: str, labels: list[str], separator: str = ";") -> DataFrame:
    """micro, macro and weighted F1 over the configured labels; unknown labels don't count, repeated ones count once."""
    both = df.select(F.array_distinct(F.split(pred, separator)).alias("p"), F.array_distinct(F.split(truth, separator)).alias("t"))
    both = both.select(F.coalesce("p", F.array()).alias("p"), F.coalesce("t", F.array()).alias("t"))
    marked = both.select(F.explode(F.array_union("p", "t")).alias("label"), "p", "t").select("label", F.array_contains("p", F.col("label")).alias("in_p"), F.array_contains("t", F.col("label")).alias("in_t"))
    counts = marked.where(F.col("label").isin(labels)).groupBy("label").agg(F.count_if(F.col("in_p") & F.col("in_t")).alias("tp"), F.count_if("in_p").alias("pp"), F.count_if("in_t").alias("pt"))
    known = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    c = F.broadcast(known).join(counts, "label", "left").fillna(0)
    f1 = F.when(F.col("pp") + F.col("pt") > 0, 2.0 * F.col("tp") / (F.col("pp") + F.col("pt"))).otherwise(0.0)
    s = c.withColumn("f1", f1).agg(F.sum("tp").alias("tp"), (F.sum("pp") + F.sum("pt")).alias("d"), F.avg("f1").alias("macro"), F.sum(F.col("f1") * F.col("pt")).alias("w"), F.sum("pt").alias("s"))
    return s.select(F.when(F.col("d") > 0, 2.0 * F.col("tp") / F.col("d")).otherwise(0.0).alias("micro"), "macro", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(0.0).alias("weighted"))


def classification_report(long: DataFrame, most_labels: int = 10) -> DataFrame:
    """attribute, label, precision, recall, f1, support, with the rows ``accuracy``, ``macro avg`` and ``weighted avg``; attributes
    with more than ``most_labels`` labels are left out."""
    pairs = long.where(valid()).groupBy(ATTRIBUTE, "truth", "pred").agg(F.count("*").alias("n"))
    sides = pairs.select(ATTRIBUTE, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("pp"), F.col("n").alias("pt")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pp"), F.lit(0).cast("long").alias("pt")))).alias("x")).select(ATTRIBUTE, "x.*")
    c = sides.groupBy(ATTRIBUTE, "label").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("pt").alias("pt"))
    few = c.groupBy(ATTRIBUTE).agg(F.count("*").alias("k")).where(F.col("k") <= most_labels).select(ATTRIBUTE)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = c.join(few, ATTRIBUTE).select(ATTRIBUTE, "label", div(F.col("tp"), F.col("pp")).alias("precision"), div(F.col("tp"), F.col("pt")).alias("recall"), div(2.0 * F.col("tp"), F.col("pp") + F.col("pt")).alias("f1"), F.col("pt").alias("support"), "tp")
    total, w = F.sum("support"), lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    macro = rows.groupBy(ATTRIBUTE).agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    weighted = rows.groupBy(ATTRIBUTE).agg(F.lit("weighted avg").alias("label"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"), total.alias("support"))
    acc = F.sum("tp") / F.sum("support")
    accuracy = rows.groupBy(ATTRIBUTE).agg(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support"))
    return rows.drop("tp").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def running_metrics(long: DataFrame, row_id: str, step: int = 100, parts: int | None = None) -> DataFrame:
    """Accuracy and completion over the first 100, 200, ... rows: sums per bucket, accumulated over ranges of buckets."""
    hit = F.when(valid() & (F.col("pred") == F.col("truth")), 1).otherwise(0)
    sums = long.groupBy(ATTRIBUTE, F.floor(F.col(row_id) / step).alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(F.col("error").isNull()).alias("done"), F.count_if(valid()).alias("valid"), F.sum(hit).alias("hit"))
    names = ["rows", "done", "valid", "hit"]
    t = prefix_sums(stored(sums, "running").withColumnsRenamed({n: f"{n}_here" for n in names}), [ATTRIBUTE], [F.col("bucket")], {n: f"{n}_here" for n in names}, parts)
    return t.select(ATTRIBUTE, F.col("rows").alias("first_rows"), (F.col("done") / F.col("rows")).alias("completion_rate"), F.when(F.col("valid") > 0, F.col("hit") / F.col("valid")).otherwise(0.0).alias("accuracy"))


def entity_marks(text: Column, pred: Column, truth: Column) -> Column:
    """struct(tp, fp, fn) over a text's words: a word is marked by the first unused entity word that is in it or that it is in.
    Null texts have no words, null arrays no entities; null entities don't count."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    names = ["tp", "fp", "fn"]

    def without(left: Column, at: Column) -> Column:
        return F.when(at > 0, F.concat(F.slice(left, 1, at - 1), F.slice(left, at + 1, F.size(left)))).otherwise(left)

    def step(s: Column, w: Column) -> Column:
        p, t = (F.array_position(F.transform(s[c], lambda x: w.contains(x) | x.contains(w)), F.lit(True)).cast("int") for c in ("p", "t"))
        hits = [(p > 0) & (t > 0), (p > 0) & (t == 0), (p == 0) & (t > 0)]
        return F.struct(without(s["p"], p).alias("p"), without(s["t"], t).alias("t"), *[(s[n] + h.cast("long")).alias(n) for n, h in zip(names, hits, strict=True)])

    start = F.struct(words(F.array_join(pred, " ")).alias("p"), words(F.array_join(truth, " ")).alias("t"), *[F.lit(0).cast("long").alias(n) for n in names])
    return F.aggregate(words(text), start, step, lambda s: F.struct(*[s[n].alias(n) for n in names]))


def entity_f1(df: DataFrame, text: str, pred: str, truth: str) -> DataFrame:
    """Token F1 of entities (arrays of strings), over all words of all rows."""
    marks = df.select(entity_marks(F.col(text), F.col(pred), F.col(truth)).alias("m"))
    s = marks.agg(*[F.coalesce(F.sum(f"m.{n}"), F.lit(0)).alias(n) for n in ("tp", "fp", "fn")])
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return s.select("tp", "fp", "fn", F.when(d > 0, 2.0 * F.col("tp") / d).otherwise(0.0).alias("f1"))


def text_similarity(a: Column, b: Column) -> Column:
    """Longest common substring over the longer length; null where both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, common_substring_length(a, b) / longer)


def run_cost(df: DataFrame, prices: DataFrame, model: str = "model", prompt_tokens: str = "prompt_tokens", answer_tokens: str = "answer_tokens", most_tokens: int = 1000, images: str | None = None, image_tokens: int = 765) -> DataFrame:
    """Adds ``cost``: tokens times price; no answer counts as ``most_tokens``; only rows that are not ``cached`` cost."""
    p = F.col(prompt_tokens) + (F.col(images) * image_tokens if images else 0)
    cost = p * F.col("prompt_price") + F.coalesce(F.col(answer_tokens), F.lit(most_tokens)) * F.col("answer_price")
    joined = df.join(small(prices), model, "left")
    return joined.withColumn("cost", F.when(F.col("cached"), 0.0).otherwise(cost) if "cached" in df.columns else cost).drop("prompt_price", "answer_price")


def dry_run(sample: DataFrame, rows: int, prompt: str = "prompt") -> DataFrame:
    """Estimate from a costed sample: total, rows, average and one sample prompt."""
    return sample.agg((F.avg("cost") * rows).alias("total_cost"), F.lit(rows).cast("long").alias("rows"), F.avg("cost").alias("average_cost"), F.min(prompt).alias("sample_prompt"))


def leaderboard(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(model, dataset, metric, value) to one row per model and a column ``dataset_metric`` for each known key."""
    return runs.withColumn("key", F.concat_ws("_", "dataset", "metric")).groupBy("model").pivot("key", keys).agg(F.first("value"))
