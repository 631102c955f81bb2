"""Response, confidence, transform and embedding stores as tables (J1 to J7), the model step (M1) and its votes (M8, M9)."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import md5_of
from ..sources.scratch import stored

WEEK_MS = 7 * 24 * 3600 * 1000
TOKENS = "array<struct<token:string,logprob:double>>"
#: The error type of prompts that a task had no calls left for, and the types of failures that another call may mend.
OVER_BUDGET = "call_budget_error"
RETRIED = ("rate_limit_error", "llm_provider_error", OVER_BUDGET)


def generation_key(model: str, params: str, prompt: Column) -> Column:
    return md5_of(F.lit(model), F.lit(params), prompt)


def json_key(df: DataFrame, name: str, params_json: str, columns: list[str]) -> Column:
    """Key of a transform: its name, its parameters and the input columns as JSON in order of their names."""
    return md5_of(F.lit(name), F.lit(params_json), F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])))


def live(store: DataFrame, now_ms: int) -> DataFrame:
    """Rows that have not outlived their time."""
    return store.where(F.lit(now_ms) - F.col("created_ms") <= F.col("ttl_ms"))


def shuffled(df: DataFrame) -> DataFrame:
    """The frame, marked to be met by a sort-merge join. A table with a row for each row or prompt has small files and large rows:
    by the size of its files Spark would send it through the driver."""
    return df.hint("merge")


def hits(df: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    return df.join(shuffled(store), key, "inner")


def misses(df: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    return df.join(shuffled(store.select(key)), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "key", error: str | None = "error") -> DataFrame:
    """One row per key, the newest; failed new rows are not kept. Combined on the map side."""
    if error and error in new.columns:
        new = new.where(F.col(error).isNull())
    both = old.unionByName(new.select(*old.columns))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), "created_ms").alias("r"))
    return newest.select(key, "r.*").select(*old.columns)


def call_model(prompts: DataFrame, fn: Callable[[pd.Series], pd.DataFrame], calls: int | None = None, batch_rows: int = 1000, most_calls: int | None = None, wait: float = 0.0) -> DataFrame:
    """``fn`` on batches of (key, prompt); it returns text and error for each, and if it knows them code (the provider's
    failure code), logprobs (a list of (token, logprob) pairs) and cost. An exception becomes an error of each row.

    Columns: key, response, error (the message), error_type, logprobs, cost. ``calls`` tasks call at once (default: the cluster's
    parallelism). A task asks at most ``most_calls`` prompts, the others come back with the error type of OVER_BUDGET; before
    each batch it waits ``wait`` seconds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = 0
        for pdf in batches:
            for a in range(0, len(pdf), batch_rows):
                part = pdf.iloc[a : a + batch_rows]
                if most_calls is not None and asked + len(part) > most_calls:
                    over = part.iloc[max(0, most_calls - asked) :]
                    part = part.iloc[: max(0, most_calls - asked)]
                    yield pd.DataFrame({"key": over["key"].to_numpy(object), "response": None, "error": "no calls left", "code": OVER_BUDGET, "logprobs": None, "cost": None}, dtype=object)
                    if not len(part):
                        continue
                asked += len(part)
                none = [None] * len(part)
                if wait:
                    time.sleep(wait)
                try:
                    got = fn(part["prompt"].reset_index(drop=True))
                    texts, errors = list(got["text"]), list(got["error"])
                    codes, logs, costs = (list(got[c]) if c in got else none for c in ("code", "logprobs", "cost"))
                except Exception as e:  # the provider's failure is the rows' result
                    texts, errors, codes, logs, costs = none, [f"llm_provider_error: {e}"] * len(part), ["llm_provider_error"] * len(part), none, none
                tokens = [[{"token": t, "logprob": p} for t, p in x] if isinstance(x, (list, tuple, np.ndarray)) else None for x in logs]
                yield pd.DataFrame({"key": part["key"].to_numpy(object), "response": texts, "error": errors, "code": codes, "logprobs": tokens, "cost": costs}, dtype=object)

    tasks = calls or prompts.sparkSession.sparkContext.defaultParallelism
    made = prompts.select("key", "prompt").repartition(tasks).mapInPandas(run, f"key string, response string, error string, code string, logprobs {TOKENS}, cost double")
    return made.select("key", "response", "error", F.when(F.col("code") == OVER_BUDGET, OVER_BUDGET).when(F.col("error").isNotNull(), parse.error_type(F.coalesce("code", "error"))).alias("error_type"), "logprobs", "cost")


def call_in_rounds(prompts: DataFrame, fn: Callable[[pd.Series, int], pd.DataFrame], rounds: int = 3, retried: tuple[str, ...] = RETRIED, calls: int | None = None, most_calls: int | None = None, wait: float = 0.0, prompts_per_task: int = 10_000) -> DataFrame:
    """``call_model`` on (key, prompt), and again on what failed in a way that may pass, for at most so many rounds.

    ``fn`` takes the prompts and the round, from 1. Each round's answers are a stored table, so a lost executor repeats no
    round before; the next one reads only its failures, and only those of the types in ``retried``. The wait before a batch
    doubles from round to round (none in the first). The last answer of each key is returned, with ``rounds``, the
    number of times it was asked.
    """
    pending, kept = stored(prompts.select("key", "prompt").dropDuplicates(["key"]), "round-0"), []
    for turn in range(1, rounds + 1):
        left = pending.count()
        if not left:
            break
        tasks = calls or max(prompts.sparkSession.sparkContext.defaultParallelism, -(-left // prompts_per_task))
        answers = call_model(pending, lambda s, turn=turn: fn(s, turn), tasks, most_calls=most_calls, wait=wait * 2 ** (turn - 2) if turn > 1 else 0.0)
        made = stored(answers.withColumn("rounds", F.lit(turn)), f"round-{turn}")
        again = F.coalesce(F.col("error_type").isin(*retried), F.lit(False)) if turn < rounds else F.lit(False)
        kept.append(made.where(~again))
        if turn < rounds:
            pending = stored(pending.join(shuffled(made.where(again).select("key")), "key", "left_semi"), f"pending-{turn}")
    if not kept:
        return call_model(pending, lambda s: fn(s, 1)).withColumn("rounds", F.lit(0))
    return functools.reduce(DataFrame.unionByName, kept)


def label_prompts(prompts: DataFrame, store: DataFrame, fn: Callable[[pd.Series], pd.DataFrame], now_ms: int, calls: int | None = None, ttl_ms: int = WEEK_MS, write_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers for (row_id, key, prompt), calling ``fn`` once per distinct key that the store lacks.

    Returns the rows with response, error, error_type, logprobs, cost and cached, and the store's new rows. With ``write_to``, a
    new folder that all executors reach, the new rows are written there first and read back, so that neither the second use
    nor a lost executor repeats a call; without it a caller that uses both results does so. The store's log-probabilities
    are used where it has them; a stored answer costs nothing, and rows with one prompt share one call and show its cost each.
    """
    known = live(store, now_ms).select("key", F.col("response").alias("known"), (F.col("logprobs") if "logprobs" in store.columns else F.lit(None)).cast(TOKENS).alias("known_logprobs"))
    todo = misses(prompts.select("key", "prompt").dropDuplicates(["key"]), known)
    made = call_model(todo, fn, calls).withColumn("created_ms", F.lit(now_ms).cast("long")).withColumn("ttl_ms", F.lit(ttl_ms).cast("long"))
    if write_to is not None:
        made.write.parquet(write_to)
        made = prompts.sparkSession.read.schema(made.schema).parquet(write_to)
    return answered(prompts, known, made), made


def answered(prompts: DataFrame, known: DataFrame, made: DataFrame) -> DataFrame:
    cached = F.col("known").isNotNull()
    joined = prompts.join(shuffled(known), "key", "left").join(shuffled(made.select("key", "response", "error", "error_type", "logprobs", "cost")), "key", "left")
    return joined.select(*prompts.columns, F.coalesce("known", "response").alias("response"), "error", "error_type", F.when(cached, F.col("known_logprobs")).otherwise(F.col("logprobs")).alias("logprobs"), F.when(cached, 0.0).otherwise(F.col("cost")).alias("cost"), cached.alias("cached"))


def majority(answers: DataFrame, row: str = "row_id", position: str = "pos", label: str = "label", payload: list[str] = ()) -> DataFrame:
    """The most frequent label of each row, ties to the one seen first; payload columns come from its first position."""
    counted = answers.groupBy(row, label).agg(F.count("*").alias("votes"), F.min(position).alias("first"), *[F.min_by(c, position).alias(c) for c in payload])
    best = counted.groupBy(row).agg(F.max_by(F.struct(label, "votes", "first", *payload), F.struct(F.col("votes"), -F.col("first"))).alias("b"))
    return best.select(row, "b.*")


def expand_answers(answers: DataFrame, columns: list[str], label: str = "label", response: str = "response", delimiter: str = ",") -> DataFrame:
    """Rows written in a delimited answer: its first line names the columns; each row gets the label that asked for it."""
    lines = F.split(F.trim(F.col(response)), "\r?\n")
    fields = lambda c: F.transform(F.split(c, delimiter), lambda x: F.trim(x))
    rows = answers.where(F.col(response).isNotNull()).select(F.col(label), fields(lines[0]).alias("names"), F.posexplode(F.slice(lines, 2, F.size(lines))).alias("line_no", "line"))
    cells = rows.where(F.trim("line") != "").withColumn("cells", fields(F.col("line")))
    whole = F.map_from_arrays("names", F.transform("names", lambda n, i: F.get(F.col("cells"), i)))
    return cells.withColumn("m", whole).select(F.col(label), F.col("line_no").cast("long").alias("line_no"), *[F.col("m")[c].alias(c) for c in columns])


def embeddings_for(texts: DataFrame, store: DataFrame, embed: Callable[[pd.Series], pd.Series], model: str) -> tuple[DataFrame, DataFrame]:
    """(text, embedding) rows for all texts and the store's new rows; each new text is embedded once."""
    keyed = texts.withColumn("key", md5_of(F.lit(model), F.col("text")))
    todo = misses(keyed.dropDuplicates(["key"]), store)
    made = todo.select("key", "text", F.pandas_udf(lambda s: embed(s), "array<float>")("text").alias("embedding"))
    every = store.select("key", "embedding").unionByName(made.select("key", "embedding"))
    return hits(keyed, every).drop("key"), made.select("key", "embedding")
