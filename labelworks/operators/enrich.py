"""Enrichment stages and output shape (T1 to T7, O1, O2, E1 to E3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import NO_LABEL
from ..functions.templates import render
from .store import json_key

INVALID_INPUT = "INVALID_INPUT"
NO_TRANSFORM = "NO_TRANSFORM"
STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {}
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SELECTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_stage(name: str, stage: Callable[[DataFrame], DataFrame]) -> None:
    STAGES[name] = stage


def register_metric(name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
    METRICS[name] = metric


def register_selector(name: str, selector: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    SELECTORS[name] = selector


def user_stage(df: DataFrame, name: str, inputs: list[str], outputs: dict[str, str], fn: Callable[[pd.DataFrame], pd.DataFrame], store: DataFrame | None = None, params_json: str = "{}") -> tuple[DataFrame, DataFrame]:
    """A user's function over distinct inputs: it returns its named outputs and ``error``, a row for each input.

    outputs: the function's output -> our column; others are dropped. Each column gets ``<column>_error``; where it failed both
    hold the message. Returns the rows and the store's new rows (key, outputs); failures never enter the store.
    """
    keyed = df.withColumn("_key", json_key(df, name, params_json, inputs))
    todo = keyed.select("_key", *inputs).dropDuplicates(["_key"])
    columns = list(outputs)
    if store is not None:
        todo = todo.join(store.select(F.col("key").alias("_key")), "_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                got = fn(pdf[inputs].reset_index(drop=True))
            except Exception as e:  # the stage's failure is the rows' result
                got = pd.DataFrame({**{c: [None] * len(pdf) for c in columns}, "error": [str(e)] * len(pdf)})
            yield pd.DataFrame({"_key": pdf["_key"].to_numpy(object), **{c: list(got[c]) for c in columns}, "_error": list(got["error"])}, dtype=object)

    made = todo.mapInPandas(run, ", ".join(["_key string", *[f"`{c}` string" for c in columns], "_error string"]))
    new = made.where("_error is null").select(F.col("_key").alias("key"), *columns)
    every = made if store is None else made.unionByName(store.select(F.col("key").alias("_key"), *columns, F.lit(None).cast("string").alias("_error")))
    joined = keyed.join(every, "_key", "left")
    shaped = [c for o, n in outputs.items() for c in (F.coalesce("_error", o).alias(n), F.col("_error").alias(f"{n}_error"))]
    return joined.select(*df.columns, *shaped), new


def run_stages(df: DataFrame, task: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame], list[str]]]) -> DataFrame:
    """Stages (name, function, error columns) in order. ``<task>_task_transform`` names the last stage without any error.

    One pass over the last stage's result finds out about the errors of all stages, whose columns it has to keep.
    """
    for _, stage, _ in stages:
        df = stage(df)
    bad = [F.coalesce(F.max(F.greatest(*[F.col(f"`{e}`").isNotNull() for e in errors], F.lit(False))), F.lit(False)) if errors else F.lit(False) for _, _, errors in stages]
    if not stages:
        return df
    failed = df.agg(*[b.alias(f"s{i}") for i, b in enumerate(bad)]).first()
    good = [name for (name, _, _), f in zip(stages, failed, strict=True) if not f]
    return df.withColumn(f"{task}_task_transform", F.lit(good[-1])) if good else df


def page_text(url: Column, html: Column) -> Column:
    """struct(text, error, url) of a fetched page: no url, or NO_TRANSFORM, is an error."""
    missing = F.coalesce(F.trim(url) == "", F.lit(True)) | (url == NO_TRANSFORM)
    whole = F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNull(), F.concat(F.lit("https://"), url)).otherwise(url)
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    # The five references of XML and the blank; the ampersand comes last.
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.struct(F.when(missing, F.lit(INVALID_INPUT)).otherwise(text).alias("text"), F.when(missing, F.lit(INVALID_INPUT)).alias("error"), F.when(~missing, whole).alias("url"))


def join_pages(pages: DataFrame, key: str, number: str, text: str, page_format: str = "Page {n}: {text}", separator: str = "\n\n") -> DataFrame:
    """key, content and num_pages: pages in order of their numbers."""
    before, _, rest = page_format.partition("{n}")
    middle, _, after = rest.partition("{text}")
    line = lambda x: F.concat(F.lit(before), x["n"].cast("string"), F.lit(middle), F.coalesce(x["t"], F.lit("")), F.lit(after))
    grouped = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.col(text).alias("t")))).alias("p"))
    return grouped.select(key, F.array_join(F.transform("p", line), separator).alias("content"), F.size("p").cast("long").alias("num_pages"))


ORGANIC = "array<struct<position:long,title:string,link:string,snippet:string>>"


def search_results(response: Column) -> Column:
    """struct(knowledge_graph, organic_results, error) of a stored search response, in either spelling of its keys."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(response, p) for p in paths])
    organic = F.from_json(first("$.organic_results", "$.organic"), ORGANIC)
    error = F.get_json_object(response, "$.error")
    return F.struct(F.when(error.isNull(), first("$.knowledge_graph", "$.knowledgeGraph")).alias("knowledge_graph"), F.when(error.isNull(), F.to_json(organic)).alias("organic_results"), error.alias("error"))


def places(response: Column) -> Column:
    return F.get_json_object(response, "$.places")


def query_or_error(template: str, columns: list[str]) -> Column:
    """struct(query, error): a template per row; an empty query, or NO_TRANSFORM, is an error."""
    q = render(template, columns, null_text="")
    bad = (F.trim(q) == "") | (q == NO_TRANSFORM)
    return F.struct(F.when(~bad, q).alias("query"), F.when(bad, F.lit(INVALID_INPUT)).alias("error"))


def shape(df: DataFrame, task: str, attributes: list[str], label: str = "label", error: str = "error", prompt: str = "prompt", confidence: str | None = None, explanation: str | None = None) -> DataFrame:
    """Result columns of a labelled table: run-level ones as ``<task>_task_<x>``, attribute-level ones as ``<attribute>_<x>``."""
    ok = F.col(error).isNull()
    out = {f"{task}_task_label": F.when(ok, F.col(label)), f"{task}_task_error": F.col(error), f"{task}_task_prompt": F.col(prompt), f"{task}_task_successfully_labeled": ok}
    out |= {f"{a}_label": F.when(ok, F.coalesce(F.col(label)[a], F.lit(""))).otherwise(NO_LABEL) for a in attributes}
    if confidence:
        out |= {f"{task}_task_confidence": F.col(confidence)} | {f"{a}_confidence": F.when(ok, F.coalesce(F.col(confidence)[a], F.lit(0.0))).otherwise(0.0) for a in attributes}
    if explanation:
        out[f"{task}_task_explanation"] = F.col(explanation)
    return df.withColumns(out)


def chain(df: DataFrame, stages: dict[str, tuple[Callable[[DataFrame], DataFrame], set[str]]]) -> DataFrame:
    """Stages {name: (function, names it needs)} in an order that respects what they need; a cycle raises ValueError."""
    done: set[str] = set()
    while len(done) < len(stages):
        ready = next((n for n, (_, needs) in stages.items() if n not in done and needs <= done), None)
        if ready is None:
            raise ValueError("stages depend on each other in a circle")
        df = stages[ready][0](df)
        done.add(ready)
    return df
