"""A whole labelling run, with the user's stages, example selector and metrics looked up by name.

Rows and seeds pass the stages; the selector gives each row its examples; prompts are rendered; each generation asks the model for
those distinct prompts that the store has no live answer to, in rounds; answers are parsed, kept to the options and voted
on; confidences are those of the first answer that gave the winning label. A row that no generation answered has the first one's
error. All of it is one row for each (row_id, attribute), which the metrics read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, parse, templates
from ..sources.scratch import stored
from . import enrich, metrics
from . import store as stores


@dataclass(frozen=True)
class Plan:
    """What a run does: options of each attribute, templates over the columns that the stages leave, and names of hooks."""

    guidelines: str
    attributes: dict[str, list[str]]
    current: str
    selector: str
    stages: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    generations: int = 1
    rounds: int = 3
    model: str = "model"
    params: dict = field(default_factory=dict)


def _hook(known: dict, kind: str, name: str) -> Callable:
    if name not in known:
        raise ValueError(f"no {kind} is registered as {name!r}")
    return known[name]


def prompts_of(rows: DataFrame, seeds: DataFrame, plan: Plan) -> DataFrame:
    """row_id and prompt of each row. ``seeds`` hold the attributes' true labels; the selector gets them with ``shot``, their text
    as an example, and returns row_id and examples (an array of texts); rows that it leaves out have none."""
    for name in plan.stages:
        stage = _hook(enrich.STAGES, "stage", name)
        rows, seeds = stage(rows), stage(seeds)
    answer = F.concat(F.lit("\nAnswer: "), templates.answer_json(list(plan.attributes)))
    shots = seeds.withColumn("shot", F.concat(templates.render(plan.current, seeds.columns), answer)).where("shot is not null")
    chosen = _hook(enrich.SELECTORS, "selector", plan.selector)(rows, shots).select("row_id", "examples")
    output = F.lit("\n".join(f"{a}: Options: {','.join(o)}" for a, o in plan.attributes.items()))
    current = templates.render(plan.current, rows.columns)
    met = rows.withColumn("current", current).join(stores.shuffled(chosen), "row_id", "left")
    return met.select("row_id", templates.prompt(plan.guidelines, output, F.col("current"), F.col("examples")).alias("prompt"))


def key_of(plan: Plan, generation: int) -> F.Column:
    """The store's key of a prompt in a generation."""
    return stores.generation_key(plan.model, json.dumps(plan.params | {"generation": generation}, sort_keys=True), F.col("prompt"))


def answers(prompts: DataFrame, plan: Plan, fn: Callable[[pd.Series, int, int], pd.DataFrame], store: DataFrame, now_ms: int) -> DataFrame:
    """The columns of ``prompts`` with response, error, error_type, logprobs, cost, cached and ``pos``, a row per generation.

    ``fn`` takes prompts, the round and the generation.
    """
    known = stores.live(store, now_ms).select("key", F.col("response").alias("known"), (F.col("logprobs") if "logprobs" in store.columns else F.lit(None)).cast(stores.TOKENS).alias("known_logprobs"))
    made = []
    for g in range(plan.generations):
        keyed = prompts.withColumn("key", key_of(plan, g))
        todo = stores.misses(keyed.select("key", "prompt").dropDuplicates(["key"]), known)
        new = stores.call_in_rounds(todo, functools.partial(_generation, fn, g), plan.rounds).drop("rounds")
        made.append(stores.answered(keyed, known, new).withColumn("pos", F.lit(g)))
    return functools.reduce(DataFrame.unionByName, made)


def _generation(fn: Callable, generation: int, prompts: pd.Series, turn: int) -> pd.DataFrame:
    return fn(prompts, turn, generation)


def voted(said: DataFrame, plan: Plan) -> DataFrame:
    """row_id, attribute, pred, conf, votes and error, a row for each of both."""
    names = list(plan.attributes)
    scored = said.withColumns({"label": parse.parse_answer(F.col("response")), "score": confidence.confidence_by_key(names)("logprobs")})
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), parse.keep_options(F.col("label")[a], o).alias("label"), confidence.or_zero(F.col("score"), a).alias("conf")) for a, o in plan.attributes.items()]))
    votes = scored.select("row_id", "pos", each.alias("x")).select(F.struct("row_id", "x.attribute").alias("of"), "pos", "x.label", "x.conf").where("label is not null")
    best = stores.majority(votes, "of", "pos", "label", ["conf"]).select("of.*", F.col("label").alias("pred"), "conf", "votes")
    failed = F.when(F.count_if(F.col("error_type").isNull()) == 0, F.min_by("error_type", "pos"))
    rows = said.groupBy("row_id").agg(failed.alias("error")).withColumn("attribute", F.explode(F.array(*map(F.lit, names))))
    return rows.join(stores.shuffled(best), ["row_id", "attribute"], "left").select("row_id", "attribute", "pred", F.coalesce("conf", F.lit(0.0)).alias("conf"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), "error")


def label(rows: DataFrame, seeds: DataFrame, plan: Plan, fn: Callable[[pd.Series, int, int], pd.DataFrame], store: DataFrame, now_ms: int) -> DataFrame:
    """The run's rows. Prompts and answers are stored tables: neither is made twice, whatever reads them. The answers are met
    by key and stored without the prompts' texts."""
    prompts = stored(prompts_of(rows, seeds, plan), "run-prompts")
    return voted(stored(answers(prompts, plan, fn, store, now_ms).drop("prompt"), "run-answers"), plan)


def evaluated(found: DataFrame, truths: DataFrame, plan: Plan) -> DataFrame:
    """attribute, metric and value: the library's metrics, and the user's. ``truths``: row_id, attribute, truth.

    A user's metric takes the long table (attribute, pred, truth, conf, error) and returns attribute and value.
    """
    long = stored(found.join(stores.shuffled(truths), ["row_id", "attribute"], "left"), "run-long")
    own = [_hook(enrich.METRICS, "metric", name)(long).select("attribute", F.lit(name).alias("metric"), F.col("value").cast("double").alias("value")) for name in plan.metrics]
    return functools.reduce(DataFrame.unionByName, own, metrics.metric_rows(long))
