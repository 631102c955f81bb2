"""Row to text: templates, prompts, example answers (P3 to P12)."""

from __future__ import annotations

import json
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import token_count


def placeholders(template: str) -> list[str]:
    return [name for _, name, _, _ in Formatter().parse(template) if name]


def render(template: str, columns: list[str], null_text: str = "nan", source: str | None = None) -> Column:
    """A ``{column}`` template as one concatenation. Unknown columns give empty text; nulls give ``null_text``.

    ``source``: a struct column whose fields are meant, instead of the frame's columns.
    """
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name and name in columns:
            c = F.col(f"{source}.`{name}`" if source else f"`{name}`")
            parts.append(F.coalesce(c.cast("string"), F.lit(null_text)))
    return F.concat(*parts) if parts else F.lit("")


def query_text(columns: list[str], null_text: str = "nan") -> Column:
    """Values of the columns in order of their names, joined by a blank."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)) for c in sorted(columns)])


def safe_strings(df: DataFrame) -> DataFrame:
    """All columns as strings; nested ones as JSON."""
    return df.select(*[(F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def answer_json(attributes: list[str]) -> Column:
    """The JSON answer of an example; null where an attribute is missing or empty (the example is then left out)."""
    whole = F.lit(True)
    for a in attributes:
        whole &= F.coalesce(F.length(F.col(a).cast("string")) > 0, F.lit(False))
    return F.when(whole, F.to_json(F.struct(*[F.col(a).cast("string").alias(a) for a in attributes])))


def attribute_description(name: str, description: str, options: list[str] | None = None, option_texts: dict[str, str] | None = None, selected: Column | None = None) -> Column:
    """What the model is told of an attribute; options come from the row's selected labels where given."""
    head = f"{name}: {description}"
    if selected is not None:
        return F.when(F.coalesce(F.size(selected), F.lit(0)) > 0, F.concat(F.lit(head + " Options: "), F.array_join(selected, ","))).otherwise(F.lit(head + (" Options: " + ",".join(options) if options else "")))
    text = head + (" Options: " + ",".join(options) if options else "")
    if option_texts:
        text += " " + json.dumps(option_texts, sort_keys=True)
    return F.lit(text)


LAYOUT = "{guidelines}\n\n{output}\n\n{examples}{current}"


def prompt(guidelines: str, output_guidelines: Column | str, current: Column, examples: Column | None = None) -> Column:
    """Guidelines, output guidelines, examples (an array of texts, if any) and the row's own text, a blank line between."""
    output = F.lit(output_guidelines) if isinstance(output_guidelines, str) else output_guidelines
    blocks = [F.lit(guidelines), output]
    if examples is not None:
        blocks.append(F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.array_join(examples, "\n\n")))
    return F.concat_ws("\n\n", *blocks, current)


def trimmed(parts: list[Column], most_tokens: int, extra: int = 0, count=token_count) -> Column:
    """An array of the parts, cut (in the given order) until their tokens together fit; a cut part keeps
    ``int(max(0, length * (tokens - over - 1) / (tokens + 1)))`` characters, and cutting stops as soon as it fits.

    A fold over the parts, so that the expression grows with their number and each is counted once before and once after.
    """
    rows = F.array(*[F.struct(p.cast("string").alias("part"), count(p).cast("long").alias("own")) for p in parts])

    def step(state: Column, row: Column) -> Column:
        over = state["total"] - most_tokens
        keep = F.greatest(F.lit(0.0), F.length(row["part"]) * (row["own"] - over - 1) / (row["own"] + 1)).cast("int")
        new = F.when(over > 0, F.substring(row["part"], F.lit(1), keep)).otherwise(row["part"])
        return F.struct(F.concat(state["done"], F.array(new)).alias("done"), (state["total"] - row["own"] + F.when(over > 0, count(new)).otherwise(row["own"])).cast("long").alias("total"))

    folded = lambda x: F.aggregate(x, F.struct(F.array().cast("array<string>").alias("done"), F.aggregate(x, F.lit(extra).cast("long"), lambda s, r: s + r["own"]).alias("total")), step)["done"]
    # Bound once: the counts would be taken anew for each use.
    return F.transform(F.array(rows), folded)[0]


def trim_parts(parts: list[Column], most_tokens: int, extra: int = 0, count=token_count) -> list[Column]:
    """The same as a column for each part."""
    cut = trimmed(parts, most_tokens, extra, count)
    return [cut[i] for i in range(len(parts))]


def multimodal(text: Column, image_columns: list[str]) -> Column:
    return F.to_json(F.struct(text.alias("text"), *[F.col(c) for c in image_columns]))


def explanation_prompt(task: str, example: Column, label: Column | None = None) -> Column:
    """Asks for the reason of a labelled example; the label goes in where given."""
    parts = [F.lit(f"{task}\n\nExplain the answer of this example step by step.\n"), example]
    if label is not None:
        parts += [F.lit("\nAnswer: "), F.coalesce(label.cast("string"), F.lit("nan"))]
    return F.concat(*parts)


def add_explanations(seeds: DataFrame, responses: DataFrame, key: str, column: str) -> DataFrame:
    """Fill the configured explanation column from (key, response); missing answers give empty text."""
    if not column:
        raise ValueError("no explanation column is configured")
    return seeds.drop(column).join(responses.select(key, F.col("response")), key, "left").withColumn(column, F.coalesce("response", F.lit(""))).drop("response")


def rename_outputs(df: DataFrame, names: dict[str, str], label_map: str | None = None, attributes: list[str] = ()) -> DataFrame:
    """Rename columns, and project attributes out of a label map."""
    df = df.withColumnsRenamed(names)
    return df.withColumns({a: F.col(label_map)[a] for a in attributes}) if label_map else df
