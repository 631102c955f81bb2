"""Checks of a table before labelling (V1 to V6): one row per problem (row_id, loc, msg, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import placeholders

PROBLEM = "struct<loc:string,msg:string,type:string>"


def expected_columns(template: str, label: str | None = None, explanation: str | None = None) -> list[str]:
    return [c for c in dict.fromkeys(placeholders(template)) if c not in (label, explanation)]


def check_columns(df: DataFrame, template: str, label: str | None = None, explanation: str | None = None) -> None:
    """Raises ValueError before anything runs where the template needs columns that the table lacks."""
    missing = sorted(set(expected_columns(template, label, explanation)) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def _problem(when: Column, loc: str, msg: Column | str, kind: str) -> Column:
    return F.when(when, F.struct(F.lit(loc).alias("loc"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"), F.lit(kind).alias("type")))


def required_text(column: str) -> Column:
    return _problem(F.col(column).isNull(), column, "a value is required", "missing")


def _unknown(items: Column, labels: list[str], column: str) -> Column:
    extra = F.array_except(items, F.array(*[F.lit(x) for x in labels]))
    return _problem(F.coalesce(F.size(extra) > 0, F.lit(False)), column, F.concat(F.lit("not in the label set: "), F.array_join(F.sort_array(extra), ", ")), "value_error")


def _items(column: str, otherwise: Column) -> Column:
    """Items of a list literal; else the given items."""
    text = F.trim(F.col(column))
    literal = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    return F.when(text.startswith("[") & text.endswith("]"), literal).otherwise(otherwise)


def single_label(column: str, labels: list[str]) -> Column:
    """A label, or a list literal whose items are all labels."""
    return _unknown(_items(column, F.array(F.col(column))), labels, column)


def many_labels(column: str, labels: list[str], separator: str = ";") -> Column:
    return _unknown(_items(column, F.transform(F.split(column, separator), lambda x: F.trim(x))), labels, column)


def entity_map(column: str, labels: list[str]) -> Column:
    """A JSON object whose keys are labels; anything else is a problem."""
    m = F.from_json(column, "map<string,string>")
    bad = _problem(F.col(column).isNotNull() & (m.isNull() | ~F.trim(F.col(column)).startswith("{")), column, "not a JSON object", "type_error")
    return F.coalesce(bad, _unknown(F.map_keys(m), labels, column))


def problems(df: DataFrame, checks: list[Column], row_id: str = "row_id") -> DataFrame:
    return df.select(row_id, F.explode(F.array_compact(F.array(*checks))).alias("p")).select(row_id, "p.*")


def require_valid(found: DataFrame, shown: int = 20) -> None:
    """Raises ValueError with the number of problems and some of them."""
    n = found.count()
    if n:
        raise ValueError(f"{n} problems, such as {[r.asDict() for r in found.limit(shown).collect()]}")
