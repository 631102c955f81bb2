"""Model answers to labels (M2 to M7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowComments": "true", "allowUnquotedControlChars": "true", "allowNumericLeadingZeros": "true"}
NO_LABEL = "NO_LABEL"


def error_type(code: Column) -> Column:
    """A provider's failure code to an error type; null code, null error."""
    c = F.lower(code)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c.contains("context"), F.lit("context_length_error")).when(c.contains("rate"), F.lit("rate_limit_error")).otherwise(F.lit("llm_provider_error"))


def _last_of_each(m: Column) -> Column:
    """Duplicate keys: the last one stays."""
    e = F.map_entries(m)
    return F.map_from_entries(F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])))


def parse_answer(response: Column) -> Column:
    """A JSON answer as a map of attribute to text; null where nothing parses.

    A code fence is stripped, then lenient JSON is tried, then the text from the first to the last brace.
    """
    bare = F.regexp_replace(F.trim(response), r"^```[A-Za-z]*\s*|\s*```$", "")
    object_ = F.regexp_replace(F.regexp_extract(bare, r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")
    read = lambda c: F.from_json(c, "map<string,string>", LENIENT)
    whole = F.when(bare.startswith("{"), read(bare))
    m = F.coalesce(F.when(F.size(whole) >= 0, whole), F.when(object_ != "", read(object_)))
    m = F.map_filter(m, lambda k, v: v.isNotNull())
    return _last_of_each(m)


def keep_options(value: Column, options: list[str]) -> Column:
    """Closed vocabulary: the value, or null."""
    return F.when(value.isin(options), value)


def keep_options_of_list(value: Column, options: list[str], separator: str = ";") -> Column:
    """Closed vocabulary of several labels: those items that are options; null where none is."""
    items = F.filter(F.split(value, separator), lambda x: F.trim(x).isin(options))
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def chain_of_thought(response: Column) -> Column:
    """struct(label, explanation, error_type): the first line explains, the last one holds JSON with ``label``."""
    text = F.trim(F.coalesce(response, F.lit("")))
    lines = F.split(text, "\n")
    last = F.regexp_extract(F.element_at(lines, -1), r"\{.*\}", 0)
    label = F.when(last != "", F.get_json_object(last, "$.label"))
    error = F.when(text == "", F.lit("empty_response_error")).when(label.isNull(), F.lit("parsing_error"))
    return F.struct(F.when(error.isNotNull(), F.lit(NO_LABEL)).otherwise(label).alias("label"), F.element_at(lines, 1).alias("explanation"), error.alias("error_type"))


#: A strict reader, but for NaN and Infinity: its only use is to tell whether a text is JSON.
STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowComments": "false", "mode": "PERMISSIVE"}


def json_substring(text: Column | str) -> Column:
    """The leftmost balanced {...} of a text, if it is valid JSON; an unclosed brace is skipped, null where there is none.

    One scan over the pieces between braces. From the first opening brace on, the text starts with a run of opening ones. With
    ``low`` the least depth after any closing brace, the first ``low`` braces stay open, and the next one closes where ``low``
    is first reached.
    """
    text = F.col(text) if isinstance(text, str) else text
    rest = F.regexp_extract(text, r"(?s)\{.*", 0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(1 << 30).alias("low"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        at, closes = s["at"] + F.length(piece), piece.endswith("}")
        depth = F.when(closes, F.greatest(s["depth"] - 1, F.lit(0))).when(piece.endswith("{"), s["depth"] + 1).otherwise(s["depth"])
        lower = closes & (depth < s["low"])
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(lower, depth).otherwise(s["low"]).alias("low"), F.when(lower, at).otherwise(s["end"]).alias("end"))

    def span(x: Column) -> Column:
        begin = F.length(F.call_function("substring_index", x["rest"], F.lit("{"), x["s"]["low"] + 1))
        return F.when(x["s"]["end"] > 0, x["rest"].substr(begin + 1, x["s"]["end"] - begin))

    scanned = F.struct(rest.alias("rest"), F.aggregate(F.split(rest, r"(?<=[{}])"), start, step).alias("s"))
    found = F.transform(F.array(scanned), span)
    valid = F.filter(found, lambda x: F.from_json(x, "map<string,string>", STRICT).isNotNull())
    return F.get(valid, F.lit(0))
