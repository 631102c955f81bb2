"""Confidence from token log-probabilities (C1 to C7). Tokens: array<struct<token:string,logprob:double>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens as words


def mean_probability(logprobs: Column) -> Column:
    """Geometric mean of the tokens' probabilities, in log space; unknown and empty tokens don't count; none: 0."""
    used = F.filter(logprobs, lambda x: x["logprob"].isNotNull() & ~F.trim(x["token"]).isin("<unk>", "", "\\n"))
    logs = F.transform(used, lambda x: F.when(x["logprob"] > 0, F.log(x["logprob"])).otherwise(x["logprob"]))
    total = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(F.size(logs), F.lit(0)) > 0, F.exp(total / F.size(logs))).otherwise(0.0)


def p_true(logprobs: Column) -> Column:
    """First token that says yes or no: its probability, negative for no; 0 without one."""
    named = F.filter(logprobs, lambda x: F.lower(F.trim(x["token"])).isin("yes", "no"))
    first = F.get(named, F.lit(0))
    p = F.exp(first["logprob"])
    return F.coalesce(F.when(F.lower(F.trim(first["token"])) == "yes", p).otherwise(-p), F.lit(0.0))


def p_true_prompt(prompt: Column, response: Column) -> Column:
    """The second question to the model: its own prompt and answer, and whether that is right."""
    return F.concat(prompt, response, F.lit("\nIs this answer to the last example right? Say Yes or No: "))


def p_true_of_two(yes: Column, no: Column) -> Column:
    """For a model that only scores given texts: the tokens of both, of which the likelier first token decides (equal: no);
    0 where either is missing or empty."""
    first = lambda c: F.get(c, F.lit(0))["logprob"]
    both = (F.size(yes) > 0) & (F.size(no) > 0)
    return F.coalesce(F.when(both, F.when(first(yes) > first(no), p_true(yes)).otherwise(p_true(no))), F.lit(0.0))


def or_zero(confidence: Column, attribute: str) -> Column:
    """An attribute's confidence; missing, or a failed row: 0."""
    return F.coalesce(confidence[attribute], F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mean(logprobs: Column) -> Column:
    """As ``mean_probability``, for tokens whose white space of any kind doesn't count."""
    used = F.filter(logprobs, lambda x: x["logprob"].isNotNull() & ~F.coalesce(x["token"], F.lit("")).rlike(r"(?U)^\s*(<unk>|\\n)?\s*$"))
    total = F.aggregate(used, F.lit(0.0), lambda s, x: s + F.when(x["logprob"] > 0, F.log(x["logprob"])).otherwise(x["logprob"]))
    return F.when(F.size(used) > 0, F.exp(total / F.size(used))).otherwise(0.0)


def _span(logprobs: Column, begin: Column, end: Column) -> Column:
    """Tokens from the place ``begin`` (the first is 1) up to before ``end``."""
    return F.slice(logprobs, begin, F.greatest(end - begin, F.lit(0)))


def _text(logprobs: Column) -> Column:
    return F.array_join(F.transform(logprobs, lambda t: F.coalesce(t["token"], F.lit(""))), "")


def confidence_by_key(keys: list[str]) -> Callable[[Column | str], Column]:
    """A function from a column of tokens to one of map<string,double>: the average of the tokens that follow each ``"key":``, up
    to the next key that is found or the end; absent: 0; no tokens: an empty map; null: null."""
    names = list(dict.fromkeys(keys))

    def ended(tokens: Column, before: Callable[[Column], Column]) -> Column:
        """How many tokens end at a place for which ``before`` holds."""
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

        def step(s: Column, t: Column) -> Column:
            at = s["at"] + F.coalesce(F.length(t["token"]), F.lit(0))
            return F.struct(at.alias("at"), (s["n"] + before(at).cast("int")).alias("n"))

        return F.aggregate(tokens, start, step, lambda s: s["n"])

    def by_key(x: Column) -> Column:
        tokens, spots = x["tokens"], x["spots"]

        def entry(spot: Column) -> Column:
            later = F.array_min(F.filter(F.transform(spots, lambda o: o["at"]), lambda a: a > spot["at"]))
            last = F.when(later.isNull(), F.size(tokens)).otherwise(ended(tokens, lambda at: at <= later))
            first = ended(tokens, lambda at: at < spot["at"] + F.length(spot["key"]) + 3) + 1
            value = F.when(spot["at"] >= 0, _mean(_span(tokens, first + 1, last + 1))).otherwise(0.0)
            return F.struct(spot["key"].alias("key"), value.alias("value"))

        return F.map_from_entries(F.transform(spots, entry))

    def run(logprobs: Column | str) -> Column:
        tokens = F.col(logprobs) if isinstance(logprobs, str) else logprobs
        spots = lambda text: F.array(*[F.struct(F.lit(k).alias("key"), (F.instr(text, F.lit(f'"{k}":')) - 1).alias("at")) for k in names])
        found = F.struct(tokens.alias("tokens"), _let(_text(tokens), spots).alias("spots"))
        nothing = F.create_map().cast("map<string,double>")
        return F.when(F.size(tokens) == 0, nothing).when(tokens.isNotNull(), _let(found, by_key) if names else nothing)

    return run


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common substring of two short texts: a binary search, whose steps try all runs of a length."""
    fits = lambda n: (n <= F.least(F.length(a), F.length(b))) & F.exists(F.sequence(F.lit(1), F.length(a) - n + 1), lambda i: b.contains(a.substr(i, n)))
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))


def confidence_by_label(delimiter: str = ";") -> Callable[[Column | str, Column | str], Column]:
    """A function from columns of tokens and of a list of labels to one of map<string,double>.

    Each label starts with the whole average. Each part of the tokens between delimiters (a part begins with its delimiter's
    token) gives its average to the label that shares the longest run of characters with the part's text, as a share of the
    longer one of both; the first of equal labels, and of several parts the last one (parts of one text are at the place of the
    first of them and give the average of the last). A null on either side is null.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def parts(tokens: Column) -> Column:
        token = lambda i: F.coalesce(F.get(tokens, i - 1)["token"], F.lit(""))
        places = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))

        def part(cuts: Column, k: Column) -> Column:
            begin, end = F.coalesce(F.get(cuts, k - 1), F.lit(1)), F.coalesce(F.get(cuts, k), F.size(tokens) + 1)
            head = F.when(k < F.size(cuts), F.substring_index(token(end), delimiter, 1)).otherwise("")
            tail = F.when(k > 0, F.substring_index(token(begin), delimiter, -1)).otherwise("")
            inner = _text(_span(tokens, F.when(k > 0, begin + 1).otherwise(begin), end))
            return F.struct(strip(F.concat(tail, inner, head)).alias("text"), begin.alias("begin"), end.alias("end"))

        cuts = F.filter(places, lambda i: token(i).contains(delimiter))
        return _let(cuts, lambda c: F.transform(F.sequence(F.lit(0), F.size(c)), lambda k: part(c, k)))

    def best(labels: Column, text: Column) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("ratio"))

        def better(s: Column, label: Column) -> Column:
            ratio = common_length(label, text) / F.greatest(F.length(label), F.length(text))
            return F.when(ratio > s["ratio"], F.struct(label.alias("label"), ratio.alias("ratio"))).otherwise(s)

        return F.aggregate(labels, none, better, lambda s: s["label"])

    def by_label(x: Column) -> Column:
        last = lambda items, same: F.get(F.reverse(F.filter(items, same)), F.lit(0))
        chosen = F.transform(F.array_distinct(F.transform(x["parts"], lambda p: p["text"])), lambda t: F.struct(best(x["labels"], t).alias("label"), last(x["parts"], lambda p: p["text"] == t).alias("part")))

        def entries(found: Column) -> Column:
            part = lambda label: last(found, lambda c: c["label"] == label)["part"]
            return F.transform(x["labels"], lambda label: F.struct(label.alias("label"), F.coalesce(_mean(_span(x["tokens"], part(label)["begin"], part(label)["end"])), F.lit(0.0)).alias("value"), part(label).isNotNull().alias("own")))

        valued = lambda e: F.struct(e["label"].alias("key"), F.when(e["own"], e["value"]).otherwise(x["whole"]).alias("value"))
        return F.map_from_entries(F.transform(_let(chosen, entries), valued))

    def run(logprobs: Column | str, label: Column | str) -> Column:
        tokens, label = (F.col(c) if isinstance(c, str) else c for c in (logprobs, label))
        labels = F.array_distinct(F.filter(F.transform(F.split(label, rf"\Q{delimiter}\E"), strip), lambda x: x != ""))
        found = F.struct(tokens.alias("tokens"), labels.alias("labels"), parts(tokens).alias("parts"), _mean(tokens).alias("whole"))
        return F.when(tokens.isNotNull() & label.isNotNull(), _let(found, by_label))

    return run


def text_chunks(df: DataFrame, text: str, chunk_size: int, keys: list[str]) -> DataFrame:
    """keys, chunk_no and chunk: ``chunk_size`` tokens each; texts without tokens give none."""
    # The words are bound to a variable once: an expression inside the inner lambda would be split anew for each chunk.
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(chunk_size)), lambda s: s <= F.size(w))
    chunks = F.transform(F.array(words(F.col(text))), lambda w: F.transform(starts(w), lambda s: F.array_join(F.slice(w, s, chunk_size), " ")))
    return df.select(*keys, F.posexplode(F.flatten(chunks)).alias("chunk_no", "chunk"))


def merge_chunks(chunks: DataFrame, keys: list[str], confidence: str = "confidence", how: str = "max") -> DataFrame:
    return chunks.groupBy(*keys).agg({"max": F.max, "mean": F.avg}[how](confidence).alias("confidence"))
