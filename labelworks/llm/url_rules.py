"""Operator 12: allow and block rules for URLs, found by hashed host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits a URL if the URL's host is the rule's host or a subdomain of it and the URL's path starts
with the rule's path. Each different (host, path) is expanded into expressions, one for each host suffix and path prefix that
some rule could have; the expressions meet the rules on the first 8 hexadecimal digits of their SHA-256 digests, and whole
digests confirm. Of several fitting rules the longest (host and path together) wins, then the one with the longer host.

Column functions only. Rules are broadcast in blocks of a checked size: more rules make more passes over the different
URLs, never a larger broadcast. URLs are reduced to different (host, path) pairs on the map side before they are expanded.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; so does an empty host. A host
keeps its user part and port. A path may be empty: then only a rule with an empty path fits. Rules with a null or empty host
fit nothing, a null path counts as empty; of a rule given twice the last verdict in alphabetical order holds (block before
allow). Rows keep their other columns and their number; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8
#: One broadcast holds at most so many rules and so many characters of them.
BLOCK_RULES, BLOCK_CHARS = 200_000, 32_000_000
NEW = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased, and the path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; neither part can hold the mark between them."""
    return F.sha2(F.concat(host, F.lit("#"), path), 256)


def known_rules(rules: DataFrame) -> DataFrame:
    """One row for each (host, path): digest, the rule's text, verdict and the lengths that decide between rules."""
    plain = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
    once = plain.where("h <> ''").groupBy("h", "p").agg(F.max("v").alias("v"))
    return once.select("h", "p", digest(F.col("h"), F.col("p")).alias("rule_digest"), F.struct(F.length(F.concat("h", "p")).alias("chars"), F.length("h").alias("host_chars"), F.concat("h", "p").alias("rule"), F.col("v").alias("verdict")).alias("found"))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The host and what follows each of its dots, as far as rules have so many labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(most_labels)), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def path_prefixes(path: Column, most_slashes: int, lengths: list[int]) -> Column:
    """The path up to each of its first slashes, and its prefixes of the given lengths."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    at_slash = F.transform(F.filter(F.sequence(F.lit(0), F.lit(most_slashes)), lambda n: (n > 0) & (n <= slashes)), lambda n: F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))
    if not lengths:
        return at_slash
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.concat(at_slash, F.transform(cut, lambda n: F.substring(path, F.lit(1), n)))


def winners(urls: DataFrame, rules: DataFrame, block_rules: int = BLOCK_RULES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The best rule of each different (h, p) of ``urls`` that some rule fits, as the struct ``found``."""
    known = known_rules(rules)
    odd = F.when(~F.col("p").endswith("/"), F.length("p"))
    slashes = F.length("p") - F.length(F.replace("p", F.lit("/"), F.lit("")))
    shape = known.agg(F.count("*").alias("n"), F.sum(F.length("h") + F.length("p")).alias("chars"), F.max(F.size(F.split("h", r"\."))).alias("labels"), F.max(F.when(F.col("p").endswith("/"), slashes)).alias("slashes"), F.collect_set(odd).alias("lengths")).first()
    suffixes = host_suffixes(F.col("h"), shape.labels or 1)
    prefixes = path_prefixes(F.col("p"), shape.slashes or 0, sorted(shape.lengths))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: digest(s, x))))
    expressions = urls.where("h <> ''").select("h", "p").distinct().select("h", "p", F.explode(every).alias("url_digest"))
    short = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    blocks = max(1, -(-shape.n // block_rules), -(-(shape.chars or 0) // block_chars))
    met = []
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("rule_digest"), F.lit(blocks)) == b).select("rule_digest", "found", short("rule_digest").alias("prefix"))
        near = expressions.withColumn("prefix", short("url_digest")).join(F.broadcast(block), "prefix")
        met.append(near.where("url_digest = rule_digest").groupBy("h", "p").agg(F.max("found").alias("found")))
    whole = functools.reduce(DataFrame.unionByName, met)
    return whole if blocks == 1 else whole.groupBy("h", "p").agg(F.max("found").alias("found"))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """All rows with host, path, the rule that decides (null without one) and its verdict, else ``default``."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in df.columns if c not in NEW]
    parted = df.select(F.struct(*kept).alias("row"), F.coalesce(host, F.lit("")).alias("h"), F.coalesce(path, F.lit("")).alias("p"))
    judged = parted.join(winners(parted, rules, block_rules), ["h", "p"], "left")
    return judged.select("row.*", F.col("h").alias("host"), F.col("p").alias("path"), F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op12_query(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(str(x) for x in RULES) + " AS r(host, path, verdict)")
    return judge(pages.select("page_id", "url"), rules).drop("url")
