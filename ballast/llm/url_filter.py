"""URL rules looked up in Bloom filter cascades, by DataFrame functions alone.

A rule is a host and the begin of a path; its key is both in a row.  The keys a url can match are its host's suffixes
with as many labels as some rule has, each with as long a begin of its path as such a rule has: a few keys a url.  The
key universe of a corpus is all of them.  Level 1 of a cascade encodes the listed keys, level 2 the other keys
of the universe that level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until nothing is
let through wrongly.  A key of the universe is listed if the first level that rejects it is an even one (or none does
and the number of levels is odd): exact, without a join.
"""
from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import collect_bounded
from ballast.functions.store import written

# Largest filter of one level that is sent along with the plan, in bytes; longer rule lists are refused.
MAX_LEVEL_BYTES = 64 << 20


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number, hash functions, bits and words of 32 bits."""

    number: int
    hashes: int
    bits: int
    words: Column

    def lets_through(self, key: Column) -> Column:
        hit = F.lit(True)
        for place in _places(key, self.number, self.hashes, self.bits):
            word = F.get(self.words, F.shiftright(place, 5).cast("int"))
            hit = hit & (F.getbit(word, (place % 32).cast("int")) == 1)
        return hit


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def _build(keys: DataFrame, level: int, count: int, rate: float) -> Level:
    """The filter of ``keys`` (column ``key``) that lets others through at about ``rate``."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(1.4427 * max(1, count) * hashes))
    if bits > 8 * MAX_LEVEL_BYTES:
        raise ValueError(f"level {level} of the filter needs {bits // 8} bytes; at most {MAX_LEVEL_BYTES} are sent to executors")
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, hashes, bits))).alias("at"))
    words = set_bits.groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("value"))
    filled = [0] * (bits // 32 + 1)
    for row in collect_bounded(words, "words of a filter", MAX_LEVEL_BYTES // 4):
        filled[row["word"]] = row["value"]
    # a foldable text: the optimizer turns it into one constant array
    return Level(level, hashes, bits, F.from_json(F.lit(json.dumps(filled)), "array<bigint>"))


def cascade(keys: DataFrame, max_levels: int = 64) -> list[Level]:
    """The levels for ``keys``: (key, listed), every key once.  Each further level holds about half of the one two before."""
    totals = keys.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("other")).first()
    if not totals["listed"]:
        return []
    rate = min(0.5, totals["listed"] * math.sqrt(0.5) / max(1, totals["other"]))
    levels = [_build(keys.where("listed"), 1, totals["listed"], rate)]
    # the listed keys and the few others that level 1 lets through
    left = written(keys.where(F.col("listed") | levels[0].lets_through(F.col("key"))), "filter-keys")
    while len(levels) < max_levels:
        wanted = F.col("listed") if len(levels) % 2 == 0 else ~F.col("listed")
        passed = left
        for level in levels:  # a key stays in play as long as every level lets it through
            passed = passed.where((level.lets_through(F.col("key"))) | (F.col("listed") if level.number % 2 else ~F.col("listed")))
        inside = passed.where(wanted)
        count = inside.count()
        if not count:
            return levels
        levels.append(_build(inside, len(levels) + 1, count, 0.5))
    raise RuntimeError("the cascade did not end")


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed (null: no)."""
    if not levels:
        return F.lit(False)
    found = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        found = F.when(level.lets_through(key), found).otherwise(level.number % 2 == 0)
    return F.coalesce(F.when(key.isNotNull(), found), F.lit(False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of the rule shapes (labels of the host, length of the path) that a url can match; longest first, then by text."""
    keys = [F.when((F.length(path) >= size) & (F.length(host) > 0), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size)))
            for labels, size in shapes]
    each = F.filter(F.array(*keys), lambda k: k.isNotNull())
    ranked = F.array_sort(F.transform(F.array_distinct(each), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.transform(ranked, lambda r: r["key"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` are (verdict, host, begin of the path), verdict allow or block.  A rule fits its host and all subdomains;
    of those that fit, the longest (host and path together) wins, of equally long ones the first by text, and
    a rule that is both allowed and blocked blocks.  Without a fitting rule ``rule`` is null and the verdict is ``default``.
    Null urls have empty host and path.  Columns of these four names are replaced.
    """
    spark = pages.sparkSession
    own = pages.drop("host", "path", "rule", "verdict")
    of_key = {}
    for verdict, host, path in rules:
        key = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) + path
        of_key[key] = verdict if of_key.get(key) != "block" else "block"
    host, path = host_and_path(F.col(url))
    parts = own.withColumns({"host": host, "path": path})
    if not of_key:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = parts.select(F.explode(keys).alias("key")).groupBy("key").agg(F.lit(False).alias("listed"))

    def levels(verdict: str) -> list[Level]:
        listed = [(k, True) for k, v in sorted(of_key.items()) if v == verdict]
        if not listed:
            return []
        named = spark.createDataFrame(listed, "key string, listed boolean")
        return cascade(universe.unionByName(named).groupBy("key").agg(F.max("listed").alias("listed")))

    universe = written(universe, "url-keys")
    allowed, blocked = levels("allow"), levels("block")
    judged = lambda k: F.when(is_listed(k, blocked), F.struct(k.alias("rule"), F.lit("block").alias("verdict"))) \
                        .when(is_listed(k, allowed), F.struct(k.alias("rule"), F.lit("allow").alias("verdict")))
    first = F.get(F.filter(F.transform(keys, judged), lambda j: j.isNotNull()), 0)
    return parts.withColumn("_judged", first).select(
        *parts.columns, F.col("_judged.rule").alias("rule"), F.coalesce("_judged.verdict", F.lit(default)).alias("verdict"))
