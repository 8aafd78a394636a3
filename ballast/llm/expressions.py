"""Expressions of two and three words that are likelier in toxic texts, by class-conditional Kneser-Ney models of word sequences.

A class predicts a word from the one or two words before it.  It discounts its own counts and gives the rest to a backoff that both
classes share: in how many different places the end of the expression has been seen, relative to how often it could have been (all
words, or those after the middle word).  What is kept of an expression is its log-likelihood ratio.

An expression counts as evidence if at least ``ROWS`` toxic training rows hold it, in a share ``LIFT`` times that of the other rows, and
its ratio is at least ``RATIO``.  These bounds are part of the model; no table is cut to a size.  Expressions are known by 64 bits
of hash.  Tasks look them up in a bit map of fixed size first, and what passes it is joined to the tables: the map saves
shuffles and changes no result.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.store import discard, scope, written
from ballast.llm.remember import claim

ROWS = 3
LIFT = 3.0
RATIO = 1.0
DISCOUNT = 0.75
SLOTS = 1 << 24  # bits of the map that tasks look into
MEMO = 200_000  # words whose hashes a task remembers
AFTER, BEFORE, ALL = 1, 2, 0  # marks of keys: what follows some words, what precedes them, all words
FRESH = 500_000  # rows that a task gathers before it adds them up
HELD = 2_000_000  # added-up rows that a task holds before it hands them on; both bound memory only
_BATCH = 512  # texts


class _Remembered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


class Codes:
    """64 bits a word, remembered within bounds."""

    def __init__(self):
        self.known = _Remembered()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > MEMO:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def chained(a: np.ndarray, b) -> np.ndarray:
    """The hash of what ``a`` stands for followed by ``b``."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pairs_and_triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = chained(codes[:-1], codes[1:])
    return two, chained(two[:-1], codes[2:]) if len(two) else two


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_map(keys: DataFrame, name: str) -> np.ndarray:
    """A bit map of a column of hashes; the driver sees its set slots, at most ``SLOTS`` of them."""
    slots = keys.select(F.col(name).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)
    bits = np.zeros(SLOTS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little")


def _summed(parts: list[pd.DataFrame], by: tuple[str, ...]) -> pd.DataFrame:
    """Rows with equal keys ``by`` added up; ``parts`` is emptied, so that no row is held twice.

    Rows are brought together by a mix of their keys; should two keys share one, their rows may stay apart.
    """
    names = list(parts[0].columns)
    columns = {c: np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in names}
    parts.clear()
    mixed = np.zeros(len(columns[by[0]]), np.uint64)
    for c in by:
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + columns[c].view(np.uint64)
    order = np.argsort(mixed)
    del mixed
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in by:
        columns[c] = columns[c][order]
        new[1:] |= columns[c][1:] != columns[c][:-1]
    first = np.flatnonzero(new)
    for c in names:
        columns[c] = columns[c][first] if c in by else np.add.reduceat(columns[c][order], first) if len(first) else columns[c]
    return pd.DataFrame(columns, copy=False)


def _scan(rows: DataFrame, split: Callable, work: Callable[[list[np.ndarray], pd.DataFrame], pd.DataFrame], schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``work`` on the hashed words of every some texts; with ``by`` its rows are added up as far as a task can hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        codes, fresh, held, size = Codes(), [], [], 0
        for whole in batches:
            for lo in range(0, len(whole), _BATCH):
                batch = whole.iloc[lo:lo + _BATCH]
                out = work([codes.of(split(t)) for t in batch["text"]], batch)
                if not by:
                    if len(out):
                        yield out
                    continue
                fresh.append(out)
                size += len(out)
                if size > FRESH:
                    held.append(_summed(fresh, by))
                    size = 0
                    if sum(map(len, held)) > HELD:
                        held = [_summed(held, by)]
                        if len(held[0]) > HELD / 2:
                            yield held.pop()
        held += fresh
        fresh.clear()
        if held:
            yield _summed(held, by)

    return rows.mapInPandas(run, schema)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _rows_with(rows: DataFrame, split: Callable, bits=None) -> DataFrame:
    """(h, n): in how many rows an expression occurs; with a map, of those that pass it."""

    def work(texts, batch):
        found = [np.unique(np.concatenate(pairs_and_triples(c))) for c in texts]
        hashes = _joined(found)
        if bits is not None:
            hashes = hashes[passing(hashes, bits.value)]
        h, n = np.unique(hashes, return_counts=True)
        return pd.DataFrame({"h": h.view(np.int64), "n": n})

    return _scan(rows, split, work, "h long, n long", ("h",)).groupBy("h").agg(F.sum("n").alias("n"))


def _parts(rows: DataFrame, split: Callable, bits) -> DataFrame:
    """(h, size, context, word, ending, middle) of the expressions that pass the map."""

    def work(texts, batch):
        out = []
        for c in texts:
            two, three = pairs_and_triples(c)
            for size, h, context, ending in ((2, two, c[:-1], c[1:]), (3, three, two[:-1], two[1:])):
                at = np.flatnonzero(passing(h, bits.value))
                out.append(np.stack([h[at], np.full(len(at), size, np.uint64), context[at], c[at + size - 1], ending[at], c[at + 1]], 1))
        found = np.unique(np.concatenate(out), axis=0).view(np.int64) if out else np.zeros((0, 6), np.int64)
        return pd.DataFrame(found, columns=["h", "size", "context", "word", "ending", "middle"])

    return _scan(rows, split, work, "h long, size long, context long, word long, ending long, middle long").dropDuplicates(["h"])


def _neighbours(rows: DataFrame, split: Callable, bits) -> DataFrame:
    """(k, m, toxic, plain): how often the words m come after or before the words of key k, for the keys that pass the map;
    key ``ALL`` counts all words."""

    after, before = np.uint64(AFTER), np.uint64(BEFORE)

    def work(texts, batch):
        ks, ms, ys = [], [], []
        for c, toxic in zip(texts, batch["toxic"]):
            two, _ = pairs_and_triples(c)
            for key, member in ((chained(c[:-1], after), c[1:]), (chained(two[:-1], after), c[2:]), (chained(c[1:], before), c[:-1]), (chained(two[1:], before), c[:-2])):
                at = passing(key, bits.value)
                ks.append(key[at])
                ms.append(member[at])
                ys.append(np.full(int(at.sum()), bool(toxic)))
        sizes = [(len(c), bool(t)) for c, t in zip(texts, batch["toxic"])]
        y = np.concatenate(ys)
        seen = pd.DataFrame({"k": _joined(ks).view(np.int64), "m": _joined(ms).view(np.int64), "toxic": y.astype(np.int64), "plain": (~y).astype(np.int64)})
        total = pd.DataFrame({"k": [ALL], "m": [0], "toxic": [sum(n for n, t in sizes if t)], "plain": [sum(n for n, t in sizes if not t)]})
        return pd.concat([seen, total])

    return _scan(rows, split, work, "k long, m long, toxic long, plain long", ("k", "m"))


def _key(hashes: pd.Series, mark: int) -> np.ndarray:
    return chained(hashes.to_numpy(np.int64).view(np.uint64), np.uint64(mark)).view(np.int64)


def _keyed(parts: DataFrame) -> DataFrame:
    """``parts`` with the keys of its context, ending and middle word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(k_context=_key(b["context"], AFTER), k_ending=_key(b["ending"], BEFORE), k_middle=_key(b["middle"], AFTER))

    fields = ", ".join(f"{c} long" for c in [*parts.columns, "k_context", "k_ending", "k_middle"])
    return parts.mapInPandas(run, fields)


def toxic_expressions(rows: DataFrame, split: Callable[[str | None], list[bytes]]) -> DataFrame:
    """(h, r) of the expressions that tell toxic rows of ``rows`` (text, toxic) from the others; empty without toxic rows.

    The tables on the way are dropped as soon as the result is written.
    """
    with scope("expressions"):
        found = _toxic_expressions(rows, split)
    found = written(found, "expression-ratios")
    discard(rows.sparkSession, "expressions")
    return found


def _toxic_expressions(rows: DataFrame, split: Callable[[str | None], list[bytes]]) -> DataFrame:
    spark = rows.sparkSession
    toxic, plain = rows.where("toxic = 1").select("text"), rows.where("toxic = 0").select("text")
    share = lambda bits: spark.sparkContext.broadcast(bits)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    often = written(_rows_with(toxic, split).where(F.col("n") >= ROWS), "expressions")
    other = _rows_with(plain, split, share(bit_map(often, "h"))).withColumnRenamed("n", "others")
    worth = F.col("n") / F.lit(float(max(1, sizes.get(1, 0)))) >= LIFT * F.coalesce("others", F.lit(0)) / F.lit(float(max(1, sizes.get(0, 0))))
    kept = written(often.join(other.hint("merge"), "h", "left").where(worth).select("h"), "expressions")
    parts = written(_keyed(_parts(toxic, split, share(bit_map(kept, "h"))).join(kept.hint("merge"), "h", "left_semi")), "expression-parts")
    keys = parts.select(F.explode(F.array("k_context", "k_ending", "k_middle", F.lit(ALL).cast("long"))).alias("k")).distinct()
    keys = written(keys, "expression-keys")
    asked = parts.select(F.col("k_context").alias("k"), F.col("word").alias("m"), F.lit(True).alias("asked")).distinct()
    seen = _neighbours(rows, split, share(bit_map(keys, "k"))).groupBy("k", "m").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    # the large table is dealt out once, by (k, m); of it only sums and the counts that the expressions ask for are kept
    sums = seen.join(asked.hint("merge"), ["k", "m"], "left").groupBy("k").agg(
        F.collect_list(F.when(F.col("asked"), F.struct("m", "toxic", "plain"))).alias("own"),
        *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "plain")], *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "plain")],
        F.count(F.lit(1)).alias("kinds"))
    sums = written(sums.join(keys.hint("merge"), "k", "left_semi"), "expression-sums")
    words = sums.where(F.col("k") == ALL).agg(F.sum(F.col("toxic_all") + F.col("plain_all"))).first()[0] or 1
    ending = sums.select(F.col("k").alias("k_ending"), F.col("kinds").alias("places"))
    middle = sums.select(F.col("k").alias("k_middle"), (F.col("toxic_all") + F.col("plain_all")).alias("chances"))
    context = sums.select(F.col("k").alias("k_context"), *[f"{c}_{x}" for c in ("toxic", "plain") for x in ("all", "kinds")])
    own = sums.select(F.col("k").alias("k_context"), F.explode("own").alias("o")).select("k_context", F.col("o.m").alias("word"), "o.toxic", "o.plain")
    told = parts.join(context, "k_context").join(own, ["k_context", "word"]).join(ending, "k_ending").join(middle, "k_middle", "left")
    told = told.withColumn("q", F.col("places") / F.when(F.col("size") == 2, F.lit(float(words))).otherwise(F.col("chances")))

    def p(c: str) -> Column:
        total = F.col(f"{c}_all")
        return F.when(total > 0, (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_kinds") * F.col("q")) / total).otherwise(F.col("q"))

    return told.select("h", (F.log(p("toxic")) - F.log(p("plain"))).alias("r")).where(F.col("r") >= RATIO)
