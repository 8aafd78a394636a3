"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles.  Register i holds the smallest of the shingles' hash values under function i as an exponential
variable, cut down to its power of ``BASE``: registers of a union are the larger of both, and those of similar sets agree
often.  Bands of registers bring together documents that agree in a whole band.  Within such buckets documents are first held
against the bucket's smallest and largest id, which joins large groups up at once; buckets that then still hold several
groups are compared in full, by likelihood of the registers, and documents that may hang together with another group meet once more with
their sets.  Tasks return links that join groups, never all pairs.  Every link is confirmed on the full shingle sets.  Documents with equal sets are one site from the start.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.store import written
from ballast.llm.remember import claim, hand_back
from ballast.operators.density import components

BASE, RATE, TOP = 1.1, 20.0, 254  # register values are 0..TOP + 1, one byte
BANDS, ROWS = 32, 5  # at a similarity of 0.8 a pair misses all bands with a probability of 3e-6
MARGIN = 0.15  # below the threshold by this much, an estimate from 160 registers (deviation 0.032) rules a pair out
FINE, FINE_MARGIN = 1024, 0.06  # the same for the longer sketch (deviation 0.013) that open buckets are compared by
BLOCK = 512  # documents of a bucket compared at once with as many others
REMEMBERED = 300_000  # words a worker remembers with their hashes before it starts anew; bounds memory only
STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


class Hashes(dict):
    """Hash of a word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> Hashes:
    return Hashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle; none without words.

    Words end at ASCII white space (\\x20, \\x09-\\x0D), A-Z are lower-cased.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = word_hashes()
    claim(known)
    if len(known) > REMEMBERED:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for k in range(size):
        h = (h + w[k:len(w) - size + 1 + k]) * STEP
        h ^= h >> np.uint64(29)
    return np.unique(h)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 32, FINE, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, FINE, dtype=np.uint32)


def registers(sets: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The first ``count`` registers of a set of 64-bit hashes, one byte each."""
    times, plus = (f[:count] for f in _functions())
    x = ((sets * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(times), np.uint32(0xFFFFFFFF))
    step = 256 * BANDS * ROWS // count
    for lo in range(0, len(x), step):
        np.minimum(least, (x[lo:lo + step, None] * times + plus).min(0), out=least)
    e = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(e) / math.log(BASE)), 0, TOP + 1).astype(np.uint8)


def similarity(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, step: int = 1000) -> np.ndarray:
    """Most likely Jaccard similarity, given in how many registers a lies above and below b and how large both sets are."""
    if len(above) > step:  # small tables of likelihoods, one after the other
        parts = [slice(lo, lo + step) for lo in range(0, len(above), step)]
        return np.concatenate([similarity(above[p], below[p], n_a[p], n_b[p]) for p in parts])
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    equal = BANDS * ROWS - above - below
    tiny = 1e-12
    likelihood = above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(u)), likelihood.argmax(1)]


def at_least(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Row by row of two matrices of registers: whether the most likely similarity is ``least`` or more: the likelihood, which has one top, does not fall there."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    shrink = (BASE - 1) / BASE
    x, y = u - v * least, v - u * least  # chances that a register of a lies above, and below, without ties
    possible = (x >= 0) & (y >= 0)
    x, y = np.maximum(x, 1e-9), np.maximum(y, 1e-9)
    up, down = (-np.log1p(-z * shrink) / math.log(BASE) for z in (x, y))
    up_slope, down_slope = (-w * shrink / (math.log(BASE) * (1 - z * shrink)) for w, z in ((v, x), (u, y)))
    equal = a.shape[1] - above - below
    slope = above * up_slope / up + below * down_slope / down - equal * (up_slope + down_slope) / np.maximum(1 - up - down, 1e-12)
    return possible & (slope >= 0)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (id, text and perhaps more) with n, digest and regs in the place of text; both are null without words."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hand_back()
        for batch in batches:
            rows = []
            for t in batch["text"]:
                s = shingles(t, width)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s) else (0, None, None))
            yield batch.drop(columns="text").assign(n=[r[0] for r in rows], digest=[r[1] for r in rows], regs=[r[2] for r in rows])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInPandas(sketch, f"{kept}, n long, digest binary, regs binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the full shingle sets."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hand_back()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                some = batch.iloc[lo:lo + 256]
                yield pd.DataFrame({"id": some["id"], "hashes": [shingles(t, width).view(np.int64) for t in some["text"]]})

    return docs.select("id", "text").mapInPandas(build, f"id {docs.schema['id'].dataType.simpleString()}, hashes array<long>")


def _alike(n_a, n_b):
    """Whether sizes allow the similarity at all; for columns and arrays."""
    return (n_a * 100 >= n_b * 80) & (n_b * 100 >= n_a * 80)


def _matrix(regs: pd.Series, count: int = BANDS * ROWS) -> np.ndarray:
    return np.frombuffer(b"".join(regs), np.uint8).reshape(-1, count)


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(id, n, regs) with the longer sketch."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n": [len(h) for h in batch["hashes"]],
                                "regs": [registers(np.asarray(h, np.int64).view(np.uint64), FINE).tobytes() for h in batch["hashes"]]})

    return sets.select("id", "hashes").mapInPandas(build, f"id {sets.schema['id'].dataType.simpleString()}, n long, regs binary")


def likely(pairs: DataFrame, sites: DataFrame, least: float) -> DataFrame:
    """Those (a, b) whose registers make a similarity of ``least`` likely."""
    side = lambda x: sites.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    @F.pandas_udf("boolean")
    def near(regs_a: pd.Series, regs_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        a, b = _matrix(regs_a), _matrix(regs_b)
        return pd.Series(at_least(a, b, n_a.to_numpy(float), n_b.to_numpy(float), least))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(near("regs_a", "regs_b", "n_a", "n_b")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) with 100 * intersection >= percent * union, on the full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a") \
                .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sizes")) \
               .where(F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent).select("a", "b")


def _by_task(batches: Iterator[pd.DataFrame], work) -> Iterator[pd.DataFrame]:
    """``work(rows)`` of rows that come sorted by task; a task may go on in the next batch."""
    hand_back()
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = rows["task"].to_numpy() == rows["task"].iat[-1] if len(rows) else np.zeros(0, bool)
        rest = rows[last]
        if not last.all():
            yield work(rows[~last].reset_index(drop=True))
    if rest is not None and len(rest):
        yield work(rest.reset_index(drop=True))


def _sides(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Per task the rows to be compared: of two blocks both sides, or one block within itself (then None)."""
    key, side = rows["task"].to_numpy(), rows["side"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        s = side[lo:hi]
        if s.any() and not s.all():
            yield np.flatnonzero(s == 0) + lo, np.flatnonzero(s == 1) + lo
        elif rows["alone"].iat[lo]:
            yield np.arange(lo, hi), None


def _open_rows(batches: Iterator[pd.DataFrame], goal: float) -> Iterator[pd.DataFrame]:
    """(task, side, alone, id) of the documents that a task may link to another group, by likelihood of their registers."""

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        regs, few, n, group = _matrix(rows["regs"], FINE), BANDS * ROWS, rows["n"].to_numpy(float), rows["component"].to_numpy()
        left, right, held, wanted = [], [], 0, np.zeros(len(rows), bool)

        def judge() -> None:
            i, j = np.concatenate(left), np.concatenate(right)
            left.clear()
            right.clear()
            for lo in range(0, len(i), 5000):
                p, q = i[lo:lo + 5000], j[lo:lo + 5000]
                hit = at_least(regs[p, :few], regs[q, :few], n[p], n[q], goal - MARGIN)
                p, q = p[hit], q[hit]
                hit = at_least(regs[p], regs[q], n[p], n[q], goal - FINE_MARGIN)
                wanted[p[hit]] = True
                wanted[q[hit]] = True

        for a, b in _sides(rows):
            if b is None:
                i, j = (a[x] for x in np.triu_indices(len(a), 1))
            else:
                i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
            keep = (group[i] != group[j]) & _alike(n[i], n[j])
            left.append(i[keep])
            right.append(j[keep])
            held += int(keep.sum())
            if held > 50_000:
                judge()
                held = 0
        if left:
            judge()
        return rows.loc[wanted, ["task", "side", "alone", "id"]]

    yield from _by_task(batches, compared)


def shared_counts(sets: list[np.ndarray], columns: int = 65_536) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a matrix."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number, who = (np.cumsum(several) - 1)[number[several[number]]], who[several[number]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(number, kind="stable")
    number, who = number[order], who[order]
    for lo in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(number, [lo, lo + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[who[a:b], number[a:b] - lo] = 1.0
        out += (held @ held.T).astype(np.int64)
    return out


def _spanning(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links (a, b) between groups, confirmed on full sets: no more than join a task's groups, so fewer than its rows."""

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in _sides(rows):
            at = a if b is None else np.r_[a, b]
            sets, group = [np.asarray(h, np.int64) for h in rows["hashes"].iloc[at]], rows["component"].to_numpy()[at]
            both, n = shared_counts(sets), np.array([len(s) for s in sets])
            near = both * 100 >= (n[:, None] + n[None, :] - both) * percent
            root = {g: g for g in group.tolist()}

            def find(g):
                while root[g] != g:
                    root[g] = root[root[g]]
                    g = root[g]
                return g

            names, code = np.unique(group, return_inverse=True)  # pairs of groups, each once
            i, j = np.nonzero(np.triu(near & (group[:, None] != group[None, :]), 1))
            for x, y in np.unique(np.stack([np.minimum(code[i], code[j]), np.maximum(code[i], code[j])], 1), axis=0).tolist():
                p, q = find(names[x]), find(names[y])
                if p != q:
                    root[p] = q
                    out.append((names[x], names[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    yield from _by_task(batches, linked)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 4, text: str = "text", id_col: str = "doc_id", row: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row, and the column ``row`` if one is named.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets; a component is named by its smallest
    id.  Texts without words (null, empty, blanks) have no shingles and link with nothing.  Rows with a null id link with
    nothing and are kept.  Rows with one id are one document, linked where one of its texts is.
    An empty table gives an empty table; other columns are left aside.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), *([F.col(row).alias("_row")] if row else []))
    sketched = written(sketches(known, width), "sketches")
    sites = written(sketched.where("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "n", "regs")).alias("s"))
                    .select("digest", "s.*").withColumn("site", F.col("id")), "sites")

    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", ROWS * i + 1, ROWS)) for i in range(BANDS)])
    banded = written(sites.select("id", "n", F.explode(bands).alias("bucket")), "bands")
    ends = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low <> high")
    members = written(banded.join(ends, "bucket"), "members")

    wanted = members.select("id").distinct()
    texts = known.select("id", "text").join(wanted, "id")
    if not sketched.groupBy("id").count().where("count > 1").isEmpty():  # repeated rows would only repeat the work
        texts = texts.dropDuplicates()
    sets = written(shingle_sets(texts, width), "sets")

    to_ends = members.select("id", F.explode(F.array("low", "high")).alias("end")).where("id <> end")
    stars = written(to_ends.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct(), "pairs")
    links = written(confirmed(written(likely(stars, sites, percent / 100 - MARGIN), "likely"), sets, percent), "links")
    first = components(links)

    grouped = members.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    grouped = written(grouped.select("bucket", "id", "component"), "grouped")
    several = grouped.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")) \
        .where("low <> high").select("bucket", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(
        F.xxhash64("bucket", F.least(j, own), F.greatest(j, own)).alias("task"), (own > j).cast("int").alias("side"), (j == own).alias("alone")))
    still = written(grouped.join(several, "bucket"), "open-buckets")
    fine = written(fine_sketches(sets.join(still.select("id").distinct(), "id")), "fine-sketches")
    dealt = still.withColumn("t", F.explode(tasks)).select("id", "component", "t.*").join(fine, "id")
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    wanted = written(dealt.mapInPandas(lambda it: _open_rows(it, percent / 100), f"task long, side int, alone boolean, id {kind}"), "open-rows")

    # what these add joins up whole components: a graph of few nodes
    component = wanted.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = component.join(sets, "id").select("task", "side", "alone", "component", "hashes").repartition("task").sortWithinPartitions("task")
    more = rows.mapInPandas(lambda it: _spanning(it, percent), f"a {kind}, b {kind}")
    second = components(more).select(F.col("node").alias("component"), F.col("component").alias("last"))
    named = sites.select("digest", "site").join(first.withColumnRenamed("node", "site"), "site", "left") \
        .select("digest", F.coalesce("component", "site").alias("component")).join(second, "component", "left") \
        .select("digest", F.coalesce("last", "component").alias("component"))
    own_row = [F.col("_row").alias(row)] if row else []
    out = sketched.drop("regs").join(written(named, "components"), "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id")).alias("component_id"), *own_row)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, width: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay: of every component the one with the smallest id, once, with its own columns.

    Documents without words stay, and so do rows with a null id; of rows that repeat an id one stays.
    """
    numbered = written(docs.withColumn("_dedup_row", F.monotonically_increasing_id()), "dedup-docs")
    found = near_duplicates(numbered, percent, width, text, id_col, row="_dedup_row").where("kept")
    unnamed = found.where(F.col(id_col).isNull()).select("_dedup_row")
    stay = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("_dedup_row").alias("_dedup_row")).select("_dedup_row")
    return numbered.join(stay.unionByName(unnamed), "_dedup_row").select(*docs.columns)
