"""K-means for many numbers of clusters at once: shared seeds, one pass over the rows a round for all of them.

Points lie in leaves of near neighbours, see :func:`packed`.  A leaf whose box is nearer to one centre than to any other goes to it as a whole, by its
moments, which are added up once; only where boxes lie across a border between clusters are points looked at one by one.  So the fit is that of Lloyd's rounds over all points.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions.bounds import collect_bounded
from ballast.functions.draws import DRAW_RANGE, HEX_DIGITS
from ballast.functions.store import spread, written
from ballast.functions.sums import array_sums

SEED_ROUNDS = 5      # rounds of drawing candidates for the first centres
MAX_GROUPS = 1000    # groups fitted side by side
LEAF = 64            # points of a leaf
CHUNK_NUMBERS = 1 << 21  # numbers that a task holds to cut them into leaves
SORTED = 3           # dimensions by which points are dealt to the tasks that cut them
LEAVES = 512         # leaves looked at together
BATCH_NUMBERS = 1 << 18  # numbers of the largest array of a piece, so that it stays near the processor


@dataclass
class Seeds:
    """What a group of rows begins with: its size, moments, and weighted candidates for centres."""

    n: float
    mean: np.ndarray
    var: np.ndarray
    points: np.ndarray
    weights: np.ndarray

    def centres(self, k: int, seed: int, tries: int = 4) -> np.ndarray:
        """k spread-out centres: the best of some k-means++ starts, settled on the weighted candidates alone."""
        best = None
        for t in range(tries):
            rng = np.random.default_rng([seed, k, t])
            c = self.points[[rng.choice(len(self.points), p=self.weights / self.weights.sum())]]
            for _ in range(k - 1):
                far = self.weights * squares(self.points, c).min(1)
                p = far if far.sum() > 0 else self.weights
                c = np.vstack([c, self.points[rng.choice(len(self.points), p=p / p.sum())]])
            for _ in range(10):
                hit = (squares(self.points, c).argmin(1)[:, None] == np.arange(k)) * self.weights[:, None]
                size = hit.sum(0)
                c = np.where(size[:, None] > 0, hit.T @ self.points / np.maximum(size, 1e-300)[:, None], c)
            cost = float((self.weights * squares(self.points, c).min(1)).sum())
            if best is None or cost < best[0]:
                best = cost, c
        return best[1]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, around a common middle so that far origins cost no digits."""
    middle = c.mean(0)
    x, c = x - middle, c - middle
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0.0)


def matrices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, vectors, weights, places in the batch) in pieces whose arrays of ``width`` numbers a row stay small."""
    step = max(64, BATCH_NUMBERS // max(width, 1))
    for batch in batches:
        if not len(batch):
            continue
        coded = batch.column("g").dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        every = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        w = batch.column("w").to_numpy(zero_copy_only=False)
        for i, name in enumerate(names):
            places = np.flatnonzero(of == i)
            for lo in range(0, len(places), step):
                piece = places[lo:lo + step]
                yield name, every[piece], w[piece], piece


def weighted_points(df: DataFrame, features: str, group: str | None = None) -> DataFrame:
    """(g, x, w): the distinct vectors of each group with their rows, so that a vector held by a third of the rows is one row."""
    g = F.col(group).cast("string") if group else F.lit("all")
    pairs = df.select(g.alias("g"), F.transform(features, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    return spread(written(pairs.groupBy("g", "x").agg(F.count(F.lit(1)).cast("double").alias("w")), "points"))


def _cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` of the points of each leaf, by halving along the widest side, and which of them count; the others fill up the ``LEAF`` places."""
    n = len(x)
    depth = max(0, math.ceil(math.log2(n / LEAF)))
    order = np.arange(math.ceil(n / (1 << depth)) << depth)[None, :]
    part = x[np.minimum(order, n - 1)]
    for _ in range(depth):
        wide = (part.max(1) - part.min(1)).argmax(1)
        half = order.shape[1] // 2
        split = np.argpartition(np.take_along_axis(part, wide[:, None, None], 2)[:, :, 0], half, axis=1)
        order = np.take_along_axis(order, split, 1).reshape(-1, half)
        part = np.take_along_axis(part, split[:, :, None], 1).reshape(-1, half, x.shape[1])
    fill = np.arange(LEAF) % order.shape[1]
    return np.minimum(order, n - 1)[:, fill], (order < n)[:, fill] & (np.arange(LEAF) < order.shape[1])


def packed(points: DataFrame) -> DataFrame:
    """(g, x, w, h, s): the points of :func:`weighted_points` in leaves of at most ``LEAF`` neighbours, their vectors and weights as bytes, hashes for draws, and
    what a round needs of a leaf that goes to a centre as a whole, see :func:`_summary`.

    Tasks hold ranges of the first dimensions, about as many points as are cut at once, so that a leaf is the smaller the more points there are.
    Empty places have weight 0.  How points are dealt to leaves changes no result.
    """
    one = points.first()
    dims = len(one["x"]) if one else 0
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() * dims / CHUNK_NUMBERS))
    laid = points.select("g", "x", "w", F.xxhash64("x").alias("h")).repartitionByRange(tasks, F.xxhash64("g"), *[F.col("x")[i] for i in range(min(dims, SORTED))])

    def told(name: str, held: list) -> Iterable[pa.RecordBatch]:
        x, w, h = (np.concatenate(v) for v in zip(*held))
        order, real = _cut(x)
        order, real = order[real.any(1)], real[real.any(1)]
        for lo in range(0, len(order), 8 * LEAVES):
            at = order[lo:lo + 8 * LEAVES]
            xs, ws = x[at], np.where(real[lo:lo + 8 * LEAVES], w[at], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *[pa.array([v.tobytes() for v in part], pa.binary()) for part in (xs, ws, h[at], _summary(xs, ws))]],
                                             names=["g", "x", "w", "h", "s"])

    def pack(batches):
        held, size = {}, 0
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            for name, x, w, places in matrices([batch], 1):
                held.setdefault(name, []).append((x, w, h[places]))
                size += x.size
            if size >= CHUNK_NUMBERS:
                for name in held:
                    yield from told(name, held[name])
                held, size = {}, 0
        for name in held:
            yield from told(name, held[name])

    # a vector's hash is its place in the draws; equal vectors of a group are one point
    return written(laid.mapInArrow(pack, "g STRING, x BINARY, w BINARY, h BINARY, s BINARY"), "leaves")


def _numbers(column: pa.Array, kind=np.float64) -> np.ndarray:
    """The numbers of a column of byte strings of one length, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _draws(purpose: str, group: str, hashes: np.ndarray, seed: int) -> np.ndarray:
    """What :func:`~ballast.functions.draws.uniform` draws for (group, hash); it takes a fraction of the time here."""
    begin, out = hashlib.md5(f"{seed}|{purpose}|{group}|".encode()), []
    for h in hashes.ravel().tolist():
        own = begin.copy()
        own.update(b"%d" % h)
        out.append(own.digest()[:8])
    bits = np.frombuffer(b"".join(out), ">u8") >> np.uint64(64 - 4 * HEX_DIGITS)
    return (bits.astype(float) / DRAW_RANGE).reshape(hashes.shape)


def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, vectors of each leaf, their weights, places of the leaves in the batch), some leaves at a time."""
    for batch in batches:
        if not len(batch):
            continue
        coded = batch.column("g").dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        for i, name in enumerate(names):
            places = np.flatnonzero(of == i)
            for lo in range(0, len(places), LEAVES):
                piece = places[lo:lo + LEAVES]
                some = batch.take(pa.array(piece))
                yield name, _numbers(some.column("x")).reshape(len(piece), LEAF, -1), _numbers(some.column("w")), piece


def _box(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles of the leaves' boxes, and half their sides."""
    low, high = np.fmin.reduce(x, axis=1), np.fmax.reduce(x, axis=1)
    return np.nan_to_num((low + high) / 2), np.nan_to_num((high - low) / 2)


def _summary(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A row for every leaf: its weight, the squares about its mean, the mean, the middle of its box and half its sides."""
    box, half = _box(x)
    total = w.sum(1)
    mean = x[:, 0] + ((x - x[:, :1]) * w[:, :, None]).sum(1) / total[:, None]
    inner = (((x - mean[:, None]) ** 2).sum(2) * w).sum(1)
    return np.column_stack([total, inner, mean, box, half])


def _nearest_of(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance to the nearest of ``c``, its number; the smaller on ties) of every point of the leaves ``x``."""
    middle, half = _box(x)
    away = np.sqrt(squares(middle, c))
    reach = away.min(1) + 2 * np.sqrt((half * half).sum(1)) + 1e-6 * away.max(1)  # slack far above the rounding
    counts = (away <= reach[:, None]).sum(1)
    best, own = np.empty(x.shape[:2]), np.empty(x.shape[:2], np.int64)
    turn, lo = np.argsort(counts, kind="stable"), 0
    while lo < len(x):
        many = counts[turn[lo:]]
        hi = lo + max(1, int(np.searchsorted(-BATCH_NUMBERS / (many * LEAF * np.arange(1, len(many) + 1)), -1.0, side="right")))
        at, m = turn[lo:hi], int(counts[turn[hi - 1]])
        some = np.sort(np.argpartition(away[at], m - 1, axis=1)[:, :m], axis=1)
        y, z = x[at] - middle[at, None], c[some] - middle[at, None]
        d = (y * y).sum(2)[:, :, None] - 2 * y @ z.transpose(0, 2, 1) + (z * z).sum(2)[:, None, :]
        j = d.argmin(2)
        best[at] = np.maximum(np.take_along_axis(d, j[:, :, None], 2)[:, :, 0], 0.0)
        own[at] = np.take_along_axis(some, j, 1)
        lo = hi
    return best, own


def seeds_of(points: DataFrame, most: int, seed: int = 42, packs: DataFrame | None = None) -> dict[str, Seeds]:
    """Seeds of each group for up to ``most`` centres.

    Each round reads the points once and draws 2 ``most`` of each group without replacement, by
    odds of weight times squared distance from the candidates so far (least exponential keys
    over these odds).  The first round draws one point by weight.  Draws are hashes of group and vector.
    """
    names = [r["g"] for r in collect_bounded(points.select("g").distinct(), "groups", MAX_GROUPS)]
    packs = packed(points) if packs is None else packs
    drawn: dict[str, np.ndarray] = {}
    for r in range(SEED_ROUNDS + 1):
        many = 2 * most if r else 1

        def draw(batches, sofar=dict(drawn), many=many, purpose=f"kmeans.{r}"):
            kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                hashes = _numbers(batch.column("h"), np.int64)
                for name, x, w, places in leaves([batch]):
                    odds = w * _nearest_of(x, sofar[name])[0] if name in sofar else w
                    far = odds > (1e-12 * w * np.abs(x).max(2) ** 2 if name in sofar else 0)
                    keys, x = -np.log(np.maximum(_draws(purpose, name, hashes[places][far], seed), 1e-18)) / odds[far], x[far]
                    if name in kept:
                        less = keys <= kept[name][0][-1] if len(kept[name][0]) == many else slice(None)
                        keys, x = np.concatenate([kept[name][0], keys[less]]), np.vstack([kept[name][1], x[less]])
                    least = np.argsort(keys, kind="stable")[:many]
                    kept[name] = keys[least], x[least]
            for name, (keys, x) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(x.tolist(), pa.list_(pa.float64())),
                                                  pa.array(keys, pa.float64())], names=["g", "x", "key"])

        best = W.partitionBy("g").orderBy("key", "x")
        found = packs.mapInArrow(draw, "g STRING, x ARRAY<DOUBLE>, key DOUBLE") \
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= many)
        for row in sorted(collect_bounded(found, "seeds", many * len(names)), key=lambda v: (v["g"], v["rank"])):
            x = np.array([row["x"]], dtype=float)
            drawn[row["g"]] = np.vstack([drawn[row["g"]], x]) if row["g"] in drawn else x

    number = {name: i for i, name in enumerate(names)}

    def near(batches):
        sums: dict[int, np.ndarray] = {}
        for name, x, w, _ in leaves(batches):
            c, i = drawn[name], number[name]
            own, y, w = _nearest_of(x, c)[1].ravel(), x.reshape(-1, x.shape[2]) - c[0], w.ravel()
            part = np.concatenate([np.bincount(own, w, len(c)), w @ y, w @ (y * y)])
            sums[i] = sums[i] + part if i in sums else part
        return sums

    sums = array_sums(packs.select("g", "x", "w"), near)
    out = {}
    for name, i in number.items():
        c = drawn[name]
        weights, first, second = np.split(sums[i], [len(c), len(c) + c.shape[1]])
        n = weights.sum()
        out[name] = Seeds(float(n), first / n + c[0], np.maximum(second / n - (first / n) ** 2, 0.0), c, weights)
    return out


def fit_all(points: DataFrame, seeds: Seeds, ks, seed: int = 42, rounds: int = 20, tol: float = 1e-4,
            packs: DataFrame | None = None) -> dict[int, tuple[np.ndarray, float]]:
    """{k: (centres, squares within)} by Lloyd's rounds, all k in one pass and one aggregation a round.

    A k stops when no centre moves further than ``tol``, or after ``rounds``.  Rows belong to the
    nearest of the centres returned; the squares are those about the means of the rows so
    dealt, so the labels give them again.  A centre that loses all its rows stays where it is.
    """
    packs = (packed(points) if packs is None else packs).drop("g", "h")
    centres = {k: seeds.centres(k, seed) for k in ks}
    moving, out = set(centres), {}
    for turn in range(rounds):
        active = {k: centres[k] for k in sorted(moving)}
        first = np.cumsum([0, *active])  # where each k's centres begin among all of them
        stacked = np.vstack(list(active.values()))
        every, dims = stacked.shape
        middle = stacked.mean(0)
        turned, length = -2 * (stacked - middle).T, ((stacked - middle) ** 2).sum(1)

        def moments(batches):
            cost, size, shift = np.zeros(len(active)), np.zeros(every), np.zeros((dims, every))
            between = {k: np.abs(c[:, None] - c[None]) for k, c in active.items()}

            def deal(i, lo, hi, own, w, apart, squared):
                cost[i] += squared.sum()
                size[lo:hi] += np.bincount(own, w, hi - lo)
                for j in range(dims):
                    shift[j, lo:hi] += np.bincount(own, apart[:, j] * w, hi - lo)

            step = max(64, min(4 * LEAVES, (1 << 22) // (LEAF * dims)))
            for some in (batch.slice(lo, step) for batch in batches for lo in range(0, len(batch), step)):
                total, inner, mean, box, half = np.split(_numbers(some.column("s")), [1, 2, 2 + dims, 2 + 2 * dims], axis=1)
                total, inner = total[:, 0], inner[:, 0]
                away = (box - middle) @ turned + length
                slack = 1e-11 * (((box - middle) ** 2).sum(1) + length.max())
                owners, border = [], []
                for i, (k, c) in enumerate(active.items()):
                    lo, hi = first[i], first[i + 1]
                    own = away[:, lo:hi].argmin(1)
                    gap = away[:, lo:hi] - np.take_along_axis(away[:, lo:hi], own[:, None], 1)
                    # no point of the box is nearer to another centre
                    whole = gap > 2 * np.einsum("nkd,nd->nk", between[k][own], half) + slack[:, None]
                    whole[np.arange(len(own)), own] = True
                    owners.append(own)
                    border.append(~(whole.all(1) & np.isfinite(inner)))
                looked = np.flatnonzero(np.any(border, axis=0))  # leaves whose points are looked at for some k
                x = _numbers(some.column("x").take(pa.array(looked))).reshape(len(looked), LEAF, dims) if len(looked) else np.zeros((0, LEAF, dims))
                w = _numbers(some.column("w").take(pa.array(looked))) if len(looked) else np.zeros((0, LEAF))
                for i, (k, c) in enumerate(active.items()):
                    lo, hi, own, whole = first[i], first[i + 1], owners[i], ~border[i]
                    apart = mean[whole] - c[own[whole]]  # sums about the centres keep the digits that sums about zero lose
                    deal(i, lo, hi, own[whole], total[whole], apart, inner[whole] + total[whole] * (apart * apart).sum(1))
                    mine = border[i][looked]
                    if mine.any():
                        each, weight = x[mine].reshape(-1, dims), w[mine].ravel()
                        own = ((each - middle) @ turned[:, lo:hi] + length[lo:hi]).argmin(1)
                        apart = each - c[own]
                        deal(i, lo, hi, own, weight, apart, weight * (apart * apart).sum(1))
            return {0: np.concatenate([cost, size, shift.ravel()])}

        total = array_sums(packs, moments)[0]
        costs, sizes, shifts = np.split(total, [len(active), len(active) + every])
        for i, (k, c) in enumerate(active.items()):
            mine = slice(first[i], first[i + 1])
            cost, size, shift = costs[i], sizes[mine], shifts.reshape(dims, every)[:, mine].T
            step = shift / np.maximum(size, 1e-300)[:, None]
            step[size == 0] = 0.0
            moved = (step * step).sum(1)
            out[k] = c, float(max(cost - (size * moved).sum(), 0.0))
            if moved.max() <= tol * tol or turn == rounds - 1:
                moving.discard(k)
            else:
                centres[k] = c + step
        if not moving:
            break
    return out


def _rows(x: pd.Series) -> np.ndarray:
    return np.concatenate(x.to_numpy()).astype(float).reshape(len(x), -1)


def nearest(features: str, centres: np.ndarray) -> Column:
    """Number of the nearest centre of each row; the smaller number on ties."""

    @F.pandas_udf("int")
    def label(x: pd.Series) -> pd.Series:
        return pd.Series(squares(_rows(x), centres).argmin(1).astype(np.int32)) if len(x) else pd.Series([], dtype="int32")

    return label(F.col(features))


def nearest_of_each(features: str, fits: list[np.ndarray]) -> Column:
    """What :func:`nearest` gives for each of the fits, as one array; rows are read once for all."""

    @F.pandas_udf("array<int>")
    def label(x: pd.Series) -> pd.Series:
        out = [np.zeros((0, len(fits)), np.int32)]
        for lo in range(0, len(x), 1024):
            rows = _rows(x.iloc[lo:lo + 1024])
            out.append(np.stack([squares(rows, c).argmin(1) for c in fits], 1).astype(np.int32))
        return pd.Series(list(np.concatenate(out)), dtype=object)

    return label(F.col(features))
