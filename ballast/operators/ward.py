"""Ward's tree over all distinct points of a table, merged by reciprocal nearest neighbours in rounds.

Two clusters of n and m points whose means lie d apart merge at the cost 2 n m / (n + m) d^2.  Ward's cost is reducible: a pair of
clusters that are each other's nearest stays so until it merges, so all such pairs may merge at once, in any order, and the
tree is that of merging the cheapest pair first.

A round cuts space into boxes and merges within each, in one task a box, as long as a pair is nearer than anything
outside can come: the outside starts at the box's walls, and means of points inside never leave it, as a box is convex.  A box is halved
down to a few points; those merge first, within their own walls, and what is left of two halves merges within the walls of both, so that no step
compares more than a few clusters.  Where walls stop too many pairs, a round finds every cluster's nearest across boxes instead.  The last few
thousand clusters are merged in one task.  Rounds are written tables; the tree is a table of edges, a row for every cluster taken in by another, named by its smallest point.

Below a limit of cost t^2 the points fall into pieces that cannot meet: with all pairs of points of two clusters at least r apart, and both
made by merges below t^2, the cost between them is at least r^2 - t^2 (sum the squared distances of all pairs: they are the squares within, each
below half the merges' costs, and n m times the squared distance of means).  So points further apart than sqrt(2) t never meet, and pieces are solved apart.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import MAX_MODEL_ROWS, collect_bounded, join_model, shuffle_width
from ballast.functions.draws import uniform
from ballast.functions.store import written
from ballast.operators.density import components
from ballast.operators.neighbors import SAMPLE_PER_CELL, Cells, SiteIndex, _matrix, _squared, between, place_cells

CELL = 12_000  # clusters of a box, about
LEAF = 32     # clusters that a box is halved down to
DENSE = 3000  # clusters of two halves that are compared with each other; more are left to later rounds
PAIRS = 1 << 18  # pairs compared together, so that they stay near the processor
LAST = 3000   # clusters that one task merges to the end; also the largest piece below a limit that one task solves
STUCK = 0.8   # of the clusters left by a round within boxes, the next round looks across them
GRID_DIMS = 3  # widest dimensions that cut points into pieces

ROWS = "id BIGINT, n DOUBLE, vec ARRAY<DOUBLE>, top DOUBLE, into BIGINT, step INT, last BIGINT"


def costs(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cost of every cluster of the one side with every one of the other."""
    return 2.0 * n[:, None] * m[None, :] / (n[:, None] + m[None, :]) * _squared(x, y)


def merge_within(ids: np.ndarray, n: np.ndarray, x: np.ndarray, top: np.ndarray, room: Callable | None, limit: float):
    """Merges reciprocal nearest neighbours until none is left below ``limit`` and within ``room(n, x)``, the least cost to anything not given.

    Returns what is left (ids, n, x, top) and the edges (taken in, by, cost, step); ``top`` is a cluster's highest merge so far.
    """
    d = costs(n, x, n, x)
    np.fill_diagonal(d, np.inf)
    edges, step = [], 0
    while len(ids) > 1:
        at = np.arange(len(ids))
        near = d.argmin(1)
        cost = d[at, near]
        ok = cost < limit
        if room is not None:
            ok &= cost <= room(n, x)
        a = at[(near[near] == at) & ok & ok[near] & (at < near)]
        if not len(a):
            break
        b = near[a]
        height = np.maximum(cost[a], np.maximum(top[a], top[b]))
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        edges.append((high, low, height, np.full(len(a), step)))
        total = n[a] + n[b]
        x[a] = (n[a, None] * x[a] + n[b, None] * x[b]) / total[:, None]
        n[a], ids[a], top[a] = total, low, height
        fresh = costs(n[a], x[a], n, x)
        fresh[np.arange(len(a)), a] = np.inf
        d[a, :], d[:, a] = fresh, fresh.T
        keep = np.ones(len(ids), bool)
        keep[b] = False
        ids, n, x, top, d = ids[keep], n[keep], x[keep], top[keep], d[np.ix_(keep, keep)]
        step += 1
    return (ids, n, x, top), edges


def _ends(node: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The cluster that each taken-in one belongs to after all of these edges."""
    names, place = np.unique(np.concatenate([node, into]), return_inverse=True)
    to = np.arange(len(names))
    to[place[:len(node)]] = place[len(node):]
    while (to[to] != to).any():
        to = to[to]
    return names[to[place[:len(node)]]]


def _rows(left, edges) -> pd.DataFrame:
    ids, n, x, top = left
    node, into, height, step = (np.concatenate(c) for c in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 4
    none, gone = [None] * len(ids), len(node)
    return pd.DataFrame({"id": np.concatenate([ids, node]), "n": np.concatenate([n, np.full(gone, np.nan)]), "vec": [*x, *[None] * gone],
                         "top": np.concatenate([top, height]), "into": pd.array([*none, *into], "Int64"),
                         "step": np.concatenate([np.zeros(len(ids), int), step]), "last": pd.array([*none, *_ends(node, into)], "Int64")})


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values("id")
    return pdf["id"].to_numpy(np.int64).copy(), pdf["n"].to_numpy(float).copy(), _matrix(pdf["vec"]), pdf["top"].to_numpy(float).copy()


def boxes(cells: Cells, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of every cell."""
    low, high = np.full((1, dims), -np.inf), np.full((1, dims), np.inf)
    for level in range(cells.depth):
        nodes = np.arange((1 << level) - 1, (2 << level) - 1)
        at, dim = cells.at[nodes], cells.dim[nodes]
        next_low, next_high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
        k = np.arange(len(nodes))
        next_high[2 * k, dim] = np.minimum(high[k, dim], at)
        next_low[2 * k + 1, dim] = np.maximum(low[k, dim], at)
        low, high = next_low, next_high
    return low, high


def _halved(x: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """(dimension, wall, which points lie beyond it) of a cut near the middle of the widest side; None for points that are all equal."""
    dim = int((x.max(0) - x.min(0)).argmax())
    values = x[:, dim]
    cut = float(np.median(values))
    if not (values < cut).any():  # many equal values: put the cut above them
        above = values[values > cut]
        if not len(above):
            return None
        cut = float(above.min())
    cut = between(values, cut)
    return dim, cut, values >= cut


def _halves(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[tuple]]:
    """Boxes within a box by their height over the smallest ones: (number, places or numbers of the two halves, low, high)."""
    levels, count = [], itertools.count()

    def cut(at, low, high):
        parts = _halved(x[at]) if len(at) > LEAF else None
        if parts is None:
            level, held = 0, at
        else:
            dim, wall, right = parts
            inner_low, inner_high = low.copy(), high.copy()
            inner_high[dim] = inner_low[dim] = wall
            one, two = cut(at[~right], low, inner_high), cut(at[right], inner_low, high)
            level, held = 1 + max(one[0], two[0]), (one[1], two[1])
        me = next(count)
        while len(levels) <= level:
            levels.append([])
        levels[level].append((me, held, low, high))
        return level, me

    cut(np.arange(len(x)), low, high)
    return levels


def _merge_blocks(places: list[np.ndarray], low: np.ndarray, high: np.ndarray, state, least: float, limit: float, step: int):
    """What :func:`merge_within` does within the walls, for many blocks of clusters of ``state`` at once; returns the edges and the next step."""
    ids, n, x, top, alive = state
    size, at = np.array([len(p) for p in places]), np.arange(max(map(len, places)))
    real = at < size[:, None]
    own = np.zeros(real.shape, np.int64)
    own[real] = np.concatenate(places)
    i_, n_, x_, t_ = ids[own], n[own], x[own], top[own]

    def apart(n1, x1, n2, x2):
        away = np.zeros(np.broadcast_shapes(n1.shape, n2.shape))
        for k in range(x.shape[1]):
            away += (x1[..., k] - x2[..., k]) ** 2
        return 2.0 * n1 * n2 / (n1 + n2) * away

    def settle(some):
        held, where = real[some], own[some]
        kept = where[held]
        alive[where[at < size[some][:, None]]] = False
        alive[kept] = True
        ids[kept], n[kept], x[kept], top[kept] = i_[some][held], n_[some][held], x_[some][held], t_[some][held]

    d = apart(n_[:, :, None], x_[:, :, None], n_[:, None], x_[:, None])
    d[~(real[:, :, None] & real[:, None])] = np.inf
    d[:, at, at] = np.inf
    edges = []
    while True:
        near = d.argmin(2)
        cost = np.take_along_axis(d, near[:, :, None], 2)[:, :, 0]
        wall = np.minimum(x_ - low[:, None], high[:, None] - x_).min(2)
        ok = (cost < limit) & (cost <= 2.0 * n_ * least / (n_ + least) * wall * wall * (1 - 1e-9))
        ok &= np.take_along_axis(ok, near, 1) & (np.take_along_axis(near, near, 1) == at)
        b, a = np.nonzero(ok & (at < near))
        moved = np.unique(b)
        if len(moved) < 0.7 * len(d):  # a block without a merge is done
            done = np.ones(len(d), bool)
            done[moved] = False
            settle(done)
            if not len(moved):
                return edges, step
            b, cost, near = np.searchsorted(moved, b), cost[moved], near[moved]
            d, low, high, size, real, own, i_, n_, x_, t_ = (v[moved] for v in (d, low, high, size, real, own, i_, n_, x_, t_))
        c = near[b, a]
        height = np.maximum(cost[b, a], np.maximum(t_[b, a], t_[b, c]))
        into, node = np.minimum(i_[b, a], i_[b, c]), np.maximum(i_[b, a], i_[b, c])
        edges.append((node, into, height, np.full(len(a), step)))
        total = n_[b, a] + n_[b, c]
        x_[b, a] = (n_[b, a, None] * x_[b, a] + n_[b, c, None] * x_[b, c]) / total[:, None]
        n_[b, a], i_[b, a], t_[b, a], real[b, c] = total, into, height, False
        fresh = apart(total[:, None], x_[b, a][:, None], n_[b], x_[b])
        fresh[~real[b]] = np.inf
        fresh[np.arange(len(a)), a] = np.inf
        d[b, a, :] = fresh
        d[b, :, a] = fresh
        d[b, c, :] = np.inf
        d[b, :, c] = np.inf
        step += 1


def _merge_in_box(ids, n, x, top, low, high, least: float, limit: float):
    """Merges within a box, in halves of halves first; returns what is left and the edges."""
    state, edges, step, left = (ids, n, x, top, np.ones(len(ids), bool)), [], 0, {}
    alive = state[-1]
    for level in _halves(x.copy(), low, high):
        held = []
        for me, parts, a, b in level:
            left[me] = np.sort(np.concatenate([left.pop(p) for p in parts])) if isinstance(parts, tuple) else parts
            if 1 < len(left[me]) <= DENSE:
                held.append((me, a, b))
        held.sort(key=lambda h: len(left[h[0]]))
        first, lo = step, 0
        while lo < len(held):
            hi = lo + 1
            while hi < len(held) and (hi + 1 - lo) * len(left[held[hi][0]]) ** 2 <= PAIRS:
                hi += 1
            some = held[lo:hi]
            more, last = _merge_blocks([left[h[0]] for h in some], np.array([h[1] for h in some]), np.array([h[2] for h in some]), state, least, limit, first)
            edges, step, lo = edges + more, max(step, last), hi
        for me, *_ in held:
            left[me] = left[me][alive[left[me]]]
    return (ids[alive], n[alive], x[alive], top[alive]), edges


def _in_boxes(clusters: DataFrame, total: int, least: float, limit: float, turn: int) -> DataFrame:
    """One round within boxes; walls lie elsewhere in every round."""
    wanted = max(2, math.ceil(total / CELL))
    size = SAMPLE_PER_CELL * wanted
    drawn = clusters.where(uniform("ward", "id", F.lit(turn)) < min(1.0, 1.2 * size / total)).select("vec").limit(2 * size).collect()  # 32 vectors a box at most
    sample = np.array([r["vec"] for r in drawn], float)
    sample = sample[np.random.default_rng(turn).random(len(sample)) < 0.8] if len(sample) > 50 else sample
    cells = place_cells(sample, wanted if len(sample) else 1)
    dims = sample.shape[1] if len(sample) else len(clusters.first()["vec"])
    lows, highs = boxes(cells, dims)

    @F.pandas_udf("int")
    def locate(v: pd.Series) -> pd.Series:
        return pd.Series(cells.locate(_matrix(v))) if len(v) else pd.Series([], dtype="int32")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iat[0])
        return _rows(*_merge_in_box(*_arrays(pdf), lows[cell], highs[cell], least, limit))

    # the number of tasks is set by hand: the work is in the merging, not in the bytes shuffled
    tasks = min(shuffle_width(clusters), cells.count)
    return clusters.withColumn("cell", locate("vec")).repartition(tasks, "cell").groupBy("cell").applyInPandas(merge, ROWS)


def _across_boxes(clusters: DataFrame, least: float, limit: float) -> DataFrame:
    """One round of all reciprocal nearest neighbours, found across boxes."""
    index = SiteIndex(clusters, F.col("vec"), "id", 1 << 30, carry=["n"])
    queries = written(index.placed.withColumnRenamed("id", "qid"), "ward-queries")

    def nearest(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame(columns=["qid", "cost", "id"])
        s = s.sort_values("id")
        y, m, sid, qid, parts = _matrix(s["vec"]), s["_c_n"].to_numpy(float), s["id"].to_numpy(np.int64), q["qid"].to_numpy(np.int64), []
        for lo in range(0, len(q), 512):
            d = costs(q["_c_n"].to_numpy(float)[lo:lo + 512], _matrix(q["vec"].iloc[lo:lo + 512]), m, y)
            d[qid[lo:lo + 512, None] == sid[None, :]] = np.inf
            best = d.argmin(1)
            parts.append(pd.DataFrame({"qid": qid[lo:lo + 512], "cost": d[np.arange(len(d)), best], "id": sid[best]}))
        out = pd.concat(parts)
        return out[np.isfinite(out["cost"])]

    schema = "qid BIGINT, cost DOUBLE, id BIGINT"
    least_of = lambda df: df.groupBy("qid").agg(F.min(F.struct("cost", "id")).alias("m")).select("qid", "m.*")
    own = written(least_of(index.pair_blocks(queries, nearest, schema)), "ward-own")
    if index.cells.depth:
        reach = F.sqrt(F.least(F.coalesce("cost", F.lit(limit)), F.lit(limit)) * (F.col("_c_n") + least) / (2 * least * F.col("_c_n")))
        visits = queries.join(own.select("qid", "cost"), "qid", "left").withColumn("bound", reach).drop("cost")
        visits = written(index.reachable(visits, "bound", skip_own=True).drop("bound"), "ward-reach")
        own = written(least_of(own.unionByName(index.pair_blocks(visits, nearest, schema))), "ward-nearest")
    back = own.select(F.col("qid").alias("id"), F.col("id").alias("qid"))
    pairs = written(own.where((F.col("qid") < F.col("id")) & (F.col("cost") < limit)).join(back, ["id", "qid"]).select(F.col("qid").alias("a"), F.col("id").alias("b"), "cost"), "ward-pairs")
    side = lambda s: clusters.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "vec", "top")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("height", F.greatest("cost", "top_a", "top_b"))
    n = F.col("n_a") + F.col("n_b")
    mean = F.zip_with("vec_a", "vec_b", lambda x, y: (F.col("n_a") * x + F.col("n_b") * y) / n)
    none = F.lit(None).cast("bigint")
    merged = both.select(F.col("a").alias("id"), n.alias("n"), mean.alias("vec"), F.col("height").alias("top"), none.alias("into"), F.lit(0).alias("step"))
    edges = pairs.join(clusters.select(F.col("id").alias("a"), F.col("top").alias("top_a")), "a").join(clusters.select(F.col("id").alias("b"), F.col("top").alias("top_b")), "b") \
        .select(F.col("b").alias("id"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("array<double>").alias("vec"), F.greatest("cost", "top_a", "top_b").alias("top"),
                F.col("a").alias("into"), F.lit(0).alias("step"))
    gone = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    stay = clusters.join(gone, "id", "left_anti").select("id", "n", "vec", "top", none.alias("into"), F.lit(0).alias("step"))
    return stay.unionByName(merged).unionByName(edges)


def _edges(rows: DataFrame, turn: int) -> DataFrame:
    last = "last" if "last" in rows.columns else "into"  # a round of single merges
    return rows.where("into is not null").select(F.col("id").alias("node"), "into", F.col("top").alias("cost"), F.lit(turn).alias("turn"), "step", F.col(last).alias("last"))


def merge_rounds(points: DataFrame, limit: float = math.inf) -> DataFrame:
    """The edges (node, into, cost, turn, step, last) of the tree of ``points`` (id, n, vec), of merges below ``limit``; ``last`` is the cluster that a node belongs to after the turn."""
    clusters = points.select("id", "n", "vec", F.lit(0.0).alias("top"))
    out, turn, across = [], 0, False
    while True:
        size = clusters.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
        if size["k"] <= LAST:
            whole = clusters.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: _rows(*merge_within(*_arrays(pdf[["id", "n", "vec", "top"]]), None, limit)), ROWS)
            out.append(_edges(written(whole, "ward-last"), turn))
            break
        rows = written(_across_boxes(clusters, size["least"], limit) if across else _in_boxes(clusters, size["k"], size["least"], limit, turn), "ward-round")
        out.append(_edges(rows, turn))
        clusters = rows.where("into is null").select("id", "n", "vec", "top")
        left = clusters.count()
        if across and left == size["k"]:
            break  # no pair below the limit
        across, turn = not across and left > STUCK * size["k"], turn + 1
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges


def pieces(points: DataFrame, apart: float) -> DataFrame:
    """``points`` with ``piece``: those in one piece reach each other over occupied grid cells of side ``apart`` that touch, in the widest dimensions."""
    dims = len(points.first()["vec"])
    ends = points.agg(*[f(F.col("vec")[i]).alias(f"{t}{i}") for i in range(dims) for t, f in (("a", F.min), ("b", F.max))]).first()
    wide = sorted((i for i in range(dims) if ends[f"b{i}"] - ends[f"a{i}"] > apart), key=lambda i: ends[f"a{i}"] - ends[f"b{i}"])[:GRID_DIMS]
    if not wide or not apart > 0:
        return points.withColumn("piece", F.lit(0).cast("long") if apart > 0 else F.col("id"))
    keys = [f"_g{i}" for i in wide]
    placed = points.withColumns({f"_g{i}": F.floor((F.col("vec")[i] - ends[f"a{i}"]) / apart) for i in wide})
    grid = written(placed.groupBy(*keys).agg(F.min("id").alias("cell")), "grid")
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(keys)) if s > (0,) * len(keys)]
    moved = grid.select(F.col("cell").alias("other"), F.explode(F.array(*[F.struct(*[(F.col(k) + d).alias(k) for k, d in zip(keys, s)]) for s in steps])).alias("to")).select("other", "to.*")
    joined = components(moved.join(grid, keys).select("other", "cell"), "other", "cell")
    named = grid.join(joined.select(F.col("node").alias("cell"), F.col("component").alias("piece")), "cell", "left")
    return placed.join(named.select(*keys, F.coalesce("piece", "cell").alias("piece")), keys).drop(*keys)


def merge_below(points: DataFrame, threshold: float) -> DataFrame:
    """The edges of merges at a distance (root of the cost) below ``threshold``, piece by piece; pieces of more than ``LAST`` points go by rounds."""
    limit = float(threshold) ** 2
    parted = written(pieces(points, math.sqrt(2.0) * threshold * (1 + 1e-9)), "pieces")
    sizes = parted.groupBy("piece").agg(F.count(F.lit(1)).alias("k"))
    small = join_model(parted, sizes.where(F.col("k").between(2, LAST)).select("piece"), "piece", "left_semi")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            held = [x for x in (rest, batch) if x is not None and len(x)]
            if not held:
                continue
            rows = pd.concat(held)
            open_ = rows["piece"] == rows["piece"].iat[-1] if batch is not None else pd.Series(False, index=rows.index)
            rest = rows[open_]  # the last piece may go on in the next batch
            for _, piece in rows[~open_].groupby("piece"):
                yield _rows(*merge_within(*_arrays(piece.assign(top=0.0)), None, limit))

    solved = small.select("piece", "id", "n", "vec").repartition("piece").sortWithinPartitions("piece").mapInPandas(solve, ROWS)
    edges = _edges(written(solved, "ward-pieces"), 0)
    large = sizes.where(F.col("k") > LAST)
    if not large.isEmpty():
        edges = edges.unionByName(merge_rounds(written(join_model(parted, large.select("piece"), "piece", "left_semi"), "large-pieces"), limit))
    return edges


def _followed(edges: DataFrame) -> DataFrame:
    """(node, root) of a forest without the use of ``last``, by doubling of paths; a small one is followed at once."""
    known = edges.select("node", "into").limit(MAX_MODEL_ROWS + 1).collect()
    if len(known) <= MAX_MODEL_ROWS:
        node, into = (np.array([r[c] for r in known], np.int64) for c in ("node", "into"))
        return edges.sparkSession.createDataFrame(list(zip(node.tolist(), _ends(node, into).tolist())), "node BIGINT, root BIGINT")
    found = written(edges.select("node", F.col("into").alias("root")), "ward-roots")
    while True:
        further = found.select(F.col("node").alias("root"), F.col("root").alias("_further"))
        found = written(found.join(further, "root", "left").select("node", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "ward-roots")
        moved = not found.where("_moved").isEmpty()
        found = found.drop("_moved")
        if not moved:
            return found


def roots(edges: DataFrame, cut=()) -> DataFrame:
    """(node, root) of every taken-in cluster of the forest, turn by turn from the last; of the turns in ``cut`` edges are missing, so that ``last`` does not hold."""
    found = None
    for r in sorted(collect_bounded(edges.select("turn").distinct(), "turns"), reverse=True):
        own = edges.where(F.col("turn") == r["turn"])
        own = _followed(own) if r["turn"] in cut else own.select("node", F.col("last").alias("root"))
        if found is not None:
            further = found.select(F.col("node").alias("root"), F.col("root").alias("_further"))
            own = own.join(further, "root", "left").select("node", F.coalesce("_further", "root").alias("root")).unionByName(found)
        found = written(own, "ward-roots")
    return edges.select("node", F.col("into").alias("root")) if found is None else found


def distinct_points(df: DataFrame, features: str) -> DataFrame:
    """(id, n, vec): distinct vectors and their rows, numbered in their order."""
    counted = df.groupBy(F.col(features).cast("array<double>").alias("vec")).agg(F.count(F.lit(1)).cast("double").alias("n")).orderBy("vec")
    return written(counted.select(F.monotonically_increasing_id().alias("id"), "n", "vec"), "points")
