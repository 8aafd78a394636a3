"""Density clusters and pair distances, built on the same blocks as neighbour search."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import shuffle_width
from ballast.functions.draws import uniform
from ballast.functions.ranks import ranked
from ballast.functions.store import written
from ballast.operators.neighbors import BLOCK, Product, SiteIndex, _in_reach, _matrix, _squared, _type_of, radius_counts, squared_pairs
from ballast.spec import refuse_stream

PAIR_NUMBERS = 1 << 20  # numbers of a block of vectors whose pair distances are counted in one task
PAIR_BLOCKS = 24        # blocks into which fewer vectors are cut, so that all cores have some pairs of blocks


def core_flags(df: DataFrame, vec: Column, row_id: str, eps: float, min_samples: int = 3) -> DataFrame:
    """``df`` with ``core``: at least ``min_samples`` rows (itself included) within eps."""
    return radius_counts(df, df, vec, row_id, eps).withColumn("core", F.col("neighbors") >= min_samples).drop("neighbors")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node is connected to.

    In every round each component joins its smallest neighbour below it, the trees so made are followed to their roots by
    doubling of paths, and the edges are drawn anew between the roots.  A component with a smaller neighbour is gone after
    a round, so long chains take few rounds.  All steps are written, so the lineage stays short.
    """
    both = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "edges")
    labels = written(both.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    left = both.where("u <> v")
    while not left.isEmpty():
        tree = written(left.groupBy(F.col("u").alias("component")).agg(F.min("v").alias("root")), "trees")
        while True:
            further = tree.select(F.col("component").alias("root"), F.col("root").alias("further"))
            doubled = tree.join(further, "root", "left").select("component", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
            tree = written(doubled, "trees")
            if tree.where("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.drop("moved")
        to = lambda df, c: df.withColumnRenamed(c, "component").join(tree, "component", "left").withColumn(c, F.coalesce("root", "component"))
        ends = to(to(left, "u").select("u", "v"), "v").select("u", "v").where("u <> v")
        left = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        labels = written(labels.join(tree, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    return labels


def dbscan(df: DataFrame, vec: Column, row_id: str, eps: float, min_samples: int = 3) -> DataFrame:
    """``df`` with ``cluster``: density clusters numbered by their smallest core row id, noise -1.

    Rows with equal vectors act as one point with a count.  A pair of blocks reports only which of
    its points hang together (about one edge per point); those edges are then joined up across
    blocks.  A border point takes the lowest numbered cluster with a core point within eps.
    """
    refuse_stream(df, "dbscan")
    flagged = written(core_flags(df, vec, row_id, eps, min_samples).select(row_id, vec.alias("vec"), "core"), "core-flags")
    cores = flagged.where("core")
    id_type = _type_of(df, row_id)
    if cores.limit(1).count() == 0:
        return df.withColumn("cluster", F.lit(-1))
    r2 = float(eps) ** 2
    index = SiteIndex(cores, F.col("vec"), row_id, 1)
    queries = index.queries(cores, F.col("vec"), row_id)

    def linked(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame(columns=["a", "b"])
        qm, sm = _matrix(q["vec"]), _matrix(s["vec"])
        qid, sid = q["qid"].to_numpy(), s["id"].to_numpy()
        low, hang = np.arange(len(s)), np.full(len(q), -1)  # low: the first point of each point's piece
        for lo in range(0, len(q), 512):
            inside = _squared(qm[lo:lo + 512], sm) <= r2
            some = np.flatnonzero(inside.any(1))
            for i in some:
                met = low[inside[i]]
                least = met.min()
                if met.max() > least:
                    joins = np.zeros(len(s), bool)
                    joins[met] = True
                    low[joins[low]] = least
            hang[lo + some] = inside[some].argmax(1)
        used = np.flatnonzero(hang >= 0)
        out = {"a": np.concatenate([qid[used], sid]), "b": np.concatenate([sid[low[hang[used]]], sid[low]])}
        return pd.DataFrame(out)

    edges = index.pair_blocks(_in_reach(index, queries, eps), linked, f"a {id_type}, b {id_type}")
    found = components(edges)
    numbers = ranked(found.select("component").distinct(), [], "component").select("component", (F.col("rank") - 1).cast("int").alias("cluster"))
    core_points = written(found.join(numbers, "component").select(F.col("node").alias("id"), "cluster").join(
        queries.select(F.col("qid").alias("id"), "vec"), "id").select("id", "vec", "cluster"), "core-points")

    borders = flagged.where("not core")
    index2 = SiteIndex(core_points, F.col("vec"), "id", 1, carry=["cluster"])
    q2 = index2.queries(borders, F.col("vec"), row_id)

    def lowest(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame(columns=["vec", "cluster"])
        qm, sm = _matrix(q["vec"]), _matrix(s["vec"])
        number = s["_c_cluster"].to_numpy(np.int64)
        best = np.concatenate([np.where(_squared(qm[lo:lo + 512], sm) <= r2, number[None, :], np.iinfo(np.int32).max).min(1)
                               for lo in range(0, len(q), 512)])
        out = pd.DataFrame({"vec": q["vec"].to_numpy(), "cluster": best})
        return out[out["cluster"] < np.iinfo(np.int32).max]

    joined = index2.pair_blocks(_in_reach(index2, q2, eps), lowest, "vec ARRAY<DOUBLE>, cluster INT").groupBy("vec").agg(F.min("cluster").alias("cluster"))
    of_vector = core_points.select("vec", "cluster").unionByName(joined).withColumnRenamed("vec", "_v")
    out = df.withColumn("_v", vec).join(of_vector, "_v", "left").drop("_v")
    return out.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def median_pair_distance(df: DataFrame, vec: Column, row_id: str, factor: float = 1.0, sample: int | None = None,
                         bins: int = 8192, passes: int = 4, seed: int = 42) -> float:
    """Median of the distances of all ordered pairs of rows, a row with itself included, / factor.

    Pairs are counted into bins block by block, and the bin with the median is split again until it
    is narrower than any difference that matters; no pair is written.  Products of matrices give
    the distances, and those that may belong to another bin are measured anew.  The work grows with the
    square of the distinct vectors, so a caller may ask for a hash-drawn ``sample`` of rows instead.
    """
    refuse_stream(df, "median_pair_distance")
    rows = df.select(F.col(row_id), vec.alias("vec"))
    if sample:
        share = min(1.0, sample / max(df.count(), 1))
        rows = rows.where(uniform("median", row_id, seed=seed) < share)
    sites = written(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n")), "sites")
    size = sites.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if not size["n"]:
        raise ValueError("no rows")
    dims = len(sites.first()["vec"])
    span = sites.agg(*[(F.max(F.col("vec")[i]) - F.min(F.col("vec")[i])).alias(f"s{i}") for i in range(dims)]).first()
    high = math.sqrt(sum(v * v for v in span)) * (1 + 1e-9) + 1e-12
    block = max(BLOCK, min(16 * BLOCK, PAIR_NUMBERS // max(dims, 1)))
    parts = max(1, min(math.ceil(size["k"] / BLOCK), PAIR_BLOCKS), math.ceil(size["k"] / block))
    tasks = min(parts * (parts + 1) // 2, shuffle_width(df))
    part = F.pmod(F.xxhash64("vec"), F.lit(parts)).cast("int")
    # each unordered pair of blocks once: the smaller number is the left side
    left = sites.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(parts - 1))))
    right = sites.withColumn("q", part).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("q"))))
    total = int(size["n"]) ** 2
    wanted = [(total - 1) // 2, total // 2]
    ranges = {w: (0.0, high, 0) for w in wanted}  # low, high, pairs below low

    for _ in range(passes):
        spans = sorted({r for r in ranges.values()})

        def tally(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(s):
                return pd.DataFrame(columns=["i", "bin", "n"])
            twice = 1 if q["p"].iloc[0] == q["q"].iloc[0] else 2
            a, b = _matrix(q["vec"]), _matrix(s["vec"])
            wa, wb = q["n"].to_numpy(np.int64), s["n"].to_numpy(np.int64)
            sums = [np.zeros(bins, dtype=np.int64) for _ in spans]
            product, alone = Product(b), wa.max() == 1 and wb.max() == 1
            for lo in range(0, len(a), 128):
                some, weight = a[lo:lo + 128], wa[lo:lo + 128]
                about, slack = product.about(some)
                about, sure = about.ravel(), 1e4 * slack  # beyond `sure` a distance is off by the root of slack / 200 at most
                for i, (low, up, _) in enumerate(spans):
                    whole = low == 0.0 and up == high
                    at = None if whole else np.flatnonzero((about >= low * low * (1 - 1e-12) - sure) & (about <= up * up * (1 + 1e-12) + sure))
                    near = about if whole else about[at]
                    d = np.sqrt(np.maximum(near, 0.0))
                    where = (d - low) * (bins / (up - low))
                    edge = math.sqrt(slack) / 200 * (bins / (up - low)) + 1e-6
                    bin_ = np.floor(where)
                    unsure = np.flatnonzero((near < sure) | (np.abs(where - bin_ - 0.5) > 0.5 - edge))
                    x, y = np.divmod(unsure if whole else at[unsure], len(b))
                    d = np.sqrt(squared_pairs(some, x, b, y))
                    inside = (d >= low) & (d < up)
                    bin_[unsure] = np.where(inside, np.minimum(np.floor((d - low) / (up - low) * bins), bins - 1), -1)
                    bin_ = bin_.astype(np.int64)
                    if alone:
                        sums[i] += twice * np.bincount(np.where((bin_ < 0) | (bin_ >= bins), bins, bin_), minlength=bins + 1)[:bins]
                    else:
                        inside = np.flatnonzero((bin_ >= 0) & (bin_ < bins))
                        x, y = np.divmod(inside if whole else at[inside], len(b))
                        np.add.at(sums[i], bin_[inside], weight[x] * wb[y] * twice)
            out = [(i, int(k), int(v[k])) for i, v in enumerate(sums) for k in np.nonzero(v)[0]]
            return pd.DataFrame(out, columns=["i", "bin", "n"])

        dealt = lambda side: side.repartition(tasks, "p", "q").groupBy("p", "q")
        lines = dealt(left).cogroup(dealt(right)).applyInPandas(tally, "i INT, bin INT, n BIGINT") \
            .groupBy("i", "bin").agg(F.sum("n").alias("n")).collect()  # at most two ranges of `bins` lines
        for w in set(wanted):
            low, up, below = ranges[w]
            i = spans.index(ranges[w])
            run = below
            for r in sorted((r for r in lines if r["i"] == i), key=lambda r: r["bin"]):
                if run + r["n"] > w:
                    width = (up - low) / bins
                    ranges[w] = (low + r["bin"] * width, low + (r["bin"] + 1) * width, run)
                    break
                run += r["n"]
    middle = [0.5 * (ranges[w][0] + ranges[w][1]) for w in wanted]
    return sum(middle) / 2.0 / factor
