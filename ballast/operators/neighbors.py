"""Exact neighbour search as Spark jobs.

Rows with equal features are one *site*.  Sites are cut into boxes (cells) by median splits; a
search first looks into the site's own cell, which bounds the distance of its k-th neighbour, and
then only into cells whose box lies within that bound.  Cells are processed as blocks of bounded
size: every task holds one block of queries and one block of sites, and returns at most k
candidates per query.  No pair of rows is ever written out, and nothing is approximated.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ballast.functions.bounds import MAX_MODEL_ROWS, join_model, shuffle_width
from ballast.functions.draws import uniform
from ballast.functions.store import written
from ballast.spec import refuse_stream

BLOCK = 1024         # sites (or queries) per block
MAX_CELLS = 16_384   # cells in one partition of space; the split points are sent to every task
LISTED = 1024        # row ids of a vector in one list
SAMPLE_PER_CELL = 16  # sites drawn per cell to place the splits (affects balance only, never results)


def vector(features) -> Column:
    """One array of doubles from feature columns (arrays are appended as they are)."""
    features = [features] if isinstance(features, str) else list(features)
    return F.concat(*[F.array(F.col(c).cast("double")) for c in features]) if len(features) > 1 else F.array(F.col(features[0]).cast("double"))


@dataclass(frozen=True)
class Cells:
    """Median splits: node i sends x[dim] < at to 2i+1, else to 2i+2; leaves are the cells."""

    dim: np.ndarray
    at: np.ndarray
    depth: int

    @property
    def count(self) -> int:
        return 1 << self.depth

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.dim[node]] >= self.at[node]
            node = 2 * node + 1 + right
        return (node - (self.count - 1)).astype(np.int32)

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for every cell whose region comes within ``radius`` of the point.

        All points walk down the splits together; a step to the far side of a split keeps the
        distance to that side per dimension, and is taken only while the sum stays in reach.
        """
        # a hair of slack, so that rounding never hides a cell
        reach = (radius * (1 + 1e-9) + 1e-12) ** 2
        point, node, off = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros_like(x)
        for _ in range(self.depth):
            d = self.dim[node]
            gap = x[point, d] - self.at[node]
            near = 2 * node + 1 + (gap >= 0)
            far = 2 * node + 1 + (gap < 0)
            away = off.copy()
            away[np.arange(len(d)), d] = np.abs(gap)
            go = (away * away).sum(1) <= reach[point]
            point, node, off = np.concatenate([point, point[go]]), np.concatenate([near, far[go]]), np.concatenate([off, away[go]])
        return point, (node - (self.count - 1)).astype(np.int32)


def between(values: np.ndarray, cut: float) -> float:
    """The middle of the values just below and not below ``cut``: it parts the values as ``cut`` does."""
    less, more = values[values < cut], values[values >= cut]
    if not len(less) or not len(more):
        return cut
    low, high = float(less.max()), float(more.min())
    middle = low + (high - low) / 2
    return middle if low < middle else high


def place_cells(sample: np.ndarray, cells: int) -> Cells:
    """Split near the median of the widest dimension, level by level, in the middle between two neighbouring values, so that a wall meets no value that many points share."""
    depth = max(0, math.ceil(math.log2(max(cells, 1))))
    inner = (1 << depth) - 1
    dim, at = np.zeros(max(inner, 1), dtype=np.int64), np.zeros(max(inner, 1))
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        rows = members.pop(node)
        part = sample[rows]
        if len(part):
            d = int((part.max(0) - part.min(0)).argmax())
            values = part[:, d]
            cut = float(np.median(values))
            if not (values < cut).any():  # many equal values: put the cut above them
                above = values[values > cut]
                cut = float(above.min()) if len(above) else cut
            cut = between(values, cut)
            dim[node], at[node] = d, cut
            right = values >= cut
        else:
            right = np.zeros(0, dtype=bool)
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return Cells(dim, at, depth)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, 1))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, dimension by dimension (no cancellation)."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d][:, None] - b[:, d][None, :]) ** 2
    return out


def squared_pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What :func:`_squared` gives for the pairs (i, j), bit by bit."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += (a[i, d] - b[j, d]) ** 2
    return out


class Product:
    """Squared distances to ``sites`` by products of matrices: fast in many dimensions, and off by ``slack`` at most."""

    def __init__(self, sites: np.ndarray):
        self.middle = np.where(np.isfinite(sites), sites, 0.0).mean(0)
        apart = (sites - self.middle).T
        length = (apart * apart).sum(0)
        # the lengths are two more dimensions, so that a product is a distance and no further pass is needed
        self.turned = np.vstack([-2.0 * apart, length, np.ones(len(sites))])
        self.longest = float(np.fmax.reduce(length, initial=0.0))

    def about(self, x: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, float]:
        """(distances to the sites from ``lo`` to ``hi``, slack); the slack is many times what the rounding of sums of so many products can come to."""
        x = x - self.middle
        own = (x * x).sum(1)
        out = np.column_stack([x, np.ones(len(x)), own]) @ self.turned[:, lo:hi]
        return out, 4e-16 * (8 + x.shape[1]) * 4 * (float(np.fmax.reduce(own, initial=0.0)) + self.longest) + 1e-290


def nearest_wide(wanted: np.ndarray, limits: np.ndarray, sites: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of the ``want`` nearest sites of every vector, those beyond its limit left out; ties go to the earlier site.

    Tiles of sites come one after the other; the nearest so far of a vector tell which of the next ones are worth an exact look.
    """
    product, out = Product(sites), []
    for lo in range(0, len(wanted), TILE_ROWS):
        some, limit = wanted[lo:lo + TILE_ROWS], limits[lo:lo + TILE_ROWS].astype(float)
        i, j, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(sites), TILE):
            found, slack = product.about(some, start, start + TILE)
            if not start and not np.isfinite(limit).all() and found.shape[1] > want:
                limit = np.fmin(limit, np.partition(found[:, :max(BLOCK, want)], want - 1, axis=1)[:, want - 1] + slack)
            hit_i, hit_j = np.divmod(np.flatnonzero(~(found > (limit + slack)[:, None])), found.shape[1])
            if not len(hit_i):
                continue
            hit_j += start
            i, j, d2 = np.concatenate([i, hit_i]), np.concatenate([j, hit_j]), np.concatenate([d2, squared_pairs(some, hit_i, sites, hit_j)])
            order = np.lexsort((j, d2, i))  # by query, distance, then id
            i, j, d2 = i[order], j[order], d2[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            last = rank == want - 1
            limit[i[last]] = np.fmin(limit[i[last]], d2[last])
            i, j, d2 = i[rank < want], j[rank < want], d2[rank < want]
        out.append((lo + i, j, d2))
    return tuple(np.concatenate(c) for c in zip(*out))


WIDE = 8  # dimensions from which products of matrices find the candidates
WIDE_BLOCK = 32_768  # sites (or queries) per block of such vectors, at most: each is sent once for every block it meets
TILE, TILE_ROWS = 4096, 256  # sites and queries compared at once, so that their distances stay near the processor
SPREAD_NUMBERS = 1 << 22     # coordinates held while cells in reach are looked for


class SiteIndex:
    """The rows of a table that can be neighbours, cut into cells and blocks.

    ``within`` columns separate the space: a search never leaves the query's own group.  Of rows with
    equal vectors only the ``keep`` of smallest id are held (with the ``carry`` columns), which is
    enough for any k <= keep; ranks above ``keep`` are dropped before the shuffle as well, so a
    vector shared by a large part of the table stays small.  ``wide`` asks for larger blocks of vectors of
    many dimensions: hardly a cell is out of their reach, so that what is sent grows with the number of blocks.
    """

    wide = False

    def __init__(self, df: DataFrame, vec: Column, row_id: str, keep: int, carry=(), within=(), wide: bool = False):
        refuse_stream(df, "neighbour search")
        self.carry, self.within, self.wide = list(carry), list(within), wide
        rows = df.select(*[F.col(c) for c in self.within], vec.alias("vec"), F.col(row_id).alias("id"),
                         *[F.col(c).alias(f"_c_{c}") for c in self.carry])
        order = W.partitionBy(*self.within, "vec").orderBy("id")
        best = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")
        self.sites = written(best.withColumn("site", F.xxhash64("vec")), "sites")
        self._partition()

    @classmethod
    def counted(cls, df: DataFrame, vec: Column, label: str | None) -> "SiteIndex":
        """Row counts per vector (and class) in place of the rows themselves."""
        self = cls.__new__(cls)
        self.carry, self.within = [], []
        by = [vec.alias("vec"), *([F.col(label).alias("label")] if label else [])]
        self.sites = written(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("site", F.xxhash64("vec")), "sites")
        self._partition()
        return self

    def queries(self, df: DataFrame, vec: Column, row_id: str) -> DataFrame:
        """Distinct vectors (per group) with their smallest row id, ``qid``, and their cell."""
        distinct = df.groupBy(*[F.col(c) for c in self.within], vec.alias("vec")).agg(F.min(row_id).alias("qid"))
        return written(self.place(distinct.withColumn("site", F.xxhash64("vec"))), "queries")

    def _partition(self) -> None:
        self._groups = written(self.sites.groupBy(*self.within).agg(F.count(F.lit(1)).alias("_gn")), "groups") if self.within else None
        total, dims = self.sites.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        self.wide, self.block = self.wide and (dims or 0) >= WIDE, BLOCK
        if self.wide:  # about two pairs of blocks a task
            self.block = max(BLOCK, min(WIDE_BLOCK, math.ceil(total / math.ceil(math.sqrt(2 * shuffle_width(self.sites))))))
        wanted = min(MAX_CELLS, math.ceil(total / self.block))
        sample = np.zeros((0, 1))
        if wanted > 1:
            size = SAMPLE_PER_CELL * wanted
            drawn = self.sites.where(uniform("cells", "site") < min(1.0, 1.2 * size / total)).select("vec").limit(2 * size)
            flat = drawn.toArrow().column("vec").combine_chunks()  # at most 32 vectors per cell
            sample = np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else sample
        self.cells = place_cells(sample, wanted if len(sample) else 1)
        self.placed = written(self.place(self.sites), "placed")
        self.blocks = written(self.placed.groupBy(*self.within, "cell").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("parts")), "blocks")

    def place(self, df: DataFrame) -> DataFrame:
        """Add each vector's cell; a group that fits one block is not cut and has the cell -1."""
        if self.cells.depth == 0:
            return df.withColumn("cell", F.lit(-1))
        cells = self.cells

        @F.pandas_udf("int")
        def locate(v: pd.Series) -> pd.Series:
            return pd.Series(cells.locate(_matrix(v)))

        if not self.within:
            return df.withColumn("cell", locate("vec"))
        joined = join_model(df, self._groups, self.within, "left")
        return joined.withColumn("cell", F.when(F.coalesce("_gn", F.lit(0)) <= self.block, F.lit(-1)).otherwise(locate("vec"))).drop("_gn")

    def pair_blocks(self, queries: DataFrame, run, schema: str) -> DataFrame:
        """Apply ``run(query_pdf, site_pdf)`` to every query block / site block pair of a cell.

        ``queries`` has the group columns and ``cell``.  Site blocks are repeated per query block and
        the other way round; both numbers follow from counts, so every pair is of bounded size.  The
        number of tasks is set by hand: the work is in the distances, not in the bytes shuffled.
        """
        keys = [*self.within, "cell"]
        q_sizes = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("qparts"))
        sizes = self.blocks.join(q_sizes, keys)
        known, tasks = sizes.limit(MAX_MODEL_ROWS + 1).collect(), shuffle_width(queries)
        if len(known) <= MAX_MODEL_ROWS:
            tasks = max(1, min(tasks, sum(r["parts"] * r["qparts"] for r in known)))
            sizes = F.broadcast(queries.sparkSession.createDataFrame(known, sizes.schema))
        pick = lambda salt, n: F.pmod(F.xxhash64(F.col("site"), F.lit(salt)), n).cast("int")
        q = queries.join(sizes, keys).withColumn("qblock", pick("q", F.col("qparts"))) \
            .withColumn("sblock", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "qparts")
        s = self.placed.join(sizes, keys).withColumn("sblock", pick("s", F.col("parts"))) \
            .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))).drop("parts", "qparts")
        by = [*keys, "qblock", "sblock"]
        return q.repartition(tasks, *by).groupBy(*by).cogroup(s.repartition(tasks, *by).groupBy(*by)).applyInPandas(run, schema)

    def reachable(self, queries: DataFrame, bound: str, skip_own: bool) -> DataFrame:
        """One row per (query, cell within ``bound`` of it); ``bound`` null means every cell.

        Cells that hold no site of the query's group fall out when the blocks are joined.
        """
        if self.cells.depth == 0:
            return queries.where(F.lit(not skip_own))
        cells = self.cells

        def spread(batches):
            for pdf in batches:
                pdf = pdf[pdf["cell"] >= 0]
                step = max(1, min(1024, SPREAD_NUMBERS // (cells.count * len(pdf["vec"].iat[0])))) if len(pdf) else 1
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    limit = part[bound].to_numpy(float)
                    i, cell = cells.within(_matrix(part["vec"]), np.where(np.isnan(limit), np.inf, limit))
                    if skip_own:
                        other = cell != part["cell"].to_numpy()[i]
                        i, cell = i[other], cell[other]
                    out = part.iloc[i].copy()
                    out["cell"] = cell
                    yield out

        return queries.mapInPandas(spread, queries.schema)


def _type_of(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def knn(left: DataFrame, right: DataFrame, vec: Column, row_id: str, k: int, carry=(), within=(),
        include_self: bool = True, with_vector: bool = False) -> DataFrame:
    """``left`` with a column ``neighbors``: the k nearest rows of ``right``, nearest first.

    Each neighbour is a struct (dist, id, carried columns[, vec]); ties go to the smaller id.  With
    ``include_self`` a row that is also in ``right`` finds itself at distance 0.  ``within`` limits
    the search to rows that agree on those columns.
    """
    want = k if include_self else k + 1
    index = SiteIndex(right, vec, row_id, want, carry, within, wide=True)
    queries = index.queries(left, vec, row_id)
    names = [f"_c_{c}" for c in index.carry]
    schema = ", ".join([f"qid {_type_of(left, row_id)}", "d2 DOUBLE", f"id {_type_of(right, row_id)}",
                        *[f"_c_{c} {_type_of(right, c)}" for c in index.carry], *(["nvec ARRAY<DOUBLE>"] if with_vector else [])])
    columns = ["qid", "d2", "id", *names, *(["nvec"] if with_vector else [])]

    def nearest(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame(columns=columns)
        s = s.sort_values("id")
        sites, wanted, parts = _matrix(s["vec"]), _matrix(q["vec"]), []
        if sites.shape[1] >= WIDE:
            # the distance of the k-th neighbour so far, with a hair of slack for its root
            limits = q["bound"].to_numpy(float) ** 2 * (1 + 1e-9) if "bound" in q else np.full(len(q), np.inf)
            parts.append(nearest_wide(wanted, np.where(np.isnan(limits), np.inf, limits), sites, want))
        for lo in range(0, len(q) if sites.shape[1] < WIDE else 0, 512):
            found = _squared(wanted[lo:lo + 512], sites)
            limit = np.partition(found, want - 1, axis=1)[:, want - 1] if found.shape[1] > want else np.full(len(found), np.inf)
            i, j = np.nonzero(found <= limit[:, None])
            d2 = found[i, j]
            order = np.lexsort((j, d2, i))  # by query, distance, then id
            i, j, d2 = i[order], j[order], d2[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < want
            parts.append((lo + i[keep], j[keep], d2[keep]))
        i, j, d2 = (np.concatenate(c) for c in zip(*parts))
        out = {"qid": q["qid"].to_numpy()[i], "d2": d2, "id": s["id"].to_numpy()[j]} | {n: s[n].to_numpy()[j] for n in names}
        if with_vector:
            out["nvec"] = s["vec"].to_numpy()[j]
        return pd.DataFrame(out)

    entry = F.struct("d2", "id", *names, *(["nvec"] if with_vector else []))
    # at most `want` candidates per visited block
    merged = lambda df: df.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, want).alias("found"))
    found = index.pair_blocks(queries, nearest, schema)
    if index.cells.depth:
        own = written(found, "own-cell")
        bounds = merged(own).select("qid", F.when(F.size("found") >= want, F.sqrt(F.element_at("found", -1)["d2"])).alias("bound"))
        rest = written(index.reachable(queries.join(bounds, "qid", "left"), "bound", skip_own=True), "reach")
        found = own.unionByName(index.pair_blocks(rest, nearest, schema))
    per_vector = queries.select("qid", *within, F.col("vec").alias("_vec")).join(merged(found), "qid").drop("qid")
    # vectors are unique on this side; adaptive execution splits a hot one on the other
    result = left.withColumn("_vec", vec).join(per_vector, [*within, "_vec"], "left")
    hits = F.coalesce(F.col("found"), F.array())
    if not include_self:
        hits = F.slice(F.filter(hits, lambda e: e["id"] != F.col(row_id)), 1, k)
    shape = lambda e: F.struct(F.sqrt(e["d2"]).alias("dist"), e["id"].alias("id"), *[e[f"_c_{c}"].alias(c) for c in index.carry],
                               *([e["nvec"].alias("vec")] if with_vector else []))
    return result.withColumn("neighbors", F.transform(hits, shape)).select(*left.columns, "neighbors")


def knn_pairs(left: DataFrame, right: DataFrame, vec: Column, row_id: str, k: int, **options) -> DataFrame:
    """(row id, neighbor, rank, dist): one row per neighbour."""
    found = knn(left, right, vec, row_id, k, **options)
    return found.select(row_id, F.posexplode("neighbors").alias("pos", "n")) \
                .select(row_id, F.col("n")["id"].alias("neighbor"), (F.col("pos") + 1).alias("rank"), F.col("n")["dist"].alias("dist"))


def _in_reach(index: SiteIndex, queries: DataFrame, radius: float) -> DataFrame:
    if not index.cells.depth:
        return queries
    return written(index.reachable(queries.withColumn("bound", F.lit(float(radius))), "bound", skip_own=False).drop("bound"), "reach")


def radius_counts(left: DataFrame, right: DataFrame, vec: Column, row_id: str, radius: float, label: str | None = None) -> DataFrame:
    """``left`` with ``neighbors`` (rows of ``right`` within the radius, itself included) and, given a
    label, ``same_class`` (those that share it).

    Only counts leave a task: per query vector and class the number of rows, never the pairs.
    """
    index = SiteIndex.counted(right, vec, label)
    queries = index.queries(left, vec, row_id)
    label_ddl = f", label {_type_of(right, label)}" if label else ""
    columns = ["qid", *(["label"] if label else []), "n"]
    r2 = float(radius) ** 2

    def count(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(s):
            sites, wanted, n = _matrix(s["vec"]), _matrix(q["vec"]), s["n"].to_numpy(np.int64)
            groups = s.groupby("label", sort=False).indices if label else {None: np.arange(len(s))}
            for lo in range(0, len(q), 512):
                inside = _squared(wanted[lo:lo + 512], sites) <= r2
                for name, at in groups.items():
                    total = inside[:, at] @ n[at]
                    some = np.nonzero(total)[0]
                    out = {"qid": q["qid"].to_numpy()[lo + some], "n": total[some]}
                    if label:
                        out["label"] = np.full(len(some), name, dtype=object)
                    parts.append(pd.DataFrame(out)[columns])
        return pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    counts = index.pair_blocks(_in_reach(index, queries, radius), count, f"qid {_type_of(left, row_id)}{label_ddl}, n BIGINT")
    of_vector = queries.select("qid", F.col("vec").alias("_vec"))
    if not label:
        total = of_vector.join(counts.groupBy("qid").agg(F.sum("n").alias("neighbors")), "qid").drop("qid")
        out = left.withColumn("_vec", vec).join(total, "_vec", "left").drop("_vec")
        return out.withColumn("neighbors", F.coalesce("neighbors", F.lit(0)).cast("long"))
    # a map from class to count: its size is bounded by the classes
    per = counts.groupBy("qid", "label").agg(F.sum("n").alias("n")) \
        .groupBy("qid").agg(F.sum("n").alias("neighbors"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_by"))
    out = left.withColumn("_vec", vec).join(of_vector.join(per, "qid").drop("qid"), "_vec", "left")
    same = F.coalesce(F.try_element_at(F.col("_by"), F.col(label)), F.lit(0))
    return out.withColumns({"neighbors": F.coalesce("neighbors", F.lit(0)).cast("long"), "same_class": same.cast("long")}) \
              .select(*left.columns, "neighbors", "same_class")


def _classes(df: DataFrame, vec: Column, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(vec, class, parts): the vectors without nulls, numbered; and (class, part, ids): their rows, in lists of about ``LISTED``."""
    rows = df.select(vec.alias("vec"), F.col(row_id).alias("id")).where(F.forall("vec", lambda v: v.isNotNull()))
    counted = rows.groupBy("vec").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("parts"))
    classes = written(counted.withColumn("class", F.monotonically_increasing_id()), "classes")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    # an id may be null, and is kept as such
    lists = rows.join(classes, "vec").groupBy("class", part).agg(F.collect_list(F.struct("id")).alias("ids"))
    return classes, written(lists, "lists")


def radius_pairs(left: DataFrame, right: DataFrame, vec: Column, row_id: str, radius: float) -> DataFrame:
    """(row id, neighbor, dist) for every row of ``right`` within the radius of a row of ``left``.

    The pairs are the result; they are found between distinct vectors, cell by cell, and widened to the rows from lists of
    ids at the very end: no shuffle moves a pair of rows.  Row ids may repeat or be null.
    """
    mine, my_rows = _classes(left, vec, row_id)
    theirs, their_rows = (mine, my_rows) if left is right else _classes(right, vec, row_id)
    index = SiteIndex(theirs, F.col("vec"), "class", 1, carry=["parts"])
    queries, r2 = index.queries(mine, F.col("vec"), "class"), float(radius) ** 2

    def close(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(s):
            sites, wanted = _matrix(s["vec"]), _matrix(q["vec"])
            for lo in range(0, len(q), 512):
                d2 = _squared(wanted[lo:lo + 512], sites)
                i, j = np.nonzero(d2 <= r2)
                parts.append(pd.DataFrame({"qid": q["qid"].to_numpy()[lo + i], "sid": s["id"].to_numpy()[j], "parts": s["_c_parts"].to_numpy()[j],
                                           "dist": np.sqrt(d2[i, j])}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["qid", "sid", "parts", "dist"])

    pairs = index.pair_blocks(_in_reach(index, queries, radius), close, "qid BIGINT, sid BIGINT, parts INT, dist DOUBLE")
    lists = lambda rows, key, name: rows.select(F.col("class").alias(key), "part", F.col("ids").alias(name))
    wide = pairs.join(lists(my_rows, "qid", "_mine").drop("part"), "qid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return wide.join(lists(their_rows, "sid", "_theirs"), ["sid", "part"]) \
        .select("_theirs", "dist", F.explode("_mine").alias("_a")) \
        .select("_a", "dist", F.explode("_theirs").alias("_b")) \
        .select(F.col("_a")["id"].alias(row_id), F.col("_b")["id"].alias("neighbor"), "dist")


def radius_links(df: DataFrame, vec: Column, row_id: str, radius: float) -> DataFrame:
    """(row id, class_id, n_links): rows with equal vectors are a class, named by its smallest id, and link with all other rows within the radius.

    One row per row of ``df``, whatever the number of pairs; a vector with a null links with nothing.
    """
    rows = df.select(row_id, vec.alias("_at"))
    classes = rows.groupBy("_at").agg(F.min(row_id).alias("class_id")).withColumn("_class", F.monotonically_increasing_id())
    counted = radius_counts(written(classes, "classes"), rows, F.col("_at"), "_class", radius)
    return rows.join(counted, "_at").select(row_id, "class_id", F.greatest(F.col("neighbors") - 1, F.lit(0)).cast("long").alias("n_links"))


# ---------------------------------------------------------------- point types

# Names and the lower share of the published point types.
ISOLATED, CORE, BORDER, OUTLIER = "Isolated", "Core", "Border", "Outlier"
LOW_SHARE = 0.2


def _type(n: Column, same: Column) -> Column:
    return F.when(n <= 1, ISOLATED).when(same >= n, CORE).when(same > F.lit(LOW_SHARE) * n, BORDER).otherwise(OUTLIER)


def point_types(df: DataFrame, vec: Column, label: str, row_id: str, method: str = "knn", k: int = 5,
                radius: float = 10.0, include_self: bool = True) -> DataFrame:
    """Add ``point_type``: Isolated, Core, Border or Outlier by the classes of a row's neighbours.

    Core: all neighbours share the row's class; Border: more than a fifth but not all; Outlier: the
    rest; Isolated: the row is its own only neighbour.  The row itself counts as a neighbour unless
    ``include_self`` is false.
    """
    if method == "knn":
        found = knn(df, df, vec, row_id, k, carry=[label], include_self=include_self)
        n = F.size("neighbors") + (0 if include_self else 1)
        same = F.size(F.filter("neighbors", lambda e: e[label] == F.col(label)))
    elif method == "rad":
        found = radius_counts(df, df, vec, row_id, radius, label)
        n, same = F.col("neighbors"), F.col("same_class")
        if not include_self:
            same = same - 1
    else:
        raise ValueError(f"unknown neighbour method {method!r}; use 'knn' or 'rad'")
    if not include_self:
        alone, others = n <= 1, n - 1
        kind = F.when(alone, ISOLATED).when(same >= others, CORE).when(same > F.lit(LOW_SHARE) * others, BORDER).otherwise(OUTLIER)
    else:
        kind = _type(n, same)
    return found.withColumn("point_type", kind).select(*df.columns, "point_type")


def safe_border_filter(typed: DataFrame) -> DataFrame:
    """Keep Core and Border rows."""
    return typed.where(F.col("point_type").isin(CORE, BORDER))
