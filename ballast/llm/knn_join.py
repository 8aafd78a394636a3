"""Exact top-k inner products of whole-number vectors by a Voronoi join.

Data are grouped by their nearest pivot; a group's summary is its pivot, its count and its radius.  By
Cauchy and Schwarz no member scores above pivot * query + |query| * radius.  A query is first solved in its most promising
groups, which gives a floor for its k-th score; after that it is sent to those groups alone whose bound reaches the floor.
Queries and groups travel in blocks, and a task solves one block of queries against one block of data.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ballast.functions.bounds import join_model
from ballast.functions.store import written
from ballast.llm.vectors import bounded_sample, fit_cells, nearest, usable

BLOCK = 4096  # rows in a block of data or of queries
GROUP_ROWS = 512  # data a group should hold
MAX_GROUPS = 1024  # pivots sent to the tasks; beyond it groups grow and are cut into more blocks


def _filled(vecs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, :len(v)] = v
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whole-number products: by floating point where all partial sums are exact, else by integers."""
    top = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1])
    if top < 2 ** 53:
        return (queries @ data.T).astype(np.int64)
    return queries.astype(np.int64) @ data.astype(np.int64).T


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k other rows of the highest integer inner product; ties to the smaller id.

    Components are floor(scale * x) with x as double.  Vectors that are null or empty, hold null or non-finite components
    or have a null id take no part; shorter vectors count as filled up with zeros.  Scores are exact within the
    range of long.  Rows with one id are candidates of their own, but none is a candidate of a query with that id.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("vec"), is_query.alias("q"))
    data = written(base.where(usable(F.col("vec")) & F.col("id").isNotNull())
                   .withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double"))), "whole-vectors")
    n = data.count()
    groups = max(1, min(MAX_GROUPS, math.ceil(n / GROUP_ROWS)))
    pivots = fit_cells(bounded_sample(data, "vec", "id", 32 * groups), groups, spherical=False)
    width = pivots.shape[1]

    @F.pandas_udf("grp int, dist double")
    def assign(vecs: pd.Series) -> pd.DataFrame:
        rows = _filled(vecs, width)
        near = nearest(rows, pivots)
        return pd.DataFrame({"grp": near.astype(np.int32), "dist": np.sqrt(((rows - pivots[near]) ** 2).sum(1))})

    cells = written(data.withColumn("_a", assign("vec")).select("id", "vec", "q", "_a.grp", "_a.dist"), "groups")
    count, radius = np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in cells.groupBy("grp").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect():  # at most MAX_GROUPS rows
        count[r["grp"]], radius[r["grp"]] = r["n"], r["r"] * (1 + 1e-12)
    blocks = F.element_at(F.array(*[F.lit(max(1, math.ceil(c / BLOCK))) for c in count]), F.col("grp") + 1)
    placed = cells.select("id", "vec", "grp", F.pmod(F.xxhash64("id"), blocks).alias("block"))
    queries = written(cells.where("q").select("id", "vec", "grp").distinct(), "queries")
    query_blocks = max(1, math.ceil(queries.count() / BLOCK))

    @F.pandas_udf("array<int>")
    def first_groups(vecs: pd.Series) -> pd.Series:
        """Groups of the best pivots that hold more than k rows together."""
        order = np.argsort(-(_filled(vecs, width) @ pivots.T), axis=1, kind="stable")
        enough = np.cumsum(count[order], axis=1) - count[order] <= k
        return pd.Series([o[e].tolist() for o, e in zip(order.astype(int), enough)])

    @F.pandas_udf("array<int>")
    def other_groups(vecs: pd.Series, floors: pd.Series, seen: pd.Series) -> pd.Series:
        rows = _filled(vecs, width)
        bound = rows @ pivots.T + np.sqrt((rows ** 2).sum(1))[:, None] * radius
        need = (bound + 1e-9 * np.abs(bound) + 1e-6 >= floors.fillna(-np.inf).to_numpy(float)[:, None]) & (count > 0)
        for i, s in enumerate(seen):
            need[i, list(s)] = False
        return pd.Series([np.flatnonzero(x).tolist() for x in need])

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out, qv, dv = [], _filled(q["vec"], width), _filled(d["vec"], width)
        ids, qids, floors = d["id"].to_numpy(), q["id"].to_numpy(), q["floor"].fillna(-np.inf).to_numpy(float)
        order = np.argsort(ids, kind="stable")  # equal scores then come by id
        ids, dv = ids[order], dv[order]
        for lo in range(0, len(q) if len(d) else 0, 256):
            scores = _scores(qv[lo:lo + 256], dv)
            for i, row in enumerate(scores):
                at = np.flatnonzero((ids != qids[lo + i]) & (row >= floors[lo + i]))
                if len(at) > k:
                    # the k-th score, then its ties in id order
                    kth = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = np.concatenate([at[row[at] > kth], at[row[at] == kth]])[:k]
                out.append(pd.DataFrame({"query_id": qids[lo + i], "vec_id": ids[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)

    def solved(asked: DataFrame) -> DataFrame:
        """``asked``: (id, vec, floor, targets); candidates of every query in its target groups."""
        sent = asked.withColumn("qblock", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).withColumn("grp", F.explode("targets")).drop("targets")
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        wanted = sent.select("grp", "block", "qblock").distinct()
        rows = placed.join(wanted, ["grp", "block"]).select(
            F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("grp").alias("g"), F.col("block").alias("b"), F.col("qblock").alias("qb"))
        return sent.groupBy("grp", "block", "qblock").cogroup(rows.groupBy("g", "b", "qb")).applyInPandas(
            solve, "query_id long, vec_id long, score long")

    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    opened = written(queries.select("id", "vec", F.lit(None).cast("double").alias("floor"), first_groups("vec").alias("targets")), "opened")
    first = written(best(solved(opened)), "first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("reached"))
    again = opened.join(floors, "id", "left").select("id", "vec", F.col("reached").alias("floor"), other_groups("vec", "reached", "targets").alias("targets"))
    more = solved(written(again.where(F.size("targets") > 0), "again"))
    return best(first.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")
