"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors of a label act as one site with a count.  A site lives in the cell of its nearest centre.  Two linked sites
in different cells both lie close to the plane between the two centres, so a site also visits every cell of a
smaller number whose plane is within the link's distance: no link is lost at a cell's border.  Cells are cut into blocks,
and a task compares two blocks; it returns per site the count of links and one link towards the others, never the pairs.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import join_model
from ballast.functions.store import written
from ballast.llm.vectors import as_matrix, bounded_sample, fit_cells, nearest, usable
from ballast.operators.density import components

BLOCK = 1024  # sites in a block
CELL_ROWS = 1024  # sites of the largest label that a cell should hold
MAX_CELLS = 512  # centres sent to the tasks; beyond it cells grow and are cut into more blocks


def _links(pair: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Per site of one pair of blocks: the vectors linked on the other side, and the smallest site reachable here."""
    left, right = pair[pair["side"] == 0], pair[pair["side"] == 1]
    alone = not len(right)
    if alone:
        right = left
    near = as_matrix(left["vec"]) @ as_matrix(right["vec"]).T >= threshold if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
    if alone:
        np.fill_diagonal(near, False)
    rows, cols = near.any(1), near.any(0)
    near = near[rows][:, cols]
    a, b = left["id"].to_numpy()[rows], right["id"].to_numpy()[cols]
    out = [pd.DataFrame({"id": a, "links": near @ right["n"].to_numpy()[cols]})]
    if not alone:
        out.append(pd.DataFrame({"id": b, "links": near.T @ left["n"].to_numpy()[rows]}))
    found = pd.concat(out, ignore_index=True)
    # the smallest id spreads along the links until nothing changes
    low_a, low_b, big = a.copy(), b.copy(), np.iinfo(np.int64).max
    while len(a):
        new_a = np.minimum(low_a, np.where(near, low_b[None, :], big).min(1))
        new_b = np.minimum(low_b, np.where(near, new_a[:, None], big).min(0))
        if alone:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    found["root"] = np.concatenate([low_a] if alone else [low_a, low_b]).astype(np.int64)
    return found.astype({"links": np.int64})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec: str = "embedding", label: str = "label", id_col: str = "vec_id") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors are linked if their labels are equal and not null, their lengths are equal and their cosine, in
    double precision, is at least ``threshold`` (above 0).  Null or zero vectors, those with null or non-finite components, and rows with a null id
    link with nothing and are kept.  Rows with one id count as vectors of their own.  Columns other than the three are left aside.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                         F.transform(F.col(vec), lambda x: x.cast("double")).alias("vec"))
    whole = written(raw.withColumn("ok", usable(F.col("vec")) & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull())
                    .withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws("|", "label", F.to_json(F.col("vec"))), 256))), "vectors")
    grouped = whole.where("ok").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    top = F.array_max(F.transform("vec", F.abs))
    scaled = grouped.withColumn("vec", F.transform("vec", lambda x: x / top))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sites = written(scaled.withColumn("norm", norm).withColumn("vec", F.transform("vec", lambda x: x / F.col("norm"))).drop("norm"), "sites")

    largest = sites.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, min(MAX_CELLS, math.ceil(largest / CELL_ROWS)))
    centres = fit_cells(bounded_sample(sites, "vec", "key", 64 * cells), cells, spherical=True)
    width = centres.shape[1]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9)
    gaps = np.sqrt(np.maximum(0, ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2)))

    @F.pandas_udf("array<int>")
    def cells_of(vecs: pd.Series) -> pd.Series:
        """The own cell first, then the cells of smaller number to visit."""
        rows = np.zeros((len(vecs), width))
        for i, v in enumerate(vecs):
            rows[i, :len(v)] = v
        own, dots = nearest(rows, centres), rows @ centres.T
        behind = dots[np.arange(len(rows)), own][:, None] - dots
        visit = (behind <= reach * gaps[own] + 1e-12) & (np.arange(len(centres))[None, :] < own[:, None])
        return pd.Series([[int(o), *np.flatnonzero(v).tolist()] for o, v in zip(own, visit)])

    at = sites.select("id", "n", "label", "vec", F.size("vec").alias("dim"), F.posexplode(cells_of("vec")).alias("visit", "cell"))
    at = written(at.withColumn("visit", (F.col("visit") > 0).cast("int")).withColumn("place", F.xxhash64("id")), "cells")
    group = ["label", "dim", "cell"]
    sizes = at.groupBy(*group).agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(F.col("visit") == v) / BLOCK)).cast("long").alias(f"blocks{v}") for v in (0, 1)])
    blocked = join_model(at, sizes, group)
    own = F.pmod(F.col("place"), F.col("blocks0"))
    # residents meet every block of residents once, visitors every block of residents
    pairs = F.when(F.col("visit") == 0, F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks0") - 1), lambda j: F.struct(
            F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), F.lit(0).alias("kind"), F.when(own > j, 1).otherwise(0).alias("side"))),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks1") - 1), lambda j: F.struct(
            own.alias("i"), j.alias("j"), F.lit(1).alias("kind"), F.lit(0).alias("side"))))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks0") - 1), lambda i: F.struct(
            i.alias("i"), F.pmod(F.col("place"), F.col("blocks1")).alias("j"), F.lit(1).alias("kind"), F.lit(1).alias("side"))))
    tasks = blocked.select(*group, "id", "n", "vec", F.explode(pairs).alias("p")).select(*group, "id", "n", "vec", "p.i", "p.j", "p.kind", "p.side")

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        # residents beside no visitors, or one half of a block pair, have nothing to be compared with
        if pair["side"].nunique() < 2 and (pair["kind"].iloc[0] == 1 or pair["i"].iloc[0] != pair["j"].iloc[0]):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype(np.int64)
        return _links(pair, threshold)

    found = written(tasks.groupBy(*group, "i", "j", "kind").applyInPandas(compare, "id long, links long, root long"), "links")
    of_site = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    told = written(sites.select("key", "id", "n").join(of_site, "id", "left")
                   .join(groups.withColumnRenamed("node", "id"), "id", "left")
                   .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "groups")
    out = whole.select("id", "key").join(told, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
