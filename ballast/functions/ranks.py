"""Ranks within groups that may hold most of the table.

A plain ``row_number`` over a hot group sorts that group in one task.  Here rows are first cut
into order-preserving buckets of about equal size; each (group, bucket) is ranked alone and the
row counts of the earlier buckets are added.  The result is exactly ``row_number``.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ballast.functions.bounds import shuffle_width


def _image(df: DataFrame, name: str) -> Column:
    """A double that never decreases as the column's value increases."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        low, high = df.agg(F.min(name), F.max(name)).first()
        shared = 0
        for a, b in zip(low or "", high or ""):
            if a != b:
                break
            shared += 1
        digits = F.substring(F.hex(F.substring(F.col(name), shared + 1, 6).cast("binary")), 1, 12)
        return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def _bucketed(df: DataFrame, first: str, buckets: int, is_draw: bool = False) -> DataFrame:
    """Add ``_bucket``, increasing with the first order column and about equally filled."""
    if is_draw:  # uniform in [0, 1): the limits are known without a pass over the data
        return df.withColumn("_bucket", F.floor(F.col(first) * buckets).cast("double"))
    df = df.withColumn("_image", _image(df, first))
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0.0)).drop("_image")
    cuts = df.agg(F.percentile_approx("_image", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    edges = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    if len(edges) < 3:
        return df.withColumn("_bucket", F.lit(0.0)).drop("_image")
    return Bucketizer(splits=edges, inputCol="_image", outputCol="_bucket").transform(df).drop("_image")


def running_total(df: DataFrame, by, order, weights: Column | dict[str, Column], total: str = "running",
                  size: str | None = None, buckets: int | None = None, is_draw: bool = False) -> DataFrame:
    """Add the inclusive running sum of each weight within ``by`` under ``order`` (unique columns).

    The input is read two or three times (bucket limits, bucket counts, ranks): write it first if it
    is costly to make.  ``by`` and ``order`` columns hold no nulls (rows with nulls are dropped when a table is loaded).
    ``weights`` is one column (its sum is named ``total``) or several by name.  ``size`` names an
    extra column with the first weight's sum over the whole group; ``is_draw`` says that the first
    order column is uniform in [0, 1).
    """
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    named = weights if isinstance(weights, dict) else {total: weights}
    buckets = buckets or min(shuffle_width(df), 10_000)
    cut = _bucketed(df.withColumns({f"_w{i}": w for i, w in enumerate(named.values())}), order[0], buckets, is_draw)
    keys, slots = [*by, "_bucket"], range(len(named))
    sofar = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.withColumns({f"_w{i}": F.sum(f"_w{i}").over(sofar) for i in slots})
    per_bucket = cut.groupBy(*keys).agg(*[F.sum(f"_w{i}").alias(f"_n{i}") for i in slots])
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, *[F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in slots],
        *([F.sum("_n0").over(W.partitionBy(*by)).alias(size)] if size else []))
    return local.join(offsets, keys) \
                .withColumns({name: F.col(f"_w{i}") + F.col(f"_b{i}") for i, name in enumerate(named)}) \
                .drop("_bucket", *[f"_w{i}" for i in slots], *[f"_b{i}" for i in slots])


def ranked(df: DataFrame, by, order, rank: str = "rank", size: str | None = None,
           buckets: int | None = None, is_draw: bool = False) -> DataFrame:
    """Add the one-based rank of each row within ``by`` under ``order``; ``size`` and ``is_draw`` as above."""
    return running_total(df, by, order, F.lit(1).cast("long"), rank, size, buckets, is_draw)


def fold_of(rank: Column, size: Column, k: int) -> Column:
    """The ``ntile(k)`` block of a one-based rank in a group of ``size`` rows."""
    small = F.floor(size / k).cast("long")
    extra = (size - small * k).cast("long")
    head = extra * (small + 1)
    place = rank - 1
    return F.when(place < head, F.floor(place / (small + 1))) \
            .otherwise(extra + F.floor((place - head) / F.greatest(small, F.lit(1)))).cast("int") + 1


def expand(need: DataFrame, count: str, copy: str = "copy", chunk: int = 65_536) -> DataFrame:
    """One row per copy 1..``count`` of each row, in two steps so that no task writes them all.

    The first step makes chunks, the second spreads the chunks over the executors and fills them.
    The number of tasks is set by hand: before they are filled, the chunks look too small to spread.
    For the same reason the copies carry a merge-join hint, or a join would gather them on the driver to broadcast them.
    """
    last = F.ceil(F.col(count) / chunk).cast("long") - 1
    spread = need.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    keys = [c for c in need.columns if not isinstance(need.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))]
    spread = spread.repartition(shuffle_width(need), *keys, "_chunk")
    begin = F.col("_chunk") * chunk
    return spread.withColumn(copy, F.explode(F.sequence(begin + 1, F.least(begin + chunk, F.col(count).cast("long"))))) \
                 .drop("_chunk").hint("merge")
