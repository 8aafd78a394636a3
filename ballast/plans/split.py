"""Folds, and real against synthetic tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.ranks import fold_of, ranked
from ballast.spec import refuse_stream


def stratified_folds(df: DataFrame, label: str, row_id, k: int = 5, out: str = "fold") -> DataFrame:
    """Add a fold 1..k: contiguous, class-proportional blocks in row id order.

    The block is computed from the row's rank in its class; folds of a class differ by at most one
    row, extra rows go to the low folds.
    """
    refuse_stream(df, "stratified_folds")
    order = [row_id] if isinstance(row_id, str) else list(row_id)
    placed = ranked(df, label, order, "_rank", size="_size")
    return placed.withColumn(out, fold_of(F.col("_rank"), F.col("_size"), k)).drop("_rank", "_size")


def real_vs_synthetic(real: DataFrame, synth: DataFrame, cols, tag: str = "is_real") -> DataFrame:
    """Both tables below each other, real rows tagged 1 and synthetic ones 0."""
    return real.select(*cols, F.lit(1).alias(tag)).unionByName(synth.select(*cols, F.lit(0).alias(tag)))
