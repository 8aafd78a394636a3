"""Guards for the few places where data reaches the driver or is broadcast."""
from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Largest model table (classes, clusters, categories, bins) that may be collected or broadcast.
MAX_MODEL_ROWS = 100_000
# And its largest size, as counted by :func:`size_of`.
MAX_MODEL_BYTES = 64 << 20


class BoundExceeded(ValueError):
    """A table that should be small is not."""


def collect_bounded(df: DataFrame, what: str, max_rows: int = MAX_MODEL_ROWS) -> list[Row]:
    """Collect a model table, refusing one that outgrew its bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise BoundExceeded(f"{what}: more than {max_rows} rows")
    return rows


def size_of(value) -> int:
    """Bytes of a collected value: texts by length, numbers as 16, lists by their entries."""
    if isinstance(value, (str, bytes, bytearray)):
        return 16 + len(value)
    if isinstance(value, dict):
        return 16 + sum(size_of(k) + size_of(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return 16 + sum(map(size_of, value))
    return 16


def checked_broadcast(model: DataFrame, max_rows: int = MAX_MODEL_ROWS) -> DataFrame:
    """The model ready to be joined: broadcast if its rows and bytes stay within the bounds.

    A larger one keeps a merge-join hint; adaptive execution then splits skewed keys of the data
    (the model is unique per key).
    """
    rows = []
    size = 0
    for row in model.limit(max_rows + 1).toLocalIterator():  # a partition at a time, so that a large model is not gathered
        rows.append(row)
        size += size_of(row)
        if len(rows) > max_rows or size > MAX_MODEL_BYTES:
            return model.hint("merge")
    return F.broadcast(model.sparkSession.createDataFrame(rows, model.schema))


def join_model(df: DataFrame, model: DataFrame, on, how: str = "inner",
               max_rows: int = MAX_MODEL_ROWS) -> DataFrame:
    """Join a model table to the data, see :func:`checked_broadcast`."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(checked_broadcast(model, max_rows), on, how)


def shuffle_width(df: DataFrame) -> int:
    """The number of buckets that spreads a table over the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
