"""Preparing a table with a class column."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.bounds import MAX_MODEL_ROWS, collect_bounded, join_model
from ballast.functions.draws import normal, uniform
from ballast.functions.ranks import ranked
from ballast.spec import TableSpec, refuse_stream, validate_columns


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Keep rows without any null."""
    return df.na.drop("any")


def label_last(df: DataFrame, label: str) -> DataFrame:
    """Move the class column to the end."""
    validate_columns(df, [label])
    return df.select(*[c for c in df.columns if c != label], label)


def ordinal_names(df: DataFrame) -> DataFrame:
    """Rename columns to "0".."n-1"."""
    return df.toDF(*[str(i) for i in range(len(df.columns))])


def trim_label(df: DataFrame, label: str) -> DataFrame:
    """Strip white space around a string label; other types stay."""
    if not isinstance(df.schema[label].dataType, T.StringType):
        return df
    return df.withColumn(label, F.regexp_replace(label, r"^\s+|\s+$", ""))


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column, value, n) for several columns in one shuffle; values as strings."""
    narrow = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return narrow.unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull()) \
                 .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


class LabelEncoding:
    """Whole-number codes by sorted distinct value, one code table per column."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each value by its code; a value unseen at fit time becomes null."""
        for c, codes in self.tables.items():
            df = join_model(df, codes.withColumnRenamed("value", c), c, "left") \
                .withColumn(c, F.col("code")).drop("code").select(*df.columns)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for c, codes in self.tables.items():
            df = join_model(df, codes.withColumnRenamed("code", c), c, "left") \
                .withColumn(c, F.col("value")).drop("value").select(*df.columns)
        return df


def label_encode(df: DataFrame, cols) -> LabelEncoding:
    """Fit codes for the given columns."""
    refuse_stream(df, "label_encode")
    tables = {}
    for c in cols:
        seen = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        few = seen.select("value").limit(MAX_MODEL_ROWS + 1).collect()
        if len(few) <= MAX_MODEL_ROWS:
            pairs = [(v, i) for i, v in enumerate(sorted(r["value"] for r in few))]
            schema = T.StructType([T.StructField("value", df.schema[c].dataType), T.StructField("code", T.IntegerType())])
            tables[c] = df.sparkSession.createDataFrame(pairs, schema)
        else:
            tables[c] = ranked(seen.drop("n"), [], "value").select("value", (F.col("rank") - 1).cast("int").alias("code"))
    return LabelEncoding(tables)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def describe_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Class distribution, largest first, with the table's size and imbalance ratio on each row.

    One aggregation reads the table; the totals come from its class counts.
    """
    counts = collect_bounded(class_counts(df, spec.label), "classes")
    total, largest = sum(r["n"] for r in counts), max((r["n"] for r in counts), default=0)
    out = df.sparkSession.createDataFrame([(r[spec.label], r["n"]) for r in counts],
                                          T.StructType([df.schema[spec.label], T.StructField("n", T.LongType())]))
    return out.select(
        F.col(spec.label), "n", (F.col("n") / F.lit(total)).alias("share"),
        (F.lit(largest) / F.col("n")).alias("imbalance_ratio"),
        F.lit(total).cast("long").alias("rows"), F.lit(len(spec.features) + 1).cast("long").alias("columns"),
        F.lit(len(spec.categorical)).cast("long").alias("categorical"),
        F.lit(len(counts)).cast("long").alias("classes")).orderBy(F.desc("n"), spec.label)


def one_hot_columns(df: DataFrame, cols, max_values: int = 1000) -> DataFrame:
    """Replace each column by 0/1 columns ``column_value``, values in sorted order."""
    found = collect_bounded(value_counts(df, cols).select("column", "value"), "one-hot values",
                            max_values * len(list(cols)))
    by_column: dict[str, list[str]] = {}
    for r in found:
        by_column.setdefault(r["column"], []).append(r["value"])
    dummies = [F.when(F.col(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}")
               for c in cols for v in sorted(by_column.get(c, []))]
    return df.select(*[c for c in df.columns if c not in cols], *dummies)


def shuffle(df: DataFrame, row_id, seed: int = 42, position: str = "position") -> DataFrame:
    """Add a seeded random position 1..n.  Ordering by it gives the shuffled table."""
    refuse_stream(df, "shuffle")
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    drawn = df.withColumn("_draw", uniform("shuffle", *ids, seed=seed))
    return ranked(drawn, [], ["_draw", *ids], position, is_draw=True).drop("_draw")


def make_classification(spark: SparkSession, n: int, ratios, seed: int = 42, sep: float | None = None) -> DataFrame:
    """A generated table (id, f0, f1, label): one Gaussian cloud per class, sizes by ``ratios``.

    Two or four classes sit on the corners of a square with half side 0.5 or 1.0.
    """
    if len(ratios) not in (2, 4):
        raise ValueError("two or four classes")
    sep = sep or (0.5 if len(ratios) == 2 else 1.0)
    whole = float(sum(ratios))
    edges, run = [], 0.0
    for r in ratios:
        run += r
        edges.append(round(n * run / whole))
    label = F.lit(len(ratios) - 1)
    for i in range(len(ratios) - 2, -1, -1):
        label = F.when(F.col("id") < edges[i], F.lit(i)).otherwise(label)
    rows = spark.range(n).withColumn("label", label)
    x = F.when(F.col("label") % 2 == 0, -sep).otherwise(sep)
    y = F.when(F.col("label") < 2, -sep).otherwise(sep)
    return rows.select("id", (x + normal("make.x", "id", seed=seed)).alias("f0"),
                       (y + normal("make.y", "id", seed=seed)).alias("f1"), "label")


def column_kinds(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, kind, min, max, categories) for every feature and the label, from one aggregation."""
    cols = [*spec.features, *([spec.label] if spec.label else [])]
    kind = {c: "categorical" if c in spec.categorical or c == spec.label else
            "mixed" if c in spec.mixed else "general" if c in spec.general else "continuous" for c in cols}
    discrete = [c for c in cols if kind[c] == "categorical"]
    numeric = [c for c in cols if kind[c] != "categorical"]
    aggs = [f(F.col(c).cast("double")).alias(f"{t}_{i}") for i, c in enumerate(numeric)
            for t, f in (("lo", F.min), ("hi", F.max))]
    limits = df.agg(*aggs).first() if aggs else {}
    n_values = {}
    if discrete:
        n_values = {r["column"]: r["k"] for r in
                    value_counts(df, discrete).groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    rows = []
    for c in cols:
        if c in numeric:
            i = numeric.index(c)
            rows.append((c, kind[c], limits[f"lo_{i}"], limits[f"hi_{i}"], None))
        else:
            rows.append((c, kind[c], None, None, n_values.get(c, 0)))
    return df.sparkSession.createDataFrame(rows, "column STRING, kind STRING, min DOUBLE, max DOUBLE, categories BIGINT")


def low_cardinality(df: DataFrame, cols, label: str) -> DataFrame:
    """Flag columns with fewer distinct values than twice the number of classes.

    Distinct values are counted by two plain group-bys, so no row is expanded per column set.
    """
    validate_columns(df, [*cols, label])
    per_column = value_counts(df, [*cols, label]).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    sizes = {r["column"]: r["distinct_values"] for r in per_column.collect()}
    limit = 2 * sizes.get(label, 0)
    rows = [(c, sizes.get(c, 0), sizes.get(c, 0) < limit) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column STRING, distinct_values BIGINT, is_categorical BOOLEAN")


def stack_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
