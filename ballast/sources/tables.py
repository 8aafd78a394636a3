"""Readers, and the registry that maps data set names to files and column roles."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.bounds import shuffle_width
from ballast.spec import TableSpec, infer_spec

# The tokens a CSV reader of the reference's kind takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<null>",
)


def _typed(df: DataFrame) -> DataFrame:
    """Give string columns the narrowest of long, double and string, found in one pass."""
    whole = r"^[+-]?[0-9]{1,18}$"
    checks = []
    for i, c in enumerate(df.columns):
        seen = F.col(f"`{c}`").isNotNull()
        checks.append(F.coalesce(F.bool_and(F.when(seen, F.col(f"`{c}`").rlike(whole))), F.lit(False)).alias(f"w{i}"))
        checks.append(F.coalesce(F.bool_and(F.when(seen, F.col(f"`{c}`").try_cast("double").isNotNull())),
                                 F.lit(False)).alias(f"d{i}"))
    found = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        kind = "long" if found[f"w{i}"] else "double" if found[f"d{i}"] else "string"
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, format: str | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table; without ``format`` the file name decides (csv, parquet, else JSON lines).

    CSV: header, UTF-8, blanks after the delimiter dropped, missing-value tokens become null and
    column types are found from the data unless a schema is given.  Gzipped JSON lines cannot be
    split, so they are spread over the cluster after reading.
    """
    if format is None:
        name = path.rstrip("/").lower()
        format = "csv" if name.endswith(".csv") else "parquet" if name.endswith(".parquet") else "jsonl.gz"
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "csv":
        raw = spark.read.csv(path, header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True,
                             inferSchema=False, escape='"')
        clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c)
                             for c in raw.columns])
        if schema is None:
            return _typed(clean)
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return clean.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])
    if format in ("jsonl", "jsonl.gz", "json"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        table = reader.json(path)
        return table.repartition(shuffle_width(table)) if format == "jsonl.gz" else table
    raise ValueError(f"unknown table format {format!r}")


@dataclass
class DatasetRegistry:
    """Named data sets an experiment loops over."""

    entries: dict[str, dict] = field(default_factory=dict)

    def add(self, name: str, path: str, label: str, row_id, categorical=None, format: str | None = None,
            load: Callable[[SparkSession], DataFrame] | None = None) -> "DatasetRegistry":
        self.entries[name] = dict(path=path, label=label, row_id=row_id, categorical=categorical,
                                  format=format, load=load)
        return self

    def load(self, spark: SparkSession, name: str) -> tuple[DataFrame, TableSpec]:
        if name not in self.entries:
            raise KeyError(f"no data set named {name!r}; known: {', '.join(sorted(self.entries))}")
        e = self.entries[name]
        df = e["load"](spark) if e["load"] else read_table(spark, e["path"], e["format"])
        df = df.na.drop("any")
        return df, infer_spec(df, e["label"], e["row_id"], e["categorical"])

    def each(self, spark: SparkSession, run: Callable[[DataFrame, TableSpec], DataFrame]) -> DataFrame:
        """Run on every data set; the results are stacked with a ``dataset`` column in front."""
        parts = []
        for name in self.entries:
            out = run(*self.load(spark, name))
            parts.append(out.select(F.lit(name).alias("dataset"), *out.columns))
        return reduce(DataFrame.unionByName, parts)
