"""Result tables of the experiments: scores, failures and training logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the published result files.
RESULT_SCHEMA = "Dataset STRING, Fold INT, Sampler STRING, Classifier STRING, Scorer STRING, Val DOUBLE"
ERROR_SCHEMA = "Sampler STRING, Dataset STRING, Fold INT, Seed INT, Message STRING"


def sorted_results(df: DataFrame) -> DataFrame:
    return df.orderBy("Dataset", "Sampler", "Scorer", "Fold", "Classifier")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write scores as CSV, sorted by data set, sampler, scorer and fold."""
    sorted_results(df).write.mode(mode).csv(path, header=True)


def error_rows(spark: SparkSession, errors: list[tuple]) -> DataFrame:
    """Failed runs as a table; the experiment that met them carries on."""
    return spark.createDataFrame(errors, ERROR_SCHEMA)


def append_errors(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def history_means(df: DataFrame, step: str, metrics) -> DataFrame:
    """Mean of each metric per step of an iteration log."""
    return df.groupBy(step).agg(*[F.avg(m).alias(m) for m in metrics])
