"""How many rows to create per class, or per class and cluster."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ballast.functions.bounds import collect_bounded
from ballast.operators.prepare import class_counts
from ballast.spec import refuse_stream

# Fixed value: classes below this share of a cluster's majority are left alone.
MIN_CLUSTER_RATIO = 0.01


@dataclass(frozen=True)
class CountPlan:
    """Rows present and rows to create per class; ``keep_real`` is false for a synthetic-only table."""

    label: str
    counts: dict
    need: dict
    keep_real: bool = True

    @property
    def targets(self) -> list:
        """Classes that get new rows."""
        return [c for c, k in self.need.items() if k > 0]

    def table(self, df: DataFrame) -> DataFrame:
        """(label, n, need), one row per class."""
        schema = T.StructType([T.StructField(self.label, df.schema[self.label].dataType),
                               T.StructField("n", T.LongType()), T.StructField("need", T.LongType())])
        return df.sparkSession.createDataFrame([(c, self.counts[c], self.need.get(c, 0)) for c in sorted(self.counts)], schema)


def plan_counts(df: DataFrame, label: str, strategy: str | float | dict | Callable = "auto") -> CountPlan:
    """Rows to create per class.

    * ``auto`` / ``not majority``, ``minority``, ``not minority``, ``all``: raise the named classes to
      the size of the largest (ties for largest or smallest: the smaller label);
    * a number (two classes only): minority size / majority size afterwards;
    * a dict, or a function from class counts to a dict: target sizes after resampling;
    * ``create-new``: as many rows as each class has, without the real rows.
    """
    refuse_stream(df, "plan_counts")
    counts = {r[label]: r["n"] for r in collect_bounded(class_counts(df, label), "classes", 10_000)}
    counts = dict(sorted(counts.items()))
    if not counts:
        return CountPlan(label, {}, {})
    if callable(strategy):
        strategy = strategy(dict(counts))
    top = max(counts.values())
    largest = next(c for c, n in counts.items() if n == top)
    smallest = min(counts, key=lambda c: (counts[c], list(counts).index(c)))
    if isinstance(strategy, dict):
        unknown = [c for c in strategy if c not in counts]
        if unknown:
            raise ValueError(f"classes not in the table: {unknown}")
        small = [c for c, k in strategy.items() if k < counts[c]]
        if small:
            raise ValueError(f"target below the present size for classes {small}")
        return CountPlan(label, counts, {c: int(strategy.get(c, n)) - n for c, n in counts.items()})
    if isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        if len(counts) != 2:
            raise ValueError("a ratio needs exactly two classes")
        minor = smallest if smallest != largest else [c for c in counts if c != largest][0]
        extra = int(top * float(strategy)) - counts[minor]
        if extra < 0:
            raise ValueError("the ratio asks for fewer minority rows than there are")
        return CountPlan(label, counts, {c: extra if c == minor else 0 for c in counts})
    chosen = {
        "auto": [c for c in counts if c != largest],
        "not majority": [c for c in counts if c != largest],
        "minority": [smallest],
        "not minority": [c for c in counts if c != smallest],
        "all": list(counts),
    }
    if strategy == "create-new":
        return CountPlan(label, counts, dict(counts), keep_real=False)
    if strategy not in chosen:
        raise ValueError(f"unknown strategy {strategy!r}")
    return CountPlan(label, counts, {c: top - n if c in chosen[strategy] else 0 for c, n in counts.items()})


def imbalance_matrix(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, n, majority_class, majority_n) for each class present in a cluster."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    # at most one row per class in a cluster; ties go to the smaller label
    order = W.partitionBy(cluster).orderBy(F.desc("n"), label)
    return counts.withColumn("majority_class", F.first(label).over(order)).withColumn("majority_n", F.first("n").over(order))


def balance_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, n, need): raise minority classes to the majority size of each cluster.

    The global majority class and classes with at most a hundredth of the cluster's majority are
    left as they are.
    """
    counts = {r[label]: r["n"] for r in collect_bounded(class_counts(df, label), "classes", 10_000)}
    top = min(counts, key=lambda c: (-counts[c], c))
    gap = F.col("majority_n") - F.col("n")
    raised = (F.col(label) != F.col("majority_class")) & (F.col(label) != F.lit(top)) \
        & (F.col("n") / F.col("majority_n") > MIN_CLUSTER_RATIO)
    return imbalance_matrix(df, cluster, label).select(cluster, label, "n", F.when(raised, gap).otherwise(0).cast("long").alias("need"))
