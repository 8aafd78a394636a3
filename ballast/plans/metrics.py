"""Classification scores from one confusion table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The scores of the published experiments, in their order.
SCORERS = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "f1", "precision", "recall")
AVERAGES = ("binary", "micro", "weighted")


def confusion(df: DataFrame, keys, y: str, pred: str) -> DataFrame:
    """(keys..., y, pred, n): the only pass over the predictions."""
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def scores(table: DataFrame, keys, average: str | Column = "weighted", positive=None) -> DataFrame:
    """(keys..., scorer, value) for all seven scores.

    ``average``: ``binary`` (scores of the class ``positive``, the largest label of the whole table if not
    given; a key in which it never occurs scores 0), ``micro`` (pooled over the classes) or ``weighted`` (by
    class size).  Zero divisions give 0.  Balanced accuracy is the mean recall of the classes that occur.
    """
    if average not in AVERAGES:
        raise ValueError(f"unknown average {average!r}; known: {', '.join(AVERAGES)}")
    named, keys = list(keys), list(keys) or ["_all"]
    if not named:
        table = table.withColumn("_all", F.lit(0))
    true_side = table.select(*keys, F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                             F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    pred_side = table.select(*keys, F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp"))
    per = true_side.unionByName(pred_side).groupBy(*keys, "c").agg(*[F.sum(x).alias(x) for x in ("t", "p", "tp")])
    everything = table.groupBy(*keys).agg(F.sum("n").alias("all"))
    if average == "binary" and positive is None:
        positive = table.agg(F.max(F.greatest("y", "pred"))).first()[0]
    per = per.join(everything, keys)  # both sides hold a few rows per key
    t, p, tp, n = (F.col(x) for x in ("t", "p", "tp", "all"))
    tn = n - t - p + tp
    recall, precision, special = _ratio(tp, t), _ratio(tp, p), _ratio(tn, tn + p - tp)
    f1 = _ratio(2 * tp, t + p)
    total = F.sum("t")
    if average == "weighted":
        pick = lambda x: F.sum(x * t) / total
        out = {"sensitivity": pick(recall), "specificity": pick(special), "f1": pick(f1), "precision": pick(precision), "recall": pick(recall)}
    elif average == "micro":
        s = lambda x: F.sum(x)
        r = _ratio(s(tp), s(t))
        out = {"sensitivity": r, "specificity": _ratio(s(tn), s(tn + p - tp)), "f1": _ratio(2 * s(tp), s(t + p)), "precision": _ratio(s(tp), s(p)), "recall": r}
    else:
        only = lambda x: F.coalesce(F.max(F.when(F.col("c") == F.lit(positive), x)), F.lit(0.0))
        out = {"sensitivity": only(recall), "specificity": only(special), "f1": only(f1), "precision": only(precision), "recall": only(recall)}
    out["accuracy"] = F.sum("tp") / total
    out["balanced_accuracy"] = F.avg(F.when(t > 0, tp / F.when(t > 0, t)))
    wide = per.groupBy(*keys).agg(*[out[s].cast("double").alias(s) for s in SCORERS])
    return wide.unpivot(keys, list(SCORERS), "scorer", "value").select(*named, "scorer", "value")


def summarize_results(results: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds per data set, sampler, classifier and scorer."""
    return results.groupBy("Dataset", "Sampler", "Classifier", "Scorer") \
        .agg(F.avg("Val").alias("Mean"), F.stddev_pop("Val").alias("Std"))


def compare_distributions(real: DataFrame, resampled: DataFrame, label: str) -> DataFrame:
    """(label, real, resampled): class counts side by side, 0 where a class is absent."""
    a = real.groupBy(label).agg(F.count(F.lit(1)).alias("real"))
    b = resampled.groupBy(label).agg(F.count(F.lit(1)).alias("resampled"))
    return a.join(b, label, "full").na.fill(0, ["real", "resampled"])
