"""Queries for splits, metrics and experiments."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.operators.resample import random_oversample
from ballast.plans import evaluate as V
from ballast.plans import fixtures as X
from ballast.plans import metrics as M
from ballast.plans.registry import pick_sql, query
from ballast.plans.split import real_vs_synthetic, stratified_folds
from ballast.sources.results import RESULT_SCHEMA


@query("i1_stratified_folds", sql=f"""
WITH {X.RARE_SQL} SELECT line_id, rare, CAST(ntile(5) OVER (PARTITION BY rare ORDER BY line_id) AS INTEGER) AS fold FROM rare_lines""")
def i1(spark, sf):
    return stratified_folds(X.rare_lines(spark, sf).select("line_id", "rare"), "rare", "line_id", 5)


@query("i1_stratified_folds_numeric_id", sql="""
SELECT o_orderkey, o_orderstatus, CAST(ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS fold FROM orders""")
def i1_num(spark, sf):
    return stratified_folds(X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 7)


@query("i2_real_vs_synthetic", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic),
k AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rank FROM toxic_docs),
d AS (SELECT toxic, {pick_sql('ros', 'n', 'toxic', 'copy')} AS rank FROM (SELECT toxic, unnest(generate_series(1, n)) AS copy, n FROM c))
SELECT n_chars, lang, toxic, 1 AS is_real FROM toxic_docs UNION ALL SELECT n_chars, lang, d.toxic, 0 FROM d JOIN k USING (toxic, rank)""")
def i2(spark, sf):
    t = X.toxic_docs(spark, sf)
    return real_vs_synthetic(t, random_oversample(t, X.TOXIC, "create-new"), ["n_chars", "lang", "toxic"])


@query("i4_classifiers")
def i4(spark, sf):
    p = V.prepare(X.toxic_docs(spark, sf), X.TOXIC)
    xy = V._xy(p.rows, X.TOXIC.features, "toxic")
    parts, rows = [], xy.count()
    for name, build in V.classifiers(0).items():
        table = M.confusion(V.fit_predict(build(3, 2, rows), xy, xy), [], "label", "prediction")
        parts.append(table.select(F.lit(name).alias("classifier"), "y", "pred", "n"))
    from ballast.operators.prepare import stack_all
    return stack_all(parts)


# A rule stands in for a classifier, so that SQL can repeat the scores exactly.
_PRED = """
p AS (SELECT o_orderpriority AS k, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
  CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_custkey % 3 = 0 THEN 1 ELSE CAST(o_orderkey % 3 AS INTEGER) END AS pred FROM orders)"""
_PER = """
t AS (SELECT k, y AS c, count(*) AS t, 0 AS p, count(CASE WHEN y = pred THEN 1 END) AS tp FROM p GROUP BY 1, 2 UNION ALL SELECT k, pred, 0, count(*), 0 FROM p GROUP BY 1, 2),
c AS (SELECT k, c, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(tp) AS DOUBLE) AS tp FROM t GROUP BY 1, 2),
a AS (SELECT *, sum(t) OVER (PARTITION BY k) - t - p + tp AS tn FROM c)"""


def _rule(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("k"),
                    F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"),
                    F.when(F.col("o_totalprice") < 100000, 0).when(F.col("o_custkey") % 3 == 0, 1).otherwise((F.col("o_orderkey") % 3).cast("int")).alias("pred"))


@query("i5_accuracy", sql=f"""
WITH {_PRED}, {_PER} SELECT k, 'accuracy' AS scorer, round(sum(tp) / sum(t), 6) AS value FROM a GROUP BY k
UNION ALL SELECT k, 'balanced_accuracy', round(avg(tp / t), 6) FROM a WHERE t > 0 GROUP BY k""")
def i5(spark, sf):
    out = M.scores(M.confusion(_rule(spark, sf), ["k"], "y", "pred"), ["k"], "weighted")
    return out.where(F.col("scorer").isin("accuracy", "balanced_accuracy")).withColumn("value", F.round("value", 6))


@query("i6_precision_recall_f1_weighted", sql=f"""
WITH {_PRED}, {_PER} SELECT k, 'precision' AS scorer, round(sum(t * CASE WHEN p > 0 THEN tp / p ELSE 0 END) / sum(t), 6) AS value FROM a GROUP BY k
UNION ALL SELECT k, 'recall', round(sum(t * CASE WHEN t > 0 THEN tp / t ELSE 0 END) / sum(t), 6) FROM a GROUP BY k
UNION ALL SELECT k, 'f1', round(sum(t * CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END) / sum(t), 6) FROM a GROUP BY k""")
def i6(spark, sf):
    out = M.scores(M.confusion(_rule(spark, sf), ["k"], "y", "pred"), ["k"], "weighted")
    return out.where(F.col("scorer").isin("precision", "recall", "f1")).withColumn("value", F.round("value", 6))


@query("i6_scores_micro", sql=f"""
WITH {_PRED}, {_PER} SELECT k, unnest(['precision', 'recall', 'f1', 'sensitivity']) AS scorer, round(sum(tp) / sum(t), 6) AS value FROM a GROUP BY k
UNION ALL SELECT k, 'specificity', round(sum(tn) / sum(tn + p - tp), 6) FROM a GROUP BY k""")
def i6_micro(spark, sf):
    out = M.scores(M.confusion(_rule(spark, sf), ["k"], "y", "pred"), ["k"], "micro")
    return out.where(~F.col("scorer").isin("accuracy", "balanced_accuracy")).withColumn("value", F.round("value", 6))


@query("i6_scores_binary", sql=f"""
WITH {_PRED.replace('p AS (', 'p0 AS (')}, p AS (SELECT k, CAST(y = 2 AS INTEGER) AS y, CAST(pred = 2 AS INTEGER) AS pred FROM p0), {_PER}, o AS (SELECT * FROM a WHERE c = 1)
SELECT k, 'precision' AS scorer, round(tp / p, 6) AS value FROM o UNION ALL SELECT k, 'recall', round(tp / t, 6) FROM o UNION ALL SELECT k, 'sensitivity', round(tp / t, 6) FROM o
UNION ALL SELECT k, 'f1', round(2 * tp / (t + p), 6) FROM o UNION ALL SELECT k, 'specificity', round(tn / (tn + p - tp), 6) FROM o""")
def i6_binary(spark, sf):
    r = _rule(spark, sf).select("k", (F.col("y") == 2).cast("int").alias("y"), (F.col("pred") == 2).cast("int").alias("pred"))
    out = M.scores(M.confusion(r, ["k"], "y", "pred"), ["k"], "binary")
    return out.where(~F.col("scorer").isin("accuracy", "balanced_accuracy")).withColumn("value", F.round("value", 6))


@query("i7_sensitivity_specificity", sql=f"""
WITH {_PRED}, {_PER} SELECT k, 'sensitivity' AS scorer, round(sum(t * CASE WHEN t > 0 THEN tp / t ELSE 0 END) / sum(t), 6) AS value FROM a GROUP BY k
UNION ALL SELECT k, 'specificity', round(sum(t * CASE WHEN tn + p - tp > 0 THEN tn / (tn + p - tp) ELSE 0 END) / sum(t), 6) FROM a GROUP BY k""")
def i7(spark, sf):
    out = M.scores(M.confusion(_rule(spark, sf), ["k"], "y", "pred"), ["k"], "weighted")
    return out.where(F.col("scorer").isin("sensitivity", "specificity")).withColumn("value", F.round("value", 6))


FAST = ["Logistic Regression", "Decision Tree"]


@query("i9_eval_resampling")
def i9(spark, sf):
    results, _ = V.eval_resampling("toxic", X.toxic_docs(spark, sf), X.TOXIC, ["ROS", "SMOTE"], FAST, folds=2)
    return results.where("Scorer <> 'Fit Time'")


@query("i10_eval_detectability")
def i10(spark, sf):
    results, _ = V.eval_detectability("toxic", X.toxic_docs(spark, sf), X.TOXIC, ["GCOP"], FAST, folds=2)
    return results


_SCORES = """
r AS (SELECT o_orderpriority AS "Dataset", CAST(o_custkey % 5 + 1 AS INTEGER) AS "Fold", o_orderstatus AS "Sampler", 'rule' AS "Classifier", 'price' AS "Scorer",
  avg(o_totalprice) / 100000 AS "Val" FROM orders GROUP BY ALL)"""


def _score_rows(spark, sf):
    return X.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("Dataset"), (F.col("o_custkey") % 5 + 1).cast("int").alias("Fold"), F.col("o_orderstatus").alias("Sampler")) \
        .agg((F.avg("o_totalprice") / 100000).alias("Val")) \
        .select("Dataset", "Fold", "Sampler", F.lit("rule").alias("Classifier"), F.lit("price").alias("Scorer"), "Val")


@query("i11_summarize_results", sql=f"""
WITH {_SCORES} SELECT "Dataset", "Sampler", "Classifier", "Scorer", round(avg("Val"), 6) AS "Mean", round(stddev_pop("Val"), 6) AS "Std" FROM r GROUP BY ALL""")
def i11(spark, sf):
    return M.summarize_results(_score_rows(spark, sf)).withColumns({"Mean": F.round("Mean", 6), "Std": F.round("Std", 6)})


@query("i12_fidelity_difference", sql=f"""
WITH {_SCORES} SELECT a."Dataset", a."Fold", a."Sampler", a."Classifier", a."Scorer", round(b."Val", 6) AS "Real", round(a."Val", 6) AS "Synthetic", round(abs(b."Val" - a."Val"), 6) AS "Difference"
FROM r a JOIN r b ON a."Dataset" = b."Dataset" AND a."Fold" = b."Fold" WHERE a."Sampler" <> 'F' AND b."Sampler" = 'F'""")
def i12_diff(spark, sf):
    out = V.fidelity_difference(_score_rows(spark, sf), baseline="F")
    return out.withColumns({c: F.round(c, 6) for c in ("Real", "Synthetic", "Difference")})


@query("i12_eval_fidelity")
def i12(spark, sf):
    results, _ = V.eval_fidelity("toxic", X.toxic_docs(spark, sf), X.TOXIC, ["ROS"], FAST, folds=2)
    return results


@query("i13_eval_resampler_cv")
def i13(spark, sf):
    _, means, _ = V.eval_pipeline_cv("toxic", X.toxic_docs(spark, sf), X.TOXIC, "ROS", FAST, folds=2)
    return means.where("Scorer <> 'Fit Time'")


@query("i14_eval_discretization")
def i14(spark, sf):
    results, _ = V.eval_discretization("toxic", X.toxic_docs(spark, sf), X.TOXIC, [("bins-uni", 4, None), ("caim", None, None)], FAST[:1], folds=2)
    return results


@query("i16_run_single", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT count(*) AS n FROM toxic_docs GROUP BY toxic)
SELECT 'SMOTE' AS sampler, CAST(2 * max(n) AS BIGINT) AS rows, CAST(max(n) - min(n) AS BIGINT) AS synthetic FROM c""")
def i16(spark, sf):
    return V.run_single("SMOTE", X.toxic_docs(spark, sf), X.TOXIC).drop("seconds")


@query("i17_compare_distributions", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic) SELECT toxic, n AS real, (SELECT max(n) FROM c) AS resampled FROM c""")
def i17(spark, sf):
    t = X.toxic_docs(spark, sf)
    return M.compare_distributions(t, random_oversample(t, X.TOXIC), "toxic")
