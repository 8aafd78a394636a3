"""Facts that a fitted model must show on the data it was fitted to, next to what SQL can say about the same rows."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ballast.operators import cluster as E
from ballast.operators import discretize as D
from ballast.operators import encode as C
from ballast.operators import modes as M
from ballast.operators import resample as G
from ballast.operators import synth as H
from ballast.operators.kmeans import nearest_of_each
from ballast.plans import fixtures as X
from ballast.plans.registry import query


@query("d3_bins_kmeans_settled", sql="""
SELECT 'l_extendedprice' AS "column", count(*) AS n, true AS settled FROM lineitem UNION ALL SELECT 'l_discount', count(*), true FROM lineitem""")
def d3_settled(spark, sf):
    """One more of Lloyd's steps leaves every edge midway between the means of its bins."""
    t, cols, rows = X.rare_lines(spark, sf), ["l_extendedprice", "l_discount"], []
    model = D.fit_discretizer(t, cols, "bins-k", 4)
    for c in cols:
        bins = t.groupBy(D.bin_code(F.col(c).cast("double"), model.cuts[c]).alias("b")).agg(F.count("*").alias("n"), F.avg(c).alias("m")).orderBy("b").collect()
        span = bins[-1]["m"] - bins[0]["m"]
        middles = [(a["m"] + b["m"]) / 2 for a, b in zip(bins, bins[1:])]
        rows.append((c, sum(r["n"] for r in bins), len(bins) == 4 and all(abs(x - y) < 1e-6 * span for x, y in zip(middles, model.cuts[c]))))
    return spark.createDataFrame(rows, "column STRING, n BIGINT, settled BOOLEAN")


@query("d5_chi_merge_cuts", sql="""
SELECT c AS "column", CAST(6 AS INTEGER) AS bins, true AS cuts_are_values FROM (VALUES ('l_extendedprice'), ('l_discount'), ('l_tax')) v(c)""")
def d5_cuts(spark, sf):
    t, cols = X.rare_lines(spark, sf), ["l_extendedprice", "l_discount", "l_tax"]
    model = D.fit_discretizer(t, cols, "chi-merge", 6, label="rare")
    rows = [(c, len(v) + 1, t.where(F.col(c).isin(v)).select(c).distinct().count() == len(v)) for c, v in model.cuts.items()]
    return spark.createDataFrame(rows, "column STRING, bins INT, cuts_are_values BOOLEAN")


@query("d8_auto_bin_weights_total", sql="""SELECT 'o_totalprice' AS "column", CAST(4 AS BIGINT) AS bins, CAST(1.0 AS DOUBLE) AS weight""")
def d8_total(spark, sf):
    t = X.table(spark, sf, "orders").select("o_totalprice")
    out = D.fit_discretizer(t, ["o_totalprice"], "bins-q", 4, bin_weights="auto").table(t)
    return out.groupBy("column").agg(F.count("*").alias("bins"), F.round(F.sum("weight"), 6).alias("weight"))


@query("c5_yeo_johnson_best", sql="""
SELECT c AS "column", (SELECT count(*) FROM lineitem) AS n, true AS best FROM (VALUES ('l_quantity'), ('l_extendedprice')) v(c)""")
def c5_best(spark, sf):
    """The normal likelihood at the fitted lambda is not below that on either side."""
    cols = ["l_quantity", "l_extendedprice"]
    t = X.table(spark, sf, "lineitem").select(*cols)
    found, rows = C.yeo_johnson_fit(t, cols), []
    for c in cols:
        def loglik(lam):
            x = F.col(c).cast("double")
            r = t.agg(F.count("*").alias("n"), F.var_pop(C.yeo_johnson(x, lam)).alias("v"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s")).first()
            return r["n"], -r["n"] / 2 * math.log(r["v"]) + (lam - 1) * r["s"]
        n, at = loglik(found.lam[c])
        rows.append((c, n, all(at >= loglik(found.lam[c] + d)[1] for d in (-0.02, 0.02))))
    return spark.createDataFrame(rows, "column STRING, n BIGINT, best BOOLEAN")


@query("c7_mode_normalize_fit", sql="""
SELECT 'l_extendedprice' AS "column", count(*) AS n, true AS weights_sum_up, true AS modes_in_range FROM lineitem""")
def c7_fit(spark, sf):
    t = X.rare_lines(spark, sf).select("l_extendedprice")
    modes = M.mixture_1d(t, ["l_extendedprice"])["l_extendedprice"]
    lim = t.agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b")).first()
    used = M.mode_use(t, {"l_extendedprice": modes}).agg(F.sum("n")).first()[0]
    return spark.createDataFrame([("l_extendedprice", used, abs(sum(m.weight for m in modes) - 1) < 1e-9, all(lim["a"] <= m.mean <= lim["b"] and m.sd > 0 for m in modes))],
                                 "column STRING, n BIGINT, weights_sum_up BOOLEAN, modes_in_range BOOLEAN")


@query("e2_choose_k_kmeans_score", sql="SELECT count(*) AS n, true AS least, true AS score_holds FROM lineitem")
def e2_facts(spark, sf):
    """The chosen k has the least score, and the labels give that score again from their moments."""
    found = E.choose_k_kmeans(E.cluster_features(X.rare_lines(spark, sf), X.RARE), max_clusters=E.PUBLISHED_CLUSTERS)
    again = E.inertia_score(found.labelled, "cluster", "features").first()
    return spark.createDataFrame([(found.labelled.count(), found.scores[found.k] == min(found.scores.values()),
                                   again["k"] == found.k and abs(again["score"] - found.scores[found.k]) < 1e-2)], "n BIGINT, least BOOLEAN, score_holds BOOLEAN")


@query("e3_choose_k_mixture_bic", sql="SELECT count(*) AS n, true AS least FROM customer")
def e3_facts(spark, sf):
    spec = X.TableSpec(features=("c_acctbal", "c_nationkey"), label="c_mktsegment", row_id=("c_custkey",))
    found = E.choose_k_mixture(E.cluster_features(X.seg_customers(spark, sf), spec), max_clusters=E.PUBLISHED_CLUSTERS, rounds=E.PUBLISHED_ROUNDS)
    best = found.detail["model"]
    return spark.createDataFrame([(found.labelled.where(F.col("cluster").between(0, best.k - 1)).count(), best.bic == min(found.detail["all"].values()))], "n BIGINT, least BOOLEAN")


@query("e2_scores_of_every_k", sql=f"SELECT k, (SELECT count(*) FROM lineitem) AS n, true AS score_holds FROM range(2, {E.PUBLISHED_CLUSTERS}) t(k)")
def e2_every_k(spark, sf):
    """Every k's score again, from the counts and variances of the rows that its centres label."""
    t = E.cluster_features(X.rare_lines(spark, sf), X.RARE)
    found = E.choose_k_kmeans(t, max_clusters=E.PUBLISHED_CLUSTERS)
    centres = found.detail["centres"]
    dims = len(centres[2][0])
    labels = F.map_from_arrays(F.array(*[F.lit(k) for k in centres]), nearest_of_each("features", list(centres.values())))
    rows = found.labelled.select("features", F.explode(labels).alias("k", "own"))
    per = rows.groupBy("k", "own").agg(F.count("*").alias("n"), *[F.var_pop(F.col("features")[i]).alias(f"v{i}") for i in range(dims)])
    total = E.total_squares(t, "features")
    score = F.sum(F.col("n") * sum((F.col(f"v{i}") for i in range(dims)), F.lit(0.0))) / total + F.col("k") * E.CLUSTER_PENALTY
    fitted = F.create_map(*[v for k, s in found.scores.items() for v in (F.lit(k), F.lit(s))])
    return per.groupBy("k").agg(F.sum("n").alias("n"), (F.abs(score - fitted[F.col("k")]) < 1e-9).alias("score_holds")) \
              .select(F.col("k").cast("long").alias("k"), "n", "score_holds")


# one component has its moments in closed form, so SQL gives the criterion of every kind and class
ONE_COMPONENT = """
WITH s AS (SELECT min(c_acctbal) AS a1, max(c_acctbal) AS b1, min(c_nationkey) AS a2, max(c_nationkey) AS b2 FROM customer),
x AS (SELECT c_mktsegment AS segment, (c_acctbal - a1) / (b1 - a1) AS f, (c_nationkey - a2) / CAST(b2 - a2 AS DOUBLE) AS g FROM customer, s),
m AS (SELECT segment, CAST(count(*) AS DOUBLE) AS n, var_pop(f) AS v, var_pop(g) AS w, covar_pop(f, g) AS c FROM x GROUP BY segment),
d AS (SELECT segment, n, 'full' AS kind, v * w - c * c AS det, 5 AS free FROM m UNION ALL SELECT segment, n, 'tied', v * w - c * c, 5 FROM m
  UNION ALL SELECT segment, n, 'diag', v * w, 4 FROM m UNION ALL SELECT segment, n, 'spherical', (v + w) * (v + w) / 4, 3 FROM m)
SELECT segment, kind, round(n * (2 * ln(2 * pi()) + ln(det) + 2) + free * ln(n), 3) AS bic FROM d"""


@query("e3_bic_of_one_component", sql=ONE_COMPONENT)
def e3_one(spark, sf):
    spec = X.TableSpec(features=("c_acctbal", "c_nationkey"), label="c_mktsegment", row_id=("c_custkey",))
    t = E.cluster_features(X.seg_customers(spark, sf), spec)
    found = E.fit_mixtures(t, "features", [1], group="c_mktsegment", rounds=3, ridge=0.0)
    rows = [(name, m.kind, round(m.bic, 3)) for name, models in found.items() for m in models]
    return spark.createDataFrame(rows, "segment STRING, kind STRING, bic DOUBLE")


@query("e12_class_subspaces_rows", sql=f"WITH {X.TOXIC_SQL} SELECT toxic, count(*) AS n, true AS equal_shares FROM toxic_docs GROUP BY toxic")
def e12_facts(spark, sf):
    spec = X.TableSpec(features=("n_chars",), label="toxic", row_id=("doc_id",))
    rows, model = E.class_subspaces(E.cluster_features(X.toxic_docs(spark, sf), spec), "features", "toxic", max_components=E.PUBLISHED_CLUSTERS, rounds=E.PUBLISHED_ROUNDS)
    shares = model.groupBy("toxic").agg((F.abs(F.sum("p") - 1) < 1e-9).alias("equal_shares"))
    return rows.where("cluster IS NOT NULL").groupBy("toxic").agg(F.count("*").alias("n")).join(shares, "toxic").select("toxic", "n", "equal_shares")


@query("e13_outliers_of_the_majority", sql=f"""
WITH {X.RARE_SQL}, c AS (SELECT rare, count(*) AS n FROM rare_lines GROUP BY rare)
SELECT (SELECT n FROM c WHERE rare = 1) AS kept_minority, true AS only_the_majority, true AS scores_in_range""")
def e13_facts(spark, sf):
    t = X.rare_lines(spark, sf)
    spec = X.TableSpec(features=("l_extendedprice", "l_discount", "l_tax"), label="rare", row_id=("line_id",))
    kept = E.drop_majority_outliers(t, spec, limit=0.6)
    gone = t.join(kept, "line_id", "left_anti")
    score = E.isolation_score(t, spec)
    s = t.agg(F.min(score).alias("a"), F.max(score).alias("b")).first()
    return spark.createDataFrame([(kept.where("rare = 1").count(), gone.where("rare = 1").isEmpty(), 0 < s["a"] <= s["b"] < 1)],
                                 "kept_minority BIGINT, only_the_majority BOOLEAN, scores_in_range BOOLEAN")


_RISE = f"""WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n, min(n_chars) AS a, max(n_chars) AS b FROM toxic_docs GROUP BY toxic)
SELECT toxic, (SELECT max(n) FROM c) - n AS made, true AS inside FROM c WHERE n < (SELECT max(n) FROM c)"""


def _inside(spark, sf, out):
    """New rows lie between rows of their class: lengths in the class's range, categories among its own."""
    t = X.toxic_docs(spark, sf)
    lim = t.groupBy("toxic").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"), F.collect_set("lang").alias("ls"), F.collect_set("source").alias("ss"))
    ok = F.col("n_chars").between(F.col("a"), F.col("b")) & F.array_contains("ls", F.col("lang")) & F.array_contains("ss", F.col("source"))
    return out.where("is_synthetic").join(lim, "toxic").groupBy("toxic").agg(F.count("*").alias("made"), F.bool_and(ok).alias("inside"))


@query("g8_svm_smote_inside", sql=_RISE)
def g8_inside(spark, sf):
    return _inside(spark, sf, G.resample_encoded(G.svm_smote)(X.toxic_docs(spark, sf), X.TOXIC))


@query("g13_resample_encoded_inside", sql=_RISE)
def g13_inside(spark, sf):
    return _inside(spark, sf, G.resample_encoded(G.smote)(X.toxic_docs(spark, sf), X.TOXIC))


@query("h1_gaussian_copula_inside", sql=_RISE)
def h1_inside(spark, sf):
    out = H.gaussian_copula(X.toxic_docs(spark, sf), X.TOXIC)
    t = X.toxic_docs(spark, sf)
    lim = t.agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"), F.collect_set("lang").alias("ls"), F.collect_set("source").alias("ss")).first()
    ok = F.col("n_chars").between(lim["a"], lim["b"]) & F.col("lang").isin(lim["ls"]) & F.col("source").isin(lim["ss"])
    return out.where("is_synthetic").groupBy("toxic").agg(F.count("*").alias("made"), F.bool_and(ok).alias("inside"))


@query("h1_copula_correlation", sql="""SELECT true AS near, count(*) AS n FROM orders""")
def h1_correlation(spark, sf):
    """The correlation of two dependent columns survives, whatever their margins."""
    t = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_totalprice") * 2 + F.col("o_custkey")).alias("y"), "o_orderstatus")
    spec = X.TableSpec(features=("x", "y"), label="o_orderstatus", row_id=("o_orderkey",))
    made = H.gaussian_copula(t, spec, "create-new").where("is_synthetic")
    return made.agg((F.abs(F.corr("x", "y") - t.stat.corr("x", "y")) < 0.05).alias("near"), F.count("*").alias("n"))
