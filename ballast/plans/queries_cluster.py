"""Queries for clustering and class-by-cluster statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.operators import cluster as E
from ballast.operators import density as D
from ballast.operators.counts import imbalance_matrix
from ballast.operators.neighbors import vector
from ballast.plans import fixtures as X
from ballast.plans.registry import pick_sql, query


def _features(spark, sf):
    return E.cluster_features(X.rare_lines(spark, sf), X.RARE)


@query("e1_cluster_features", sql=f"""
WITH {X.RARE_SQL}, s AS (SELECT min(l_extendedprice) AS a1, max(l_extendedprice) AS b1, min(l_discount) AS a2, max(l_discount) AS b2,
  min(l_tax) AS a3, max(l_tax) AS b3 FROM rare_lines)
SELECT line_id, round((l_extendedprice - a1) / (b1 - a1), 6) AS f0, round((l_discount - a2) / (b2 - a2), 6) AS f1, round((l_tax - a3) / (b3 - a3), 6) AS f2,
  CAST(l_returnflag = 'A' AS DOUBLE) AS f3, CAST(l_returnflag = 'N' AS DOUBLE) AS f4, CAST(l_returnflag = 'R' AS DOUBLE) AS f5 FROM rare_lines, s""")
def e1(spark, sf):
    t = _features(spark, sf)
    return t.select("line_id", *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(6)])


@query("e2_choose_k_kmeans")
def e2(spark, sf):
    found = E.choose_k_kmeans(_features(spark, sf), max_clusters=E.PUBLISHED_CLUSTERS)
    return found.labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("e2_inertia_score", sql="""
WITH w AS (SELECT c_mktsegment, count(*) AS n, var_pop(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT count(*) AS k, round(sum(n * v) / (SELECT count(*) * var_pop(c_acctbal) FROM customer) + 0.02 * count(*), 6) AS score FROM w""")
def e2_score(spark, sf):
    t = X.table(spark, sf, "customer").select("c_mktsegment", F.array("c_acctbal").alias("features"))
    return E.inertia_score(t, "c_mktsegment", "features").withColumn("score", F.round("score", 6))


@query("e3_choose_k_mixture")
def e3(spark, sf):
    spec = X.TableSpec(features=("c_acctbal", "c_nationkey"), label="c_mktsegment", row_id=("c_custkey",))
    t = E.cluster_features(X.seg_customers(spark, sf), spec)
    found = E.choose_k_mixture(t, max_clusters=E.PUBLISHED_CLUSTERS, rounds=E.PUBLISHED_ROUNDS)
    return found.labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("e4_hierarchical")
def e4(spark, sf):
    return E.hierarchical(_features(spark, sf), max_clusters=E.PUBLISHED_CLUSTERS).labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("e5_cluster_profile", sql="""
WITH p AS (SELECT user_id, count(*) AS n, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1),
c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2)
SELECT p.user_id, p.n, min_value, max_value, (SELECT string_agg(event_type || '=' || k, ',' ORDER BY event_type) FROM c WHERE c.user_id = p.user_id) AS classes FROM p""")
def e5(spark, sf):
    out = E.cluster_profile(X.typed_events(spark, sf), "user_id", ["value"], "event_type")
    text = F.transform(F.map_entries("classes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("classes", F.concat_ws(",", text))


@query("e6_p_cluster_given_class", sql="""
WITH n AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT DISTINCT l_linenumber FROM n), c AS (SELECT l_returnflag, sum(n) AS t FROM n GROUP BY 1)
SELECT c.l_returnflag, k.l_linenumber, CAST(coalesce(n.n, 0) AS BIGINT) AS n, round(coalesce(n.n, 0) / t, 6) AS p FROM c CROSS JOIN k
LEFT JOIN n ON n.l_returnflag = c.l_returnflag AND n.l_linenumber = k.l_linenumber""")
def e6(spark, sf):
    t = X.table(spark, sf, "lineitem")
    return E.p_cluster_given_class(t, "l_linenumber", "l_returnflag").withColumn("p", F.round("p", 6))


@query("e7_imbalance_matrix", sql="""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, first(event_type) OVER w AS majority_class, first(n) OVER w AS majority_n FROM n
WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type)""")
def e7(spark, sf):
    return imbalance_matrix(X.typed_events(spark, sf), "user_id", "event_type")


@query("e8_mixture_1d")
def e8(spark, sf):
    from ballast.operators.modes import mixture_1d
    found = mixture_1d(X.rare_lines(spark, sf), ["l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame([(c, i, m.mean, m.sd, m.weight) for c, ms in found.items() for i, m in enumerate(ms)],
                                 "column STRING, mode INT, mean DOUBLE, sd DOUBLE, weight DOUBLE")


_EPS = 2.0
_CORE_SQL = f"""
pr AS (SELECT a.c_custkey AS id, a.c_acctbal AS x, count(*) AS n FROM customer a JOIN customer b ON power(a.c_acctbal - b.c_acctbal, 2) <= {_EPS * _EPS} GROUP BY 1, 2)"""


@query("e9_dbscan_core", sql=f"WITH {_CORE_SQL} SELECT id AS c_custkey, n >= 3 AS core FROM pr")
def e9_core(spark, sf):
    t = X.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return D.core_flags(t, vector(["c_acctbal"]), "c_custkey", _EPS).select("c_custkey", "core")


@query("e9_dbscan", sql=f"""
WITH {_CORE_SQL}, co AS (SELECT id, x, CASE WHEN power(x - lag(x) OVER (ORDER BY x, id), 2) <= {_EPS * _EPS} THEN 0 ELSE 1 END AS opens FROM pr WHERE n >= 3),
g AS (SELECT id, x, sum(opens) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS grp FROM co),
m AS (SELECT grp, min(id) AS first_id FROM g GROUP BY grp),
k AS (SELECT g.id, g.x, CAST(dense_rank() OVER (ORDER BY m.first_id) - 1 AS INTEGER) AS cluster FROM g JOIN m USING (grp)),
b AS (SELECT pr.id, min(k.cluster) AS cluster FROM pr JOIN k ON power(pr.x - k.x, 2) <= {_EPS * _EPS} WHERE pr.n < 3 GROUP BY pr.id)
SELECT pr.id AS c_custkey, CAST(coalesce(k.cluster, b.cluster, -1) AS INTEGER) AS cluster FROM pr LEFT JOIN k ON pr.id = k.id LEFT JOIN b ON pr.id = b.id""")
def e9(spark, sf):
    t = X.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return D.dbscan(t, vector(["c_acctbal"]), "c_custkey", _EPS).select("c_custkey", "cluster")


@query("e10_ward_threshold")
def e10(spark, sf):
    spec = X.TableSpec(features=("c_acctbal", "c_nationkey"), label="c_mktsegment", row_id=("c_custkey",))
    t = E.cluster_features(X.seg_customers(spark, sf), spec)
    return E.ward(t, "features", 3.0).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _ward_sql(going: str) -> str:
    """Ward's merges of the roots of balances, the cheapest neighbours on the line first, as long as ``going`` holds of the list l and the least cost m."""
    return f"""
WITH RECURSIVE p AS (SELECT sqrt(c_acctbal + 1000) AS x, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1),
s(l) AS (SELECT list({{'n': n, 'x': x, 'low': x}} ORDER BY x) FROM p UNION ALL
  SELECT list_concat(list_append(l[1:i - 1], {{'n': l[i].n + l[i + 1].n, 'x': (l[i].n * l[i].x + l[i + 1].n * l[i + 1].x) / (l[i].n + l[i + 1].n), 'low': l[i].low}}), l[i + 2:])
  FROM (SELECT l, m, list_position(c, m) AS i FROM (SELECT l, c, list_min(c) AS m FROM (
    SELECT l, list_transform(range(1, len(l)), lambda i: 2 * l[i].n * l[i + 1].n / (l[i].n + l[i + 1].n) * power(l[i + 1].x - l[i].x, 2)) AS c FROM s))) WHERE {going}),
e AS (SELECT unnest(l).low AS low FROM (SELECT l FROM s ORDER BY len(l) LIMIT 1)),
b AS (SELECT low, row_number() OVER (ORDER BY low) - 1 AS cluster FROM e)
SELECT c_custkey, CAST(b.cluster AS INTEGER) AS cluster FROM customer ASOF JOIN b ON sqrt(c_acctbal + 1000) >= b.low"""


def _balances(spark, sf):
    return X.table(spark, sf, "customer").select("c_custkey", F.array(F.sqrt(F.col("c_acctbal") + 1000)).alias("features"))


@query("e4_hierarchical_balances", sql=_ward_sql("len(l) > 12"))
def e4_balances(spark, sf):
    return E.hierarchical(_balances(spark, sf), k=12).labelled.select("c_custkey", "cluster")


@query("e10_ward_balances", sql=_ward_sql("len(l) > 1 AND m < 25.0"))
def e10_balances(spark, sf):
    return E.ward(_balances(spark, sf), "features", 5.0).select("c_custkey", "cluster")


@query("e11_median_pair_distance", sql="""
SELECT round(quantile_cont(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0.5) / 3, 6) AS eps FROM embeddings a, embeddings b""")
def e11(spark, sf):
    eps = D.median_pair_distance(X.vectors(spark, sf), F.col("embedding"), "vec_id", factor=3.0)
    return spark.createDataFrame([(round(eps, 6),)], "eps DOUBLE")


@query("e12_class_subspaces")
def e12(spark, sf):
    spec = X.TableSpec(features=("n_chars",), label="toxic", row_id=("doc_id",))
    t = E.cluster_features(X.toxic_docs(spark, sf), spec)
    rows, _ = E.class_subspaces(t, "features", "toxic", max_components=E.PUBLISHED_CLUSTERS, rounds=E.PUBLISHED_ROUNDS)
    return rows.groupBy("toxic", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("e13_drop_majority_outliers")
def e13(spark, sf):
    t = X.rare_lines(spark, sf)
    spec = X.TableSpec(features=("l_extendedprice", "l_discount", "l_tax"), label="rare", row_id=("line_id",))
    return E.drop_majority_outliers(t, spec).groupBy("rare").agg(F.count(F.lit(1)).alias("n"))


@query("e14_pad_to_multiple", sql=f"""
WITH n AS (SELECT count(*) AS n FROM labels), k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rank FROM labels),
s AS (SELECT n, unnest(generate_series(1, (64 - n % 64) % 64)) AS copy FROM n)
SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, toxic FROM (SELECT {pick_sql('pad', 'n', 'copy')} AS rank FROM s) d JOIN k USING (rank)""")
def e14(spark, sf):
    return E.pad_to_multiple(X.table(spark, sf, "labels"), "doc_id", 64)
