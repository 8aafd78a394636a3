"""Queries for count plans and rebalancing."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.operators import counts as C
from ballast.operators import resample as G
from ballast.operators.encode import min_max
from ballast.plans import fixtures as X
from ballast.plans.registry import pick_sql, query, u_sql

_NEED = f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic)"""


@query("g1_plan_counts_auto", sql="""
WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, (SELECT max(n) FROM c) - n AS need FROM c""")
def g1(spark, sf):
    t = X.seg_customers(spark, sf)
    return C.plan_counts(t, "c_mktsegment", "auto").table(t)


@query("g1_plan_counts_named", sql="""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT lang, n, (SELECT max(n) FROM c) - n AS gap, row_number() OVER (ORDER BY n, lang) AS small FROM c)
SELECT 'minority' AS strategy, lang, CASE WHEN small = 1 THEN gap ELSE 0 END AS need FROM k
UNION ALL SELECT 'not minority', lang, CASE WHEN small = 1 THEN 0 ELSE gap END FROM k
UNION ALL SELECT 'all', lang, gap FROM k""")
def g1_named(spark, sf):
    t = X.lang_docs(spark, sf)
    from ballast.operators.prepare import stack_all
    return stack_all([C.plan_counts(t, "lang", s).table(t).select(F.lit(s).alias("strategy"), "lang", "need")
                      for s in ("minority", "not minority", "all")])


@query("g1_plan_counts_ratio", sql=_NEED + """
SELECT toxic, n, CAST(CASE WHEN n = (SELECT min(n) FROM c) THEN floor((SELECT max(n) FROM c) * 0.5) - n ELSE 0 END AS BIGINT) AS need FROM c""")
def g1_ratio(spark, sf):
    t = X.toxic_docs(spark, sf)
    return C.plan_counts(t, "toxic", 0.5).table(t)


@query("g2_plan_counts_target", sql=_NEED + """
SELECT toxic, n, CASE toxic WHEN 1 THEN (SELECT 2 * min(n) FROM c) - n ELSE 0 END AS need FROM c""")
def g2(spark, sf):
    t = X.toxic_docs(spark, sf)
    return C.plan_counts(t, "toxic", lambda n: {1: 2 * min(n.values())}).table(t)


@query("g3_plan_counts_create_new", sql=_NEED + "SELECT toxic, n, n AS need FROM c")
def g3(spark, sf):
    t = X.toxic_docs(spark, sf)
    return C.plan_counts(t, "toxic", "create-new").table(t)


@query("g3_create_new_rows", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic),
k AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rank FROM toxic_docs),
s AS (SELECT toxic, unnest(generate_series(1, n)) AS copy, n FROM c),
d AS (SELECT toxic, {pick_sql('ros', 'n', 'toxic', 'copy')} AS rank FROM s)
SELECT d.toxic, k.n_chars, k.lang, k.source FROM d JOIN k ON d.toxic = k.toxic AND d.rank = k.rank""")
def g3_rows(spark, sf):
    return G.random_oversample(X.toxic_docs(spark, sf), X.TOXIC, "create-new").select("toxic", "n_chars", "lang", "source")


@query("g4_balance_clusters", sql="""
WITH m AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_returnflag FROM m GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 1),
k AS (SELECT *, first(l_returnflag) OVER w AS mc, first(n) OVER w AS mn FROM m WINDOW w AS (PARTITION BY l_linenumber ORDER BY n DESC, l_returnflag))
SELECT l_linenumber, l_returnflag, n, CASE WHEN l_returnflag <> mc AND l_returnflag <> (SELECT * FROM g) AND n / mn > 0.01 THEN mn - n ELSE 0 END AS need FROM k""")
def g4(spark, sf):
    t = X.table(spark, sf, "lineitem")
    return C.balance_clusters(t, "l_linenumber", "l_returnflag")


_ROS = f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic),
k AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rank FROM toxic_docs),
s AS (SELECT toxic, unnest(generate_series(1, (SELECT max(n) FROM c) - n)) AS copy, n FROM c),
d AS (SELECT toxic, {pick_sql('ros', 'n', 'toxic', 'copy')} AS rank FROM s),
o AS (SELECT doc_id, n_chars, lang, source, toxic, false AS is_synthetic FROM toxic_docs
  UNION ALL SELECT NULL, k.n_chars, k.lang, k.source, d.toxic, true FROM d JOIN k ON d.toxic = k.toxic AND d.rank = k.rank)"""


@query("g5_random_oversample", sql=_ROS + "SELECT * FROM o")
def g5(spark, sf):
    return G.random_oversample(X.toxic_docs(spark, sf), X.TOXIC)


@query("g5_random_oversample_counts", sql=_ROS + """
SELECT toxic, CAST(count(CASE WHEN NOT is_synthetic THEN 1 END) AS BIGINT) AS before, count(*) AS after, CAST(sum(n_chars) AS BIGINT) AS chars FROM o GROUP BY toxic""")
def g5_counts(spark, sf):
    out = G.random_oversample(X.toxic_docs(spark, sf), X.TOXIC)
    return out.groupBy("toxic").agg(F.count(F.when(~F.col("is_synthetic"), 1)).alias("before"),
                                    F.count(F.lit(1)).alias("after"), F.sum("n_chars").alias("chars"))


@query("g5_random_oversample_lines", sql=f"""
WITH {X.RARE_SQL}, c AS (SELECT rare, count(*) AS n FROM rare_lines GROUP BY rare),
k AS (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY line_id) AS rank FROM rare_lines),
s AS (SELECT rare, unnest(generate_series(1, (SELECT max(n) FROM c) - n)) AS copy, n FROM c),
d AS (SELECT rare, {pick_sql('ros', 'n', 'rare', 'copy')} AS rank FROM s)
SELECT d.rare, k.l_returnflag, k.l_discount, count(*) AS n, round(sum(k.l_extendedprice), 2) AS price FROM d JOIN k ON d.rare = k.rare AND d.rank = k.rank GROUP BY ALL""")
def g5_lines(spark, sf):
    out = G.random_oversample(X.rare_lines(spark, sf), X.RARE)
    return out.where("is_synthetic").groupBy("rare", "l_returnflag", "l_discount").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


# ---- neighbour-based operators on customers: the class is the market segment, raised to its largest

_SEG = """
cls AS (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1),
plan AS (SELECT seg, n, (SELECT max(n) FROM cls) - n AS need, seg = (SELECT seg FROM cls ORDER BY n DESC, seg LIMIT 1) AS top FROM cls),
p AS (SELECT a.c_custkey AS id, b.c_custkey AS other, a.c_mktsegment AS seg, b.c_mktsegment AS oseg,
  a.c_acctbal AS x0, CAST(a.c_nationkey AS DOUBLE) AS x1, b.c_acctbal AS y0, CAST(b.c_nationkey AS DOUBLE) AS y1,
  power(a.c_acctbal - b.c_acctbal, 2) + power(a.c_nationkey - b.c_nationkey, 2) AS d FROM customer a, customer b WHERE a.c_custkey <> b.c_custkey),
own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS pos, count(*) OVER (PARTITION BY id) AS have FROM p WHERE seg = oseg),
near AS (SELECT id, seg, x0, x1, y0, y1, pos, least(have, 5) AS have FROM own WHERE pos <= 5)"""


def _made(spark, sf, fn, table=None, **options):
    t = (X.seg_customers(spark, sf) if table is None else table).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    out = fn(t, X.SEGMENT, "auto", **options)
    return out.where("is_synthetic").select("c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"), F.round("c_nationkey", 4).alias("c_nationkey"))


def _line_sql(purpose: str, seeds: str) -> str:
    """Slots joined to ranked seeds, one neighbour and one point between, as in the SMOTE family."""
    return f"""
rk AS (SELECT id, seg, row_number() OVER (PARTITION BY seg ORDER BY id) AS rank, count(*) OVER (PARTITION BY seg) AS seeds FROM {seeds}),
sl AS (SELECT seg, unnest(generate_series(1, need)) AS copy FROM plan),
ch AS (SELECT sl.seg, sl.copy, {pick_sql(purpose + '.row', 'z.seeds', 'sl.seg', 'sl.copy')} AS rank FROM sl JOIN (SELECT DISTINCT seg, seeds FROM rk) z ON sl.seg = z.seg),
go AS (SELECT ch.seg, ch.copy, rk.id FROM ch JOIN rk ON ch.seg = rk.seg AND ch.rank = rk.rank),
pt AS (SELECT go.seg, go.copy, near.*, {pick_sql(purpose + '.near', 'near.have', 'go.seg', 'go.copy')} AS want, {u_sql(purpose + '.gap', 'go.seg', 'go.copy')} AS u
  FROM go JOIN near ON go.id = near.id)
SELECT seg AS c_mktsegment, round(x0 + u * (y0 - x0), 4) AS c_acctbal, round(x1 + u * (y1 - x1), 4) AS c_nationkey FROM pt WHERE pos = want"""


@query("g6_smote", sql=f"WITH {_SEG}, seeds AS (SELECT c_custkey AS id, c_mktsegment AS seg FROM customer), {_line_sql('smote', 'seeds')}")
def g6(spark, sf):
    return _made(spark, sf, G.smote)


@query("g7_borderline_smote", sql=f"""
WITH {_SEG}, al AS (SELECT id, seg, oseg, row_number() OVER (PARTITION BY id ORDER BY d, other) AS pos FROM p),
cn AS (SELECT id, seg, count(*) AS found, count(CASE WHEN oseg <> seg THEN 1 END) AS others FROM al WHERE pos <= 10 GROUP BY id, seg),
seeds AS (SELECT id, seg FROM cn WHERE others * 2 >= found AND others < found), {_line_sql('border', 'seeds')}""")
def g7(spark, sf):
    return _made(spark, sf, G.borderline_smote)


@query("g8_svm_smote")
def g8(spark, sf):
    out = G.resample_encoded(G.svm_smote)(X.toxic_docs(spark, sf), X.TOXIC)
    return out.where("is_synthetic").select("toxic", "n_chars", "lang", "source")


@query("g8_svm_smote_counts", sql=_NEED + "SELECT toxic, (SELECT max(n) FROM c) AS n FROM c")
def g8_counts(spark, sf):
    out = G.resample_encoded(G.svm_smote)(X.toxic_docs(spark, sf), X.TOXIC)
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("g9_kmeans_smote")
def g9(spark, sf):
    t = X.rare_lines(spark, sf).select("line_id", "l_extendedprice", "l_discount", "l_tax", "rare")
    scaled = min_max(t, ["l_extendedprice", "l_discount", "l_tax"]).transform(t)
    spec = X.TableSpec(features=("l_extendedprice", "l_discount", "l_tax"), label="rare", row_id=("line_id",))
    return G.kmeans_smote(scaled, spec, threshold=0.03).groupBy("rare", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


# One segment against all others, so that there is much to make up for.
_ONE = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE 'OTHER' END"
_ADA = f"""
WITH one AS (SELECT c_custkey, c_acctbal, c_nationkey, {_ONE} AS c_mktsegment FROM customer),
{_SEG.replace("customer", "one")}, al AS (SELECT id, seg, oseg, row_number() OVER (PARTITION BY id ORDER BY d, other) AS pos FROM p),
cn AS (SELECT id, seg, count(*) AS found, count(CASE WHEN oseg <> seg THEN 1 END) AS others FROM al WHERE pos <= 5 GROUP BY id, seg),
nd AS (SELECT cn.id, cn.seg, CAST(round_even((others / found) * plan.need / sum(others / found) OVER (PARTITION BY cn.seg), 0) AS BIGINT) AS need
  FROM cn JOIN plan ON cn.seg = plan.seg WHERE plan.need > 0)"""


def _one_segment(spark, sf):
    return X.seg_customers(spark, sf).withColumn("c_mktsegment", F.expr(_ONE))


@query("g10_adasyn_need", sql=_ADA + " SELECT id AS c_custkey, seg AS c_mktsegment, need FROM nd")
def g10_need(spark, sf):
    t = _one_segment(spark, sf)
    return G.adasyn_need(t, X.SEGMENT, C.plan_counts(t, "c_mktsegment"))


@query("g10_adasyn", sql=_ADA + f""",
sl AS (SELECT id, seg, unnest(generate_series(1, need)) AS copy FROM nd WHERE need > 0),
pt AS (SELECT sl.copy, near.*, {pick_sql('adasyn.near', 'near.have', 'sl.id', 'sl.copy')} AS want, {u_sql('adasyn.gap', 'sl.id', 'sl.copy')} AS u FROM sl JOIN near ON sl.id = near.id)
SELECT seg AS c_mktsegment, round(x0 + u * (y0 - x0), 4) AS c_acctbal, round(x1 + u * (y1 - x1), 4) AS c_nationkey FROM pt WHERE pos = want""")
def g10(spark, sf):
    return _made(spark, sf, G.adasyn, _one_segment(spark, sf))


@query("g11_centroid_sample", sql=f"""
WITH cls AS (SELECT o_orderstatus AS s, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
k AS (SELECT o_orderstatus AS s, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank FROM orders),
sl AS (SELECT s, n, m, unnest(generate_series(1, (SELECT max(n) FROM cls) - n)) AS copy FROM cls),
d AS (SELECT s, m, (copy - 1) % n + 1 AS rank, {u_sql('centroid', 's', 'copy')} AS u FROM sl)
SELECT d.s AS o_orderstatus, round(x + u * (x - m), 2) AS o_totalprice FROM d JOIN k ON d.s = k.s AND d.rank = k.rank""")
def g11(spark, sf):
    spec = X.TableSpec(features=("o_totalprice",), label="o_orderstatus", row_id=("o_orderkey",))
    out = G.centroid_sample(X.status_orders(spark, sf).drop("o_orderpriority"), spec)
    return out.where("is_synthetic").select("o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


_CBR = """
WITH t AS (SELECT event_id AS id, user_id AS cl, event_type AS ty, value AS x FROM events),
g AS (SELECT ty FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
c AS (SELECT cl, ty, count(*) AS n, avg(x) AS m FROM t GROUP BY 1, 2),
f AS (SELECT *, max(n) OVER w AS mx, sum(n) OVER w AS total, ty = (SELECT * FROM g) AS top FROM c WINDOW w AS (PARTITION BY cl)),
i AS (SELECT *, CASE WHEN top THEN n = mx ELSE n > 1 END AS included, top AND total = 1 AS dropped FROM f),
e AS (SELECT *, max(CASE WHEN included THEN n END) OVER w AS best, sum(included::INT) OVER w AS groups FROM i WINDOW w AS (PARTITION BY cl)),
pl AS (SELECT cl, ty, n, m, included, dropped, CASE WHEN included AND groups > 1 AND n > 1 THEN best - n ELSE 0 END AS need FROM e)"""


@query("g12_cluster_plan", sql=_CBR + " SELECT cl AS user_id, ty AS event_type, n, included, dropped, CAST(need AS BIGINT) AS need FROM pl")
def g12_plan(spark, sf):
    return G.cluster_plan(X.typed_events(spark, sf), "user_id", "event_type")


@query("g12_cluster_based_resample", sql=_CBR + f""",
k AS (SELECT id, cl, ty, x, row_number() OVER (PARTITION BY cl, ty ORDER BY id) AS rank FROM t),
sl AS (SELECT cl, ty, n, m, unnest(generate_series(1, need)) AS copy FROM pl),
d AS (SELECT cl, ty, m, (copy - 1) % n + 1 AS rank, {u_sql('centroid', 'cl', 'ty', 'copy')} AS u FROM sl)
SELECT cl AS user_id, ty AS event_type, round(x + u * (x - m), 4) AS value, true AS is_synthetic FROM d JOIN k USING (cl, ty, rank)
UNION ALL SELECT t.cl, t.ty, round(t.x, 4), false FROM t JOIN pl ON t.cl = pl.cl AND t.ty = pl.ty WHERE NOT pl.dropped""")
def g12(spark, sf):
    spec = X.TableSpec(features=("value",), label="event_type", row_id=("event_id",))
    out = G.cluster_based_resample(X.typed_events(spark, sf), spec, "user_id")
    return out.select("user_id", "event_type", F.round("value", 4).alias("value"), "is_synthetic")


@query("g13_resample_encoded", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic)
SELECT toxic, (SELECT max(n) FROM c) AS n, true AS langs_known FROM c""")
def g13(spark, sf):
    out = G.resample_encoded(G.smote)(X.toxic_docs(spark, sf), X.TOXIC)
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lang").isin("en", "fr", "de", "es")).alias("langs_known"))


@query("g14_append_synthetic", sql="""
SELECT o_orderkey, o_orderstatus, o_totalprice, false AS is_synthetic FROM orders
UNION ALL SELECT NULL, o_orderstatus, o_totalprice * 2, true FROM orders WHERE o_orderstatus = 'F'""")
def g14(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    made = t.where("o_orderstatus = 'F'").select("o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return G.append_synthetic(t, made)


@query("g15_registered_resampler", sql=f"""
WITH {X.TOXIC_SQL} SELECT 'keep' AS sampler, toxic, count(*) AS n FROM toxic_docs GROUP BY toxic""")
def g15(spark, sf):
    G.register_resampler("keep", lambda df, spec, strategy, seed: df.withColumn("is_synthetic", F.lit(False)))
    out = G.RESAMPLERS["keep"](X.toxic_docs(spark, sf), X.TOXIC, "auto", 42)
    return out.groupBy(F.lit("keep").alias("sampler"), "toxic").agg(F.count(F.lit(1)).alias("n"))
