"""Queries for conditional sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.draws import pick, uniform
from ballast.functions.ranks import ranked
from ballast.functions.store import written
from ballast.operators import cluster as E
from ballast.operators import synth as H
from ballast.operators.cluster import p_cluster_given_class
from ballast.operators.resample import random_oversample
from ballast.plans import fixtures as X
from ballast.plans.registry import pick_sql, query, u_sql


@query("h1_gaussian_copula")
def h1(spark, sf):
    out = H.gaussian_copula(X.toxic_docs(spark, sf), X.TOXIC)
    return out.where("is_synthetic").select("toxic", "n_chars", "lang", "source")


@query("h1_gaussian_copula_counts", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic)
SELECT toxic, (SELECT max(n) FROM c) AS n, true AS in_range FROM c""")
def h1_counts(spark, sf):
    t = X.toxic_docs(spark, sf)
    lim = t.agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b")).first()
    return H.gaussian_copula(t, X.TOXIC).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("n_chars").between(lim["a"], lim["b"])).alias("in_range"))


_PROBS = """
pr AS (SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source),
w AS (SELECT *, ln(n + 1.0) / sum(ln(n + 1.0)) OVER (PARTITION BY "column") AS p FROM pr)"""


@query("h2_category_probs", sql=f'WITH {_PROBS} SELECT "column", value, n, round(p, 6) AS p FROM w')
def h2(spark, sf):
    return H.category_probs(X.table(spark, sf, "documents"), ["lang", "source"]).withColumn("p", F.round("p", 6))


_COND = f"""
WITH {_PROBS}, cu AS (SELECT "column", value, n, sum(p) OVER (PARTITION BY "column" ORDER BY value) AS hi, sum(p) OVER (PARTITION BY "column" ORDER BY value) - p AS lo,
  value = max(value) OVER (PARTITION BY "column") AS last_value FROM w),
dr AS (SELECT draw, CASE {pick_sql('cond.col', '2', 'draw')} WHEN 1 THEN 'lang' ELSE 'source' END AS "column", {u_sql('cond.val', 'draw')} AS u
  FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM documents))) AS draw)),
cond AS (SELECT draw, dr."column", min(value) AS value FROM dr JOIN cu ON dr."column" = cu."column" AND (hi > u OR last_value) GROUP BY draw, dr."column")"""


@query("h3_draw_conditions", sql=_COND + """
SELECT draw, "column", value, CASE "column" WHEN 'lang' THEN '10' ELSE '01' END AS mask FROM cond""")
def h3(spark, sf):
    docs = X.table(spark, sf, "documents")
    return H.draw_conditions(spark, docs.count(), H.category_probs(docs, ["lang", "source"]), ["lang", "source"])


@query("h4_sample_matching", sql=_COND + f""",
k AS (SELECT doc_id, 'lang' AS "column", lang AS value, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents
  UNION ALL SELECT doc_id, 'source', source, row_number() OVER (PARTITION BY source ORDER BY doc_id), count(*) OVER (PARTITION BY source) FROM documents),
z AS (SELECT DISTINCT "column", value, n FROM k), a AS (SELECT cond.*, {pick_sql('match', 'z.n', 'draw')} AS rank FROM cond JOIN z USING ("column", value))
SELECT draw, a."column", a.value, doc_id, lang, source, n_chars FROM a JOIN k USING ("column", value, rank) JOIN documents USING (doc_id)""")
def h4(spark, sf):
    docs = X.lang_docs(spark, sf)
    cond = H.draw_conditions(spark, docs.count(), H.category_probs(docs, ["lang", "source"]), ["lang", "source"])
    return H.sample_matching(docs, cond.drop("mask"), ["lang", "source"], "doc_id")


@query("h5_categorical_draw", sql=f"""
WITH p AS (SELECT event_id, value / 100.0::DOUBLE + 0.000001::DOUBLE AS a, CAST(user_id AS DOUBLE) / 50.0::DOUBLE + 0.000001::DOUBLE AS b, 1.0::DOUBLE + 0.000001::DOUBLE AS c, {u_sql('draw', 'event_id')} AS u FROM events)
SELECT event_id, CAST(CASE WHEN a > u * (a + b + c) THEN 0 WHEN a + b > u * (a + b + c) THEN 1 ELSE 2 END AS INTEGER) AS choice FROM p""")
def h5(spark, sf):
    p = F.array(F.col("value") / 100.0, F.col("user_id").cast("double") / 50.0, F.lit(1.0))
    return X.typed_events(spark, sf).select("event_id", H.categorical_draw(uniform("draw", "event_id"), p).alias("choice"))


_PCL = """
n AS (SELECT l_returnflag AS f, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY 1, 2),
pp AS (SELECT f, c, n / sum(n) OVER (PARTITION BY f) AS p FROM n),
cu AS (SELECT f, c, sum(p) OVER (PARTITION BY f ORDER BY c) AS hi, c = max(c) OVER (PARTITION BY f) AS final FROM pp),
sl AS (SELECT f, unnest(generate_series(1, n)) AS copy FROM (SELECT f, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY f))"""


@query("h6_draw_cluster", sql=f"""
WITH {_PCL}, d AS (SELECT f, copy, {u_sql('cluster', 'f', 'copy')} AS u FROM sl),
r AS (SELECT d.f, d.copy, min(c) AS c FROM d JOIN cu ON d.f = cu.f AND (hi > u OR final) GROUP BY d.f, d.copy)
SELECT f AS l_returnflag, c AS l_linenumber, count(*) AS n FROM r GROUP BY 1, 2""")
def h6(spark, sf):
    t = X.table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber")
    plan = H.plan_counts(t, "l_returnflag", "create-new")
    drawn = H.draw_cluster(H._slots(t, plan), p_cluster_given_class(t, "l_linenumber", "l_returnflag"), "l_linenumber", "l_returnflag")
    return drawn.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("h7_sample_subspace")
def h7(spark, sf):
    spec = X.TableSpec(features=("n_chars",), label="toxic", row_id=("doc_id",))
    out = H.subspace_resample(X.toxic_docs(spark, sf), spec, max_components=E.PUBLISHED_CLUSTERS, rounds=E.PUBLISHED_ROUNDS)
    return out.where("is_synthetic").select("toxic", "n_chars")


@query("h7_sample_subspace_counts", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic) SELECT toxic, (SELECT max(n) FROM c) AS n FROM c""")
def h7_counts(spark, sf):
    spec = X.TableSpec(features=("n_chars",), label="toxic", row_id=("doc_id",))
    out = H.subspace_resample(X.toxic_docs(spark, sf), spec, max_components=E.PUBLISHED_CLUSTERS, rounds=E.PUBLISHED_ROUNDS)
    return out.where("toxic IS NOT NULL AND n_chars IS NOT NULL").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("h8_sample_clustered", sql=f"""
WITH {X.RARE_SQL}, c AS (SELECT rare, count(*) AS n FROM rare_lines GROUP BY rare)
SELECT rare, false AS is_synthetic, n FROM c UNION ALL SELECT rare, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""")
def h8(spark, sf):
    out = H.clustered_resample(X.rare_lines(spark, sf), X.RARE, max_clusters=E.PUBLISHED_CLUSTERS)
    return out.groupBy("rare", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("h8_sample_clustered_ranges", sql=f"""
WITH {X.RARE_SQL}
SELECT rare, l_returnflag, true AS in_range, sum(k) > 0 AS some FROM (SELECT rare, l_returnflag, count(*) AS k FROM rare_lines GROUP BY ALL) WHERE rare = 1 GROUP BY rare, l_returnflag""")
def h8_ranges(spark, sf):
    t = X.rare_lines(spark, sf).withColumn("cluster", F.col("l_returnflag"))
    lim = t.agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b")).first()
    plan = H.plan_counts(t, "rare", "auto")
    made = H.sample_clustered(t, X.RARE, H._slots(t, plan))
    return made.groupBy("rare", "l_returnflag").agg(
        F.bool_and(F.col("l_extendedprice").between(lim["a"], lim["b"])).alias("in_range"), (F.count(F.lit(1)) > 0).alias("some"))


@query("h9_accept_matching", sql="""
SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def h9(spark, sf):
    t = X.rare_lines(spark, sf).select("line_id", "l_returnflag")
    need = {r["l_returnflag"]: r["n"] for r in H.class_counts(t, "l_returnflag").collect()}
    rows = written(ranked(t, [], "line_id").select("rank", F.col("l_returnflag").alias("found")), "ranked-lines")  # each try draws from it
    total = t.count()

    def generate(slots):
        drawn = slots.withColumn("rank", pick("accept", total, "l_returnflag", "copy", "attempt"))
        return drawn.join(rows, "rank").drop("rank")

    kept = H.accept_matching(t, need, "l_returnflag", generate, F.col("found") == F.col("l_returnflag"))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("h10_kl_by_class", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic),
k AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rank FROM toxic_docs),
d AS (SELECT toxic, {pick_sql('ros', 'n', 'toxic', 'copy')} AS rank FROM (SELECT toxic, unnest(generate_series(1, n)) AS copy, n FROM c)),
b AS (SELECT toxic, CAST(n_chars AS DOUBLE) AS x, 1 AS real FROM toxic_docs UNION ALL SELECT d.toxic, CAST(k.n_chars AS DOUBLE), 0 FROM d JOIN k USING (toxic, rank)),
m AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS wd FROM b),
h AS (SELECT toxic, least(floor((x - lo) / wd), 19) AS bin, sum(real) AS r, sum(1 - real) AS g FROM b, m GROUP BY 1, 2),
f AS (SELECT t.toxic, t.bin, coalesce(r, 0) AS r, coalesce(g, 0) AS g FROM (SELECT toxic, unnest(range(20)) AS bin FROM c) t LEFT JOIN h ON h.toxic = t.toxic AND h.bin = t.bin),
p AS (SELECT toxic, (r + 1) / (sum(r) OVER w + 20.0::DOUBLE) AS p, (g + 1) / (sum(g) OVER w + 20.0::DOUBLE) AS q FROM f WINDOW w AS (PARTITION BY toxic))
SELECT toxic, 'n_chars' AS "column", round(sum(p * ln(p / q)), 6) AS kl FROM p GROUP BY toxic""")
def h10(spark, sf):
    t = X.toxic_docs(spark, sf)
    made = random_oversample(t, X.TOXIC, "create-new")
    return H.kl_by_class(t, made, ["n_chars"], "toxic").withColumn("kl", F.round("kl", 6))
