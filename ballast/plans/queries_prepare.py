"""Queries for sources, sinks and table preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.store import scratch_path
from ballast.operators import prepare as P
from ballast.plans import fixtures as X
from ballast.plans.registry import query, u_sql
from ballast.sources import results as R
from ballast.sources.tables import read_table


@query("a1_read_csv", sql="""
SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations,
       CAST(count(CASE WHEN c_acctbal < 0 THEN 1 END) AS BIGINT) AS overdrawn,
       round(min(c_acctbal), 2) AS lowest, round(max(c_acctbal), 2) AS highest
FROM customer GROUP BY c_mktsegment""")
def a1(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    X.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment") \
        .write.csv(path, header=True)
    back = read_table(spark, path)
    return back.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("nations"),
        F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("overdrawn"),
        F.round(F.min("c_acctbal"), 2).alias("lowest"), F.round(F.max("c_acctbal"), 2).alias("highest"))


@query("a2_read_json_lines", sql="""
SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
       min(value) AS lowest, max(value) AS highest
FROM events GROUP BY event_type""")
def a2(spark, sf):
    path = scratch_path(spark, "events")
    X.typed_events(spark, sf).write.option("compression", "gzip").json(path)
    back = read_table(spark, path, "jsonl.gz",
                      schema="event_id BIGINT, value DOUBLE, user_id BIGINT, event_type STRING")
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("a3_read_parquet", sql="SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def a3(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims"))


_RESULTS_SQL = """
SELECT o_orderpriority AS Dataset, CAST(o_custkey % 5 + 1 AS INTEGER) AS Fold, o_orderstatus AS Sampler,
       'none' AS Classifier, 'max_price' AS Scorer, max(o_totalprice) AS Val
FROM orders GROUP BY ALL"""


@query("a4_write_results", sql=_RESULTS_SQL)
def a4(spark, sf):
    orders = X.table(spark, sf, "orders")
    scores = orders.groupBy(F.col("o_orderpriority").alias("Dataset"), (F.col("o_custkey") % 5 + 1).cast("int").alias("Fold"),
                            F.col("o_orderstatus").alias("Sampler")) \
        .agg(F.max("o_totalprice").alias("Val")) \
        .select("Dataset", "Fold", "Sampler", F.lit("none").alias("Classifier"), F.lit("max_price").alias("Scorer"), "Val")
    path = scratch_path(spark, "results") + ".csv"
    R.write_results(scores, path)
    return spark.read.schema(R.RESULT_SCHEMA).csv(path, header=True)


@query("a5_run_errors", sql="""
SELECT 'resampler' AS Sampler, event_type AS Dataset, 0 AS Fold, 42 AS Seed, 'error events: ' || count(*) AS Message
FROM events GROUP BY event_type""")
def a5(spark, sf):
    path = scratch_path(spark, "errors")
    counts = X.typed_events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    for part in (F.col("event_type") == "error", F.col("event_type") != "error"):
        R.append_errors(counts.where(part).select(
            F.lit("resampler").alias("Sampler"), F.col("event_type").alias("Dataset"), F.lit(0).alias("Fold"),
            F.lit(42).alias("Seed"), F.concat(F.lit("error events: "), F.col("n").cast("string")).alias("Message")), path)
    return spark.read.parquet(path)


@query("a6_history_means", sql="""
SELECT CAST(date_trunc('day', ts) AS DATE) AS epoch, round(avg(value), 4) AS value
FROM events GROUP BY 1""")
def a6(spark, sf):
    log = X.table(spark, sf, "events").select(F.to_date("ts").alias("epoch"), "value")
    return R.history_means(log, "epoch", ["value"]).withColumn("value", F.round("value", 4))


@query("b1_drop_null_rows", sql="""
SELECT event_id, event_type, value FROM
  (SELECT event_id, event_type, CASE WHEN value >= 1 THEN value END AS value FROM events)
WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL""")
def b1(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("value") >= 1, F.col("value")).alias("value"))
    return P.drop_null_rows(e)


@query("b2_label_last", sql="SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def b2(spark, sf):
    return P.label_last(X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
                        "o_orderstatus")


@query("b3_ordinal_names", sql='SELECT c_custkey AS "0", c_acctbal AS "1", c_mktsegment AS "2" FROM customer')
def b3(spark, sf):
    return P.ordinal_names(X.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


@query("b4_trim_label", sql="SELECT doc_id, lang FROM documents")
def b4(spark, sf):
    padded = X.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("  "), "lang", F.lit(" \t")).alias("lang"))
    return P.trim_label(padded, "lang")


@query("b5_label_encode", sql="""
SELECT l.o_orderkey, CAST(dense_rank() OVER (ORDER BY l.o_orderpriority) - 1 AS INTEGER) AS o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY l.o_orderstatus) - 1 AS INTEGER) AS o_orderstatus FROM orders l""")
def b5(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return P.label_encode(t, ["o_orderpriority", "o_orderstatus"]).transform(t)


@query("b5_label_decode", sql="SELECT p_partkey, p_brand FROM part")
def b5_back(spark, sf):
    t = X.table(spark, sf, "part").select("p_partkey", "p_brand")
    codes = P.label_encode(t, ["p_brand"])
    return codes.inverse(codes.transform(t))


@query("b6_infer_spec", sql="""
SELECT CASE WHEN o_totalprice IS NOT NULL THEN 'o_totalprice,o_custkey' END AS continuous, count(*) AS n FROM orders GROUP BY 1""")
def b6(spark, sf):
    from ballast.spec import infer_spec
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")
    spec = infer_spec(t, "o_orderstatus", "o_orderkey")
    return t.groupBy(F.lit(",".join(spec.continuous)).alias("continuous")).agg(F.count(F.lit(1)).alias("n"))


@query("b7_describe_table", sql=f"""
WITH {X.TOXIC_SQL}, c AS (SELECT toxic, count(*) AS n FROM toxic_docs GROUP BY toxic),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, count(*) AS k FROM c)
SELECT toxic, n, round(n / total, 6) AS share, round(largest / n, 6) AS imbalance_ratio, total AS rows,
       CAST(4 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS categorical, k AS classes FROM c, t""")
def b7(spark, sf):
    return P.describe_table(X.toxic_docs(spark, sf), X.TOXIC) \
        .withColumns({"share": F.round("share", 6), "imbalance_ratio": F.round("imbalance_ratio", 6)})


@query("b8_one_hot_columns", sql="""
SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS lang_de, CAST(lang = 'en' AS INTEGER) AS lang_en,
       CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents""")
def b8(spark, sf):
    return P.one_hot_columns(X.table(spark, sf, "documents").select("doc_id", "lang"), ["lang"])


@query("b9_shuffle", sql=f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {u_sql('shuffle', 'o_orderkey')}, o_orderkey) AS position FROM orders""")
def b9(spark, sf):
    return P.shuffle(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("b10_make_classification", sql="""
WITH n AS (SELECT count(*) AS total FROM documents), c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT CAST(toxic AS INTEGER) AS label,
       CAST(CASE toxic WHEN 0 THEN round(total * CAST(n AS DOUBLE) / sum(n) OVER ())
            ELSE total - round(total * CAST(sum(n) OVER () - n AS DOUBLE) / sum(n) OVER ()) END AS BIGINT) AS n
FROM c, n""")
def b10(spark, sf):
    ratios = [r["n"] for r in P.class_counts(X.table(spark, sf, "labels"), "toxic").orderBy("toxic").collect()]
    made = P.make_classification(spark, X.table(spark, sf, "documents").count(), ratios)
    return P.class_counts(made.where("f0 is not null and f1 is not null"), "label")


@query("b11_column_kinds", sql="""
SELECT 'o_totalprice' AS "column", 'continuous' AS kind, min(o_totalprice) AS "min", max(o_totalprice) AS "max", CAST(NULL AS BIGINT) AS categories FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', NULL, NULL, count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', NULL, NULL, count(DISTINCT o_orderstatus) FROM orders""")
def b11(spark, sf):
    return P.column_kinds(X.status_orders(spark, sf), X.ORDERS)


@query("b12_low_cardinality", sql="""
WITH k AS (SELECT 2 * count(DISTINCT l_returnflag) AS lim FROM lineitem),
d AS (SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) AS distinct_values FROM lineitem
 UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
 UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
 UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem)
SELECT "column", distinct_values, distinct_values < lim AS is_categorical FROM d, k""")
def b12(spark, sf):
    return P.low_cardinality(X.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_linestatus", "l_tax"], "l_returnflag")
