"""The tables the registered queries run on, always whole, with their column roles and SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.sources.tables import read_table
from ballast.spec import TableSpec


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", "parquet")


TOXIC = TableSpec(features=("n_chars", "lang", "source"), label="toxic", row_id=("doc_id",), categorical=("lang", "source"))
TOXIC_SQL = """toxic_docs AS (
  SELECT l.doc_id, d.n_chars, d.lang, d.source, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def toxic_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a toxicity label; about one in eight is toxic."""
    return table(spark, sf, "labels").select("doc_id", "toxic") \
        .join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id") \
        .select("doc_id", "n_chars", "lang", "source", "toxic")


LANG = TableSpec(features=("n_chars", "source"), label="lang", row_id=("doc_id",), categorical=("source",))


def lang_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")


RARE = TableSpec(features=("l_extendedprice", "l_discount", "l_tax", "l_returnflag"), label="rare",
                 row_id=("line_id",), categorical=("l_returnflag",))
RARE_SQL = """rare_lines AS (
  SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')) AS line_id,
         l_extendedprice, l_discount, l_tax, l_returnflag, CAST(l_quantity >= 48 AS INTEGER) AS rare
  FROM lineitem)"""


def rare_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines; large quantities are the rare class.  The id is built from five columns."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.date_format("l_shipdate", "yyyy-MM-dd")).alias("line_id"),
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        (F.col("l_quantity") >= 48).cast("int").alias("rare"))


SEGMENT = TableSpec(features=("c_acctbal", "c_nationkey"), label="c_mktsegment", row_id=("c_custkey",))


def seg_customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


ORDERS = TableSpec(features=("o_totalprice", "o_orderpriority"), label="o_orderstatus", row_id=("o_orderkey",),
                   categorical=("o_orderpriority",))


def status_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


EVENTS = TableSpec(features=("value", "user_id"), label="event_type", row_id=("event_id",))


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value", "user_id", "event_type")


VECTORS = TableSpec(features=("embedding",), label="label", row_id=("vec_id",))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
