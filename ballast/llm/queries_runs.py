"""Query 12: periodic runs.  No SQL; the tests hold it against a brute-force search."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.functions.draws import let
from ballast.llm.periodic_runs import find_runs
from ballast.llm.registry import query, table

WORDS = r"[^\x20\x09-\x0D]+"


def planted(text: Column, key: Column) -> Column:
    """The text of the query: of documents whose h = crc32(id) ends in 0, words repeat from word a on with period p."""
    hash_ = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(hash_ / 10)

    def repeat(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        # word a + (i - a) % p of the words from a on is found by its place in one slice
        return let(F.struct(F.slice(x["w"], (a + 1).cast("int"), p.cast("int")).alias("piece"), F.slice(x["w"], F.lit(1), a.cast("int")).alias("head"), (n - a).alias("rest"), p.alias("p")),
                   lambda y: F.array_join(F.concat(y["head"], F.slice(F.flatten(F.array_repeat(y["piece"], F.ceil(y["rest"] / y["p"]).cast("int"))), F.lit(1), y["rest"].cast("int"))), " "))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))
    changed = let(F.struct(words.alias("w"), g.alias("g")), lambda x: F.when(F.size(x["w"]) > 0, repeat(x)).otherwise(F.lit("")))
    return F.when(hash_ % 10 == 0, changed).otherwise(text)


@query("op12_periodic_runs")
def periodic_runs(spark, sf):
    docs = table(spark, sf, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
