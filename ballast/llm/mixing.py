"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone.

A source's target over its size says how many copies of each document the mix wants.  The whole part is certain; the rest
is a probability, and the documents of a source are ranked by random odds over inclusion odds (Pareto order sampling).  Inclusion odds
are those of the rest times the root of a document's size over the source's mean, so that long documents come first more often; what is
common to a source does not change its order and is left out.
The sample is of fixed size in words: documents are taken in rank order while they fit what is left of the target.  Those
that did not fit are passed over and the later ones asked again, round after round, until no document of the source
fits the gap; then the one whose size is nearest to the gap is added if that ends nearer to the target.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import join_model
from ballast.functions.draws import uniform
from ballast.functions.ranks import ranked, running_total
from ballast.functions.store import written


def word_count(text: Column) -> Column:
    """Words of a text, null: 0."""
    blanks = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blanks, " "), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size; every source once) with target: weights repeat over the sources by code point, null last.

    The sources share ``share`` times all words by weight, and none gets more than ``most`` times its size: the excess goes to
    the others by weight.  So target = least(most * size, level * weight) for the one level at which the targets sum
    up; as the sum is concave in the level, that level is the largest of (total - capped sizes) / (other weights)
    over all numbers of sources that are capped in order of size over weight.
    """
    named = ranked(sizes.where("source is not null"), [], "source", "_place")
    last = sizes.where("source is null").withColumn("_place", F.lit(sizes.count()).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = written(named.unionByName(last).withColumn("_weight", weight)
                      .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
                      .withColumn("_ratio", F.col("_cap") / F.col("_weight")), "sources")
    sums = weighed.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    total, all_weight = F.lit(float(share * (sums["size"] or 0))), F.lit(float(sums["weight"] or 0))
    run = running_total(weighed, [], ["_ratio", "_place"], {"_caps": F.col("_cap"), "_weights": F.col("_weight")})
    level = run.agg(F.max((total - (F.col("_caps") - F.col("_cap"))) / (all_weight - (F.col("_weights") - F.col("_weight"))))).first()[0]
    return weighed.select("source", "source_size", F.least(F.col("_cap"), F.lit(float(level or 0)) * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42,
        text: str = "text", source: str = "source", id_col: str = "doc_id", row: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row, and the column ``row`` if one is named.

    ``copies`` is 0, 1 .. ``most``; taken = copies * size.  Null texts have size 0 and count as taken 0 times or more alike;
    a null source is a source; rows with one id are documents of their own.  An empty table gives an empty table.
    Draws depend on id and seed alone; ties go by id, then by size.
    """
    keep = [F.col(row).alias("_row")] if row else [F.monotonically_increasing_id().alias("_row")]
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
                                word_count(F.col(text)).alias("size"), *keep), "sizes")
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")), "sources")
    sources = targets(sums, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    sources = written(sources.withColumn("_s", key).withColumn("_whole", F.floor(ratio))
                      .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size")).drop("source"), "sources")
    draw, odds = uniform("mix", "id", seed=seed), F.sqrt(F.greatest("size", F.lit(1)) * F.col("_docs") / F.col("_all"))
    state = join_model(sized.withColumn("_s", key).drop("source"), sums.select(key.alias("_s"), "_docs", F.greatest("source_size", F.lit(1)).alias("_all")), "_s")
    state = state.withColumn("_q", draw / (1 - draw) / odds).withColumn("_order", F.col("_q") / (1 + F.col("_q"))).withColumn("_more", F.lit(0)).drop("_q", "_docs", "_all")
    while True:
        state = written(state, "mix")
        gaps = written(sources.join(state.where("_more = 1").groupBy("_s").agg(F.sum("size").alias("_got")), "_s", "left")
                       .select("_s", (F.col("_need") - F.coalesce("_got", F.lit(0))).alias("_gap")), "gaps")
        asked = join_model(state, gaps, "_s").withColumn("_fits", (F.col("_more") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("_gap")))
        if asked.where("_fits").isEmpty():
            break
        # as odds spread around one, the order fills [0, 1) nearly evenly
        run = running_total(asked.where("_fits"), "_s", ["_order", "id", "size"], {"_run": F.col("size")}, is_draw=True)
        state = run.withColumn("_more", (F.col("_run") <= F.col("_gap")).cast("int")).drop("_run") \
                   .unionByName(asked.where("not _fits")).drop("_gap", "_fits")
    # one more document where that ends nearer to the target
    off = F.abs(F.col("size") - F.col("_gap"))
    best = asked.where("_more = 0 and size > 0").groupBy("_s").agg(
        F.min(F.struct(off.alias("off"), F.col("_order").alias("o"), F.col("id").alias("i"), F.col("size").alias("n"), F.col("_row").alias("r"))).alias("b"),
        F.first("_gap").alias("_gap")).where("b.off < _gap").select("_s", F.col("b.r").alias("_last"))
    done = join_model(join_model(state, sources, "_s"), best, "_s", "left")
    copies = (F.col("_whole") + F.col("_more") + F.when(F.col("_row") == F.col("_last"), 1).otherwise(0)).cast("int")
    out = done.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_row")
    return out.withColumnRenamed("_row", row) if row else out.drop("_row")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    numbered = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-docs")
    copies = mix(numbered, row="_mix_row", **options).where("copies > 0").select("_mix_row", F.col("copies").alias("_mix_copies"))
    return numbered.join(copies, "_mix_row").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*docs.columns)
