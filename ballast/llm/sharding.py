"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents linked by a common group (equal texts, say) start in shards drawn by hash.  In every round the rows are
counted by group and shard, and each row joins its group's counts: it wants to move to the shard, among those with room, that holds most of its
group, if that is more than its own shard holds.  Moves into a shard are granted in the order of their draw as far as
its quota, its room, goes.  Rounds go on while they move anything, up to a set number.  Rows that belong together with no other, and what
lies beyond a shard's quota, fill the shards up: ranked by group, they are dealt to the rooms in turn, so that counts differ by
one at most.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import collect_bounded
from ballast.functions.ranks import ranked
from ballast.functions.store import written


def _draw(*keys) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["count"] for r in collect_bounded(rows.groupBy("shard").count(), "shards", shards)}
    return [found.get(k, 0) for k in range(shards)]


def _by_shard(values: list[int], shard: str = "shard") -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(shard) + 1)


def spread_groups(rows: DataFrame, shards: int, goals: list[int], seed: int = 42, rounds: int = 20) -> DataFrame:
    """``rows`` (row, grp; every group with two rows at least) with shard: no shard holds more than its goal, null is left over.

    ``rounds`` ends a search that still moves rows; what it has reached by then obeys the goals as well.
    """
    placed = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(shards)).cast("int")).withColumn("draw", _draw(F.lit(seed + 1), "row"))
    for _ in range(rounds):
        placed = written(placed, "shards")
        room = [g - n for g, n in zip(goals, _loads(placed, shards))]
        held = placed.groupBy("grp", "shard").count()
        is_open = _by_shard([int(r > 0) for r in room]) == 1
        # per group its counts by shard: at most ``shards`` entries
        by_group = held.withColumn("is_open", is_open).groupBy("grp").agg(
            F.max(F.when(F.col("is_open"), F.struct(F.col("count").alias("n"), (-F.col("shard")).alias("s")))).alias("best"),
            F.map_from_entries(F.collect_list(F.struct("shard", "count"))).alias("held"))
        wishes = placed.join(by_group, "grp").withColumn("to", (-F.col("best.s")).cast("int"))
        # a tie goes to the smaller shard, or out of a full one, so that two halves do not change places for ever
        own, other = F.element_at("held", F.col("shard")), F.col("best.n")
        leaves = (F.col("to") < F.col("shard")) | (_by_shard([int(r > 0) for r in room]) == 0)
        wishes = wishes.withColumn("moves", F.col("best").isNotNull() & (F.col("to") != F.col("shard")) & ((other > own) | ((other == own) & leaves)))
        movers = written(wishes.where("moves").select("row", "to", "draw", "grp", other.alias("gain")), "moves")
        if movers.isEmpty():
            break
        granted = ranked(movers, "to", ["draw", "row"], "place", is_draw=True).where(F.col("place") <= _by_shard(room, "to")).select("row", "to")
        placed = placed.join(granted, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    placed = written(placed, "shards")
    over = [max(0, n - g) for g, n in zip(goals, _loads(placed, shards))]
    if any(over):  # the hash put more rows here than the goal allows and nothing drew them away
        counted = ranked(placed, "shard", ["draw", "row"], "place", is_draw=True)
        placed = counted.withColumn("shard", F.when(F.col("place") > _by_shard(over), F.col("shard"))).drop("place")
    return placed.select("row", "grp", "shard")


def even_shards(docs: DataFrame, shards: int = 24, text: str = "text", id_col: str = "doc_id", seed: int = 42, group: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``rows``.

    Rows are linked if their texts are equal, or those of the column ``group`` if one is named; nulls are linked with
    nothing.  Size is the UTF-8 bytes of the text plus 8 (a null text has none, its CRC is 0).  Slots count from 0 in the order
    of a draw by id and CRC.  Rows with one id are rows of their own.  An empty table gives an empty table.
    """
    key = F.col(group).cast("string") if group else F.col(text).cast("string")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = written(docs.select(F.col(id_col).alias("id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                               F.sha2(key, 256).alias("grp")).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    goals = [total // shards + (k < total % shards) for k in range(shards)]
    several = rows.where("grp is not null").groupBy("grp").count().where("count > 1").select("grp")
    linked = written(spread_groups(written(rows.join(several, "grp").select("row", "grp"), "linked"), shards, goals, seed), "linked-shards")
    placed = linked.where("shard is not null").select("row", "shard")
    room = [g - n for g, n in zip(goals, _loads(placed, shards))]

    free = written(rows.select("row", "grp").join(placed, "row", "left_anti").withColumn("draw", _draw(F.lit(seed), F.coalesce("grp", F.col("row").cast("string")))), "free")
    filled, ends = 0, []
    for r in room:
        filled += r
        ends.append(filled)
    # the shard whose run of places holds this place
    to = F.lit(shards)
    for k in reversed(range(shards)):
        to = F.when(F.col("place") <= ends[k], k).otherwise(to)
    dealt = ranked(free, [], ["draw", "row"], "place", is_draw=True).select("row", to.cast("int").alias("shard"))
    whole = written(rows.drop("grp").join(placed.unionByName(dealt), "row"), "sharded")
    slots = ranked(whole.withColumn("draw", _draw(F.lit(seed + 2), "id", "text_crc32")), "shard", ["draw", "id", "row"], "slot", is_draw=True)
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                        (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_groups(placed: DataFrame, group: str, shard: str = "shard") -> DataFrame:
    """(groups, cut, rows, apart): how many groups there are, how many lie in several shards, and how many rows lie outside
    their group's largest part."""
    parts = placed.where(F.col(group).isNotNull()).groupBy(group, shard).count()
    each = parts.groupBy(group).agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    return each.where("n > 1").agg(F.count("*").alias("groups"), F.count_if(F.col("most") < F.col("n")).alias("cut"),
                                   F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("most")).alias("apart"))
