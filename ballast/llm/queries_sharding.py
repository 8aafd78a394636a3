"""Query 6: shards of all documents.  Without SQL, as rounds go on until nothing moves; the tests check the law and the cut."""
from __future__ import annotations

from ballast.llm.registry import query, table
from ballast.llm.sharding import even_shards


@query("op6_sharding")
def sharding(spark, sf):
    return even_shards(table(spark, sf, "documents"), 24)
