"""Queries 9 and 10: token counts and packing.  Neither has SQL; the tests hold them against the library."""
from __future__ import annotations

import public_tokenizers

from ballast.llm.packing import pack
from ballast.llm.registry import query, table
from ballast.llm.token_counts import count_tokens


@query("op9_token_counts")
def token_counts(spark, sf, vocabulary: str | None = None):
    return count_tokens(table(spark, sf, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), 512)


@query("op10_best_fit_packing")
def best_fit_packing(spark, sf, vocabulary: str | None = None):
    return pack(table(spark, sf, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"), 4096, 1, with_ids=False)
