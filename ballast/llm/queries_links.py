"""Query 13: alignment of two tokenizers.  No SQL; the tests hold it against the libraries on whole texts."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ballast.llm.registry import query, table
from ballast.llm.token_links import token_links


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark, sf, vocabulary_a: str | None = None, vocabulary_b: str | None = None):
    found, _ = token_links(table(spark, sf, "documents"), vocabulary_a or public_tokenizers.path("byte_bpe_50k.json"),
                           vocabulary_b or public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256").withColumn("doc_id", F.col("doc_id").cast("long"))
