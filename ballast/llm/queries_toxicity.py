"""Query 3: the toxicity of every document.  Without SQL, as a model is fitted; the tests measure it on held-out labels."""
from __future__ import annotations

from ballast.llm.registry import query, table
from ballast.llm.toxicity import score_documents


@query("op3_toxicity")
def toxicity(spark, sf):
    scored = score_documents(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
