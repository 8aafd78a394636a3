"""Query 11: passages that documents share."""
from __future__ import annotations

from ballast.llm.registry import query, table
from ballast.llm.repeated_passages import remove_repeats

SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM words),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN firsts USING (s), range(13) t(k) WHERE least < doc_id),
places AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM places ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""


@query("op11_substring_dedup", SQL)
def substring_dedup(spark, sf):
    return remove_repeats(table(spark, sf, "documents"), 13, digest=True).withColumnRenamed("kept", "kept_sha256")
