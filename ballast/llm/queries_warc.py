"""Query 7: every page through ARC and WARC files and back."""
from __future__ import annotations

from ballast.llm.registry import query, table
from ballast.llm.web_archives import convert, digest_rows

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # Fixed value: the base32 alphabet.
_CHUNK = "CAST('0x' || substr(h, 5 * CAST(i AS INTEGER) + 1, 5) AS BIGINT)"
_FOUR = " || ".join(f"substr('{_LETTERS}', 1 + CAST(({_CHUNK} // {32 ** k}) % 32 AS INTEGER), 1)" for k in (3, 2, 1, 0))
SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i: {_FOUR}), 'string_agg', '') AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM firsts
"""


@query("op7_web_archives", SQL)
def web_archives(spark, sf):
    return digest_rows(convert(table(spark, sf, "pages"))[0])
