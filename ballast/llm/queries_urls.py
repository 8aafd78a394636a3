"""Query 1: the verdict on every page's url."""
from __future__ import annotations

from ballast.llm.registry import query, table
from ballast.llm.url_filter import filter_urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_LISTED = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = f"""
WITH rules(verdict, h, p) AS (VALUES {_LISTED}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT page_id, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""


@query("op1_url_filters", SQL)
def url_filters(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).drop("url")
