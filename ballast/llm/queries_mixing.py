"""Query 2: the mix of all documents."""
from __future__ import annotations

from ballast.llm.mixing import mix
from ballast.llm.registry import query, table
from ballast.plans.registry import u_sql

ROUNDS = 16  # of the SQL twin; the job goes on until no document fits a gap


def _sql() -> str:
    steps = ["""sized AS (
  SELECT doc_id, coalesce(source, chr(1114111)) AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents)""", """sources AS (
  SELECT s, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY s) - 1) % 3]::DOUBLE AS w,
         row_number() OVER (ORDER BY s) AS place FROM sized GROUP BY s)""", """runs AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(2.0::DOUBLE * source_size) OVER o - 2.0::DOUBLE * source_size AS caps,
         sum(w) OVER o - w AS ws, sum(w) OVER () AS all_w, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM sources WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, place ROWS UNBOUNDED PRECEDING))""", """aims AS (
  SELECT s, source_size, least(cap, (SELECT max((total - caps) / (all_w - ws)) FROM runs) * w) AS target FROM runs)""", """parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part FROM aims)""",
             f"""r0 AS (
  SELECT doc_id, s, size, source_size, target, whole, target - whole * source_size AS need, 0 AS more,
         q / (1 + q) AS o
  FROM (SELECT *, u / (1 - u) / sqrt(greatest(size, 1) * docs / greatest(source_size, 1)) AS q FROM (
    SELECT *, {u_sql("mix", "doc_id")} AS u, count(*) OVER (PARTITION BY s) AS docs FROM sized JOIN parts USING (s))))"""]
    for k in range(1, ROUNDS + 1):
        steps.append(f"""g{k} AS (SELECT *, need - coalesce(sum(size * more) OVER (PARTITION BY s), 0)::DOUBLE AS gap FROM r{k - 1}),
r{k} AS (
  SELECT doc_id, s, size, source_size, target, whole, need, o,
         CASE WHEN more = 0 AND size > 0 AND size <= gap AND sum(CASE WHEN more = 0 AND size > 0 AND size <= gap THEN size ELSE 0 END)
                OVER (PARTITION BY s ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap THEN 1 ELSE more END AS more FROM g{k})""")
    steps.append(f"""last AS (SELECT *, need - coalesce(sum(size * more) OVER (PARTITION BY s), 0)::DOUBLE AS gap FROM r{ROUNDS}),
ends AS (
  SELECT *, CASE WHEN more = 0 AND size > 0 THEN
    row_number() OVER (PARTITION BY s, more = 0 AND size > 0 ORDER BY abs(size - gap), o, doc_id, size) END AS near FROM last)""")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, size, source_size, target,
       CAST((whole + more + CASE WHEN near = 1 AND abs(size - gap) < gap THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(whole + more + CASE WHEN near = 1 AND abs(size - gap) < gap THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM ends
"""


@query("op2_mixing_sources", _sql())
def mixing_sources(spark, sf):
    return mix(table(spark, sf, "documents"))
