"""Queries for the discretizers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.operators import discretize as D
from ballast.operators.encode import fit_one_hot
from ballast.plans import fixtures as X
from ballast.plans.registry import query


def _rare(spark, sf):
    return X.rare_lines(spark, sf).select("line_id", "l_extendedprice", "l_discount", "l_tax", "rare")


@query("d1_bins_uniform", sql=f"""
WITH {X.RARE_SQL}, s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM rare_lines)
SELECT line_id, CAST((CASE WHEN l_extendedprice >= a + (b - a) * 1 / 4 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= a + (b - a) * 2 / 4 THEN 1 ELSE 0 END)
  + (CASE WHEN l_extendedprice >= a + (b - a) * 3 / 4 THEN 1 ELSE 0 END) AS INTEGER) AS l_extendedprice FROM rare_lines, s""")
def d1(spark, sf):
    t = _rare(spark, sf).select("line_id", "l_extendedprice")
    return D.fit_discretizer(t, ["l_extendedprice"], "bins-uni", 4).transform(t)


@query("d2_bins_quantile", sql="""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.2) AS a, quantile_cont(o_totalprice, 0.4) AS b, quantile_cont(o_totalprice, 0.6) AS c,
  quantile_cont(o_totalprice, 0.8) AS d FROM orders)
SELECT o_orderkey, CAST((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT + (o_totalprice >= d)::INT AS INTEGER) AS o_totalprice
FROM orders, q""")
def d2(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.fit_discretizer(t, ["o_totalprice"], "bins-q", 5).transform(t)


@query("d2_quantile_edges", sql="""
SELECT 'l_extendedprice' AS "column", unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS prob, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0])), 4) AS edge FROM lineitem
UNION ALL SELECT 'l_tax', unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE, round(unnest(quantile_cont(l_tax, [0.0, 0.25, 0.5, 0.75, 1.0])), 4) FROM lineitem""")
def d2_edges(spark, sf):
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    t = X.table(spark, sf, "lineitem").select("l_extendedprice", "l_tax")
    found = D.exact_quantiles(t, ["l_extendedprice", "l_tax"], {c: probs for c in t.columns})
    return spark.createDataFrame([(c, p, round(e, 4)) for c, v in found.items() for p, e in zip(probs, v)],
                                 "column STRING, prob DOUBLE, edge DOUBLE")


@query("d3_bins_kmeans")
def d3(spark, sf):
    t = _rare(spark, sf).select("line_id", "l_extendedprice", "l_discount")
    return D.fit_discretizer(t, ["l_extendedprice", "l_discount"], "bins-k", 4).transform(t)


@query("d4_bins_mixture")
def d4(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.fit_discretizer(t, ["o_totalprice"], "bins-bgm", 4).transform(t)


@query("d5_chi_square_pass", sql="""
WITH c AS (SELECT l_quantity AS value, CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS a,
  CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS DOUBLE) AS n, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) AS r FROM lineitem GROUP BY 1),
p AS (SELECT value, lead(value) OVER w AS next_value, a, n, r, lead(a) OVER w AS a2, lead(n) OVER w AS n2, lead(r) OVER w AS r2 FROM c WINDOW w AS (ORDER BY value)),
t AS (SELECT *, a + n + r AS s1, a2 + n2 + r2 AS s2 FROM p WHERE next_value IS NOT NULL)
SELECT 'l_quantity' AS "column", value, next_value, round(
  power(a - (a + a2) * s1 / (s1 + s2), 2) / ((a + a2) * s1 / (s1 + s2)) + power(a2 - (a + a2) * s2 / (s1 + s2), 2) / ((a + a2) * s2 / (s1 + s2))
+ power(n - (n + n2) * s1 / (s1 + s2), 2) / ((n + n2) * s1 / (s1 + s2)) + power(n2 - (n + n2) * s2 / (s1 + s2), 2) / ((n + n2) * s2 / (s1 + s2))
+ power(r - (r + r2) * s1 / (s1 + s2), 2) / ((r + r2) * s1 / (s1 + s2)) + power(r2 - (r + r2) * s2 / (s1 + s2), 2) / ((r + r2) * s2 / (s1 + s2)), 4) AS chi2
FROM t""")
def d5_pass(spark, sf):
    t = X.table(spark, sf, "lineitem").select("l_quantity", "l_returnflag")
    return D.adjacent_chi_square(t, ["l_quantity"], "l_returnflag").withColumn("chi2", F.round("chi2", 4))


@query("d5_chi_merge")
def d5(spark, sf):
    t = _rare(spark, sf)
    return D.fit_discretizer(t, ["l_extendedprice", "l_discount", "l_tax"], "chi-merge", 6, label="rare").transform(t)


def _chi_sql(a: str, b: str, classes: list[str]) -> str:
    total = lambda v: "(" + " + ".join(f"{v}.{c}" for c in classes) + ")"
    part = lambda v, c: f"power({v}.{c} - ({a}.{c} + {b}.{c}) * {total(v)} / ({total(a)} + {total(b)}), 2) / (({a}.{c} + {b}.{c}) * {total(v)} / ({total(a)} + {total(b)}))"
    return " + ".join(f"(CASE WHEN {a}.{c} + {b}.{c} > 0 THEN {part(a, c)} + {part(b, c)} ELSE 0 END)" for c in classes)


@query("d5_chi_merge_quantity", sql=f"""
WITH RECURSIVE c AS (SELECT l_quantity AS v, CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS a,
  CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS DOUBLE) AS n, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) AS r FROM lineitem GROUP BY 1),
m AS (SELECT list(struct_pack(v := v, a := a, n := n, r := r) ORDER BY v) AS l FROM c
  UNION ALL
  SELECT list_concat(l[:i - 1], [struct_pack(v := l[i].v, a := l[i].a + l[i + 1].a, n := l[i].n + l[i + 1].n, r := l[i].r + l[i + 1].r)], l[i + 2:])
  FROM (SELECT l, list_position(s, list_min(s)) AS i FROM (
    SELECT l, list_transform(range(1, len(l)), lambda j: {_chi_sql("l[j]", "l[j + 1]", ["a", "n", "r"])}) AS s FROM m WHERE len(l) > 6))),
k AS (SELECT unnest(l[2:]).v AS cut FROM m WHERE len(l) = 6)
SELECT cut, (SELECT count(*) FROM lineitem WHERE l_quantity >= cut) AS above FROM k""")
def d5_quantity(spark, sf):
    t = X.table(spark, sf, "lineitem").select("l_quantity", "l_returnflag")
    cuts = D.chi_merge_cuts(t, ["l_quantity"], "l_returnflag", {"l_quantity": 6})["l_quantity"]
    above = t.agg(*[F.count(F.when(F.col("l_quantity") >= c, 1)).alias(f"c{i}") for i, c in enumerate(cuts)])
    return above.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"c{i}").alias("above")) for i, c in enumerate(cuts)])).alias("e")).select("e.*")


_CAIM = f"""
WITH {X.RARE_SQL}, c AS (SELECT l_extendedprice AS value, CAST(count(CASE WHEN rare = 0 THEN 1 END) AS DOUBLE) AS c0,
  CAST(count(CASE WHEN rare = 1 THEN 1 END) AS DOUBLE) AS c1 FROM rare_lines GROUP BY 1),
k AS (SELECT value, sum(c0) OVER w - c0 AS b0, sum(c1) OVER w - c1 AS b1, row_number() OVER w AS i, count(*) OVER () AS n,
  sum(c0) OVER () AS t0, sum(c1) OVER () AS t1 FROM c WINDOW w AS (ORDER BY value)),
s AS (SELECT value AS cut, b0, b1, t0, t1, (power(greatest(b0, b1), 2) / (b0 + b1) + power(greatest(t0 - b0, t1 - b1), 2) / (t0 - b0 + t1 - b1)) / 2 AS score
  FROM k WHERE i > 1 AND i < n)"""


@query("d6_caim_step", sql=_CAIM + """
SELECT 'l_extendedprice' AS "column", cut, round(score, 4) AS score FROM s""")
def d6_step(spark, sf):
    table, k = D.caim_table(_rare(spark, sf), ["l_extendedprice"], "rare")
    return D.caim_scores(table, {"l_extendedprice": []}, k).withColumn("score", F.round("score", 4))


@query("d6_caim", sql=_CAIM + """,
f AS (SELECT * FROM s ORDER BY score DESC, cut LIMIT 1),
w AS (SELECT s.cut, CASE WHEN s.cut < f.cut THEN
    (power(greatest(s.b0, s.b1), 2) / (s.b0 + s.b1) + power(greatest(f.b0 - s.b0, f.b1 - s.b1), 2) / (f.b0 - s.b0 + f.b1 - s.b1)
     + power(greatest(f.t0 - f.b0, f.t1 - f.b1), 2) / (f.t0 - f.b0 + f.t1 - f.b1)) / 3
  ELSE (power(greatest(f.b0, f.b1), 2) / (f.b0 + f.b1) + power(greatest(s.b0 - f.b0, s.b1 - f.b1), 2) / (s.b0 - f.b0 + s.b1 - f.b1)
     + power(greatest(f.t0 - s.b0, f.t1 - s.b1), 2) / (f.t0 - s.b0 + f.t1 - s.b1)) / 3 END AS score, f.score AS first_score
  FROM s, f WHERE s.cut <> f.cut),
g AS (SELECT cut FROM w WHERE score > first_score ORDER BY score DESC, cut LIMIT 1),
cuts AS (SELECT cut FROM f UNION ALL SELECT cut FROM g)
SELECT line_id, CAST((SELECT count(*) FROM cuts WHERE cuts.cut <= l_extendedprice) AS INTEGER) AS l_extendedprice FROM rare_lines""")
def d6(spark, sf):
    t = _rare(spark, sf).select("line_id", "l_extendedprice", "rare")
    return D.fit_discretizer(t, ["l_extendedprice"], "caim", label="rare").transform(t).drop("rare")


@query("d7_auto_bins")
def d7(spark, sf):
    t = _rare(spark, sf)
    found = D.auto_bins(t, ["l_extendedprice", "l_tax"])
    return spark.createDataFrame(sorted(found.items()), "column STRING, bins INT")


@query("d8_bin_weights")
def d8(spark, sf):
    t = X.table(spark, sf, "orders").select("o_totalprice")
    return D.fit_discretizer(t, ["o_totalprice"], "bins-q", 4, bin_weights="auto").table(t)


@query("d8_equal_bin_weights", sql="""
WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders), b AS (SELECT unnest([0, 1, 2, 3]) AS bin)
SELECT 'o_totalprice' AS "column", CAST(bin AS INTEGER) AS bin, round(CASE WHEN bin > 0 THEN e[bin] END, 4) AS low,
       round(CASE WHEN bin < 3 THEN e[bin + 1] END, 4) AS high, CAST(1.0 AS DOUBLE) AS weight FROM q, b""")
def d8_equal(spark, sf):
    t = X.table(spark, sf, "orders").select("o_totalprice")
    return D.fit_discretizer(t, ["o_totalprice"], "bins-q", 4).table(t) \
            .withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("d9_discretize_columns", sql=f"""
WITH {X.RARE_SQL}, s AS (SELECT min(l_extendedprice) AS a1, max(l_extendedprice) AS b1, min(l_discount) AS a2, max(l_discount) AS b2 FROM rare_lines)
SELECT line_id, CAST((l_extendedprice >= a1 + (b1 - a1) * 1 / 3)::INT + (l_extendedprice >= a1 + (b1 - a1) * 2 / 3)::INT AS INTEGER) AS l_extendedprice,
  CAST((l_discount >= a2 + (b2 - a2) * 1 / 3)::INT + (l_discount >= a2 + (b2 - a2) * 2 / 3)::INT AS INTEGER) AS l_discount, l_returnflag
FROM rare_lines, s""")
def d9(spark, sf):
    t = X.rare_lines(spark, sf).select("line_id", "l_extendedprice", "l_discount", "l_returnflag")
    return D.fit_discretizer(t, ["l_extendedprice", "l_discount"], "bins-uni", 3).transform(t)


@query("d10_discretize_one_hot", sql="""
WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders),
d AS (SELECT o_orderkey, o_orderstatus, (o_totalprice >= a + (b - a) * 1 / 3)::INT + (o_totalprice >= a + (b - a) * 2 / 3)::INT AS z FROM orders, s)
SELECT o_orderkey, concat_ws(',', (z = 0)::INT, (z = 1)::INT, (z = 2)::INT) AS price_span,
       concat_ws(',', (o_orderstatus = 'F')::INT, (o_orderstatus = 'O')::INT, (o_orderstatus = 'P')::INT) AS status_span FROM d""")
def d10(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    z = D.discretize_one_hot(t, D.fit_discretizer(t, ["o_totalprice"], "bins-uni", 3), ["o_totalprice", "o_orderstatus"])
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<int>").cast("array<string>"))
    return z.select("o_orderkey", text("o_totalprice").alias("price_span"), text("o_orderstatus").alias("status_span"))
