"""Queries for encoders and scalers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.draws import uniform
from ballast.operators import encode as E
from ballast.operators import modes as M
from ballast.plans import fixtures as X
from ballast.plans.registry import query, u_sql

LINE_COLS = ["l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _lines(spark, sf):
    return X.rare_lines(spark, sf).select("line_id", *LINE_COLS)


@query("c1_standardize", sql=f"""
WITH {X.RARE_SQL}, s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1,
  avg(l_discount) AS m2, stddev_pop(l_discount) AS s2, avg(l_tax) AS m3, stddev_pop(l_tax) AS s3 FROM rare_lines)
SELECT line_id, round((l_extendedprice - m1) / s1, 6) AS l_extendedprice, round((l_discount - m2) / s2, 6) AS l_discount,
       round((l_tax - m3) / s3, 6) AS l_tax FROM rare_lines, s""")
def c1(spark, sf):
    t = _lines(spark, sf)
    return _rounded(E.standardize(t, LINE_COLS).transform(t), LINE_COLS)


@query("c2_min_max_unit", sql=f"""
WITH {X.RARE_SQL}, s AS (SELECT min(l_extendedprice) AS a1, max(l_extendedprice) AS b1,
  min(l_discount) AS a2, max(l_discount) AS b2, min(l_tax) AS a3, max(l_tax) AS b3 FROM rare_lines)
SELECT line_id, round((l_extendedprice - a1) / (b1 - a1), 6) AS l_extendedprice,
       round((l_discount - a2) / (b2 - a2), 6) AS l_discount, round((l_tax - a3) / (b3 - a3), 6) AS l_tax FROM rare_lines, s""")
def c2(spark, sf):
    t = _lines(spark, sf)
    return _rounded(E.min_max(t, LINE_COLS).transform(t), LINE_COLS)


@query("c2_min_max_inverse", sql=f"WITH {X.RARE_SQL} SELECT line_id, round(l_extendedprice, 4) AS l_extendedprice, "
       "round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax FROM rare_lines")
def c2_back(spark, sf):
    t = _lines(spark, sf)
    m = E.min_max(t, LINE_COLS)
    return _rounded(m.inverse(m.transform(t), clip=True), LINE_COLS, 4)


@query("c3_min_max_signed", sql="""
WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
SELECT o_orderkey, round((o_totalprice - a) / ((b - a) / 2) - 1, 6) AS o_totalprice FROM orders, s""")
def c3(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _rounded(E.min_max(t, ["o_totalprice"], -1.0, 1.0).transform(t), ["o_totalprice"])


@query("c4_standardize_pca", sql=f"""
WITH {X.RARE_SQL}, s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1 FROM rare_lines)
SELECT line_id, round(l_extendedprice, 3) AS l_extendedprice, round(l_discount, 3) AS l_discount, round(l_tax, 3) AS l_tax,
       CAST(3 AS INTEGER) AS components FROM rare_lines""")
def c4(spark, sf):
    t = _lines(spark, sf)
    m = E.standardize_pca(t, LINE_COLS)
    coded = m.transform(t).select("line_id", "pca")
    back = m.inverse(coded).withColumn("components", F.size("pca")).drop("pca")
    return _rounded(back, LINE_COLS, 3)


@query("c5_yeo_johnson_fixed_lambda", sql="""
SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (power(c_acctbal + 1, 0.5) - 1) / 0.5
  ELSE -(power(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS c_acctbal FROM customer""")
def c5_fixed(spark, sf):
    t = X.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return _rounded(t.withColumn("c_acctbal", E.yeo_johnson(F.col("c_acctbal"), 0.5)), ["c_acctbal"], 4)


@query("c5_yeo_johnson")
def c5(spark, sf):
    t = _lines(spark, sf)
    m = E.yeo_johnson_fit(t, LINE_COLS)
    return m.transform(t)


@query("c5_yeo_johnson_inverse", sql="SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def c5_back(spark, sf):
    t = X.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    m = E.yeo_johnson_fit(t, ["c_acctbal"])
    return _rounded(m.inverse(m.transform(t), clip=True), ["c_acctbal"], 2)


@query("c6_passthrough", sql="SELECT o_orderkey, o_totalprice FROM orders")
def c6(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return E.fit_scaler("None", t, ["o_totalprice"]).transform(t)


# Modes given as fixed numbers, so that SQL can repeat the data part exactly.
GIVEN = [M.Mode(60000.0, 30000.0, 0.3), M.Mode(200000.0, 50000.0, 0.45), M.Mode(400000.0, 40000.0, 0.2),
         M.Mode(90000000.0, 10.0, 0.05, used=False)]


def _given_model() -> M.ModeModel:
    return M.ModeModel({"o_totalprice": list(GIVEN)}, low={"o_totalprice": 1500.0}, high={"o_totalprice": 450000.0})


def _prices(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


_MODES_SQL = f"""
d AS (SELECT o_orderkey, o_totalprice AS x,
  ln(0.3) - ln(30000.0) - 0.5 * power((o_totalprice - 60000.0) / 30000.0, 2) AS d0,
  ln(0.45) - ln(50000.0) - 0.5 * power((o_totalprice - 200000.0) / 50000.0, 2) AS d1,
  ln(0.2) - ln(40000.0) - 0.5 * power((o_totalprice - 400000.0) / 40000.0, 2) AS d2,
  ln(0.05) - ln(10.0) - 0.5 * power((o_totalprice - 90000000.0) / 10.0, 2) AS d3 FROM orders),
r AS (SELECT o_orderkey, x, d0, d1, d2, d3, exp(d0 - greatest(d0, d1, d2, d3)) AS e0, exp(d1 - greatest(d0, d1, d2, d3)) AS e1,
  exp(d2 - greatest(d0, d1, d2, d3)) AS e2, exp(d3 - greatest(d0, d1, d2, d3)) AS e3 FROM d),
p AS (SELECT o_orderkey, x, d0, d1, d2, d3, e0 / (e0 + e1 + e2 + e3) + 0.000001 AS p0, e1 / (e0 + e1 + e2 + e3) + 0.000001 AS p1,
  e2 / (e0 + e1 + e2 + e3) + 0.000001 AS p2, {u_sql('mode.o_totalprice', 'o_orderkey')} AS u FROM r),
m AS (SELECT o_orderkey, x, d0, d1, d2, d3, CASE WHEN p0 > u * (p0 + p1 + p2) THEN 0 WHEN p0 + p1 > u * (p0 + p1 + p2) THEN 1 ELSE 2 END AS mode FROM p),
v AS (SELECT o_orderkey, x, mode, greatest(least((x - CASE mode WHEN 0 THEN 60000.0 WHEN 1 THEN 200000.0 ELSE 400000.0 END)
  / (4 * CASE mode WHEN 0 THEN 30000.0 WHEN 1 THEN 50000.0 ELSE 40000.0 END), 0.99), -0.99) AS scalar FROM m),
o AS (SELECT mode, CAST(row_number() OVER (ORDER BY n DESC, mode) - 1 AS INTEGER) AS slot FROM
  (SELECT mode, sum(n) AS n FROM (SELECT mode, count(*) AS n FROM m GROUP BY mode UNION ALL SELECT unnest([0, 1, 2]), 0) GROUP BY mode))"""


@query("c7_mode_normalize_given", sql=f"""
WITH {_MODES_SQL} SELECT o_orderkey, round(scalar, 10) AS scalar, slot FROM v JOIN o USING (mode)""")
def c7_given(spark, sf):
    t = _given_model().encode(_prices(spark, sf), "o_orderkey")
    return t.select("o_orderkey", F.round("o_totalprice_value", 10).alias("scalar"), F.col("o_totalprice_slot").alias("slot"))


@query("c7_mode_normalize")
def c7(spark, sf):
    t = X.rare_lines(spark, sf).select("line_id", "l_extendedprice", "l_tax")
    return M.mode_normalize(t, ["l_extendedprice", "l_tax"]).encode(t, "line_id")


@query("c8_one_hot", sql="""
SELECT o_orderkey, concat_ws(',', CAST(o_orderstatus = 'F' AS INTEGER), CAST(o_orderstatus = 'O' AS INTEGER), CAST(o_orderstatus = 'P' AS INTEGER)) AS span,
       CAST(3 AS INTEGER) AS width FROM orders""")
def c8(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    m = E.fit_one_hot(t, ["o_orderstatus"])
    return m.transform(t).select("o_orderkey", F.concat_ws(",", F.col("o_orderstatus").cast("array<int>").cast("array<string>")).alias("span"),
                                 F.lit(m.width).alias("width"))


@query("c9_clip_to_fit_range", sql="""
WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
SELECT o_orderkey, round(greatest(least(o_totalprice * 1.5 - 20000, b), a), 4) AS o_totalprice FROM orders, s""")
def c9(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    s = E.column_stats(t, ["o_totalprice"])["o_totalprice"]
    x = F.col("o_totalprice") * 1.5 - 20000.0
    return t.select("o_orderkey", F.round(E.clip_to_range(x, s["min"], s["max"]), 4).alias("o_totalprice"))


@query("c10_inverse_one_hot", sql="SELECT doc_id, lang, source FROM documents")
def c10(spark, sf):
    t = X.table(spark, sf, "documents").select("doc_id", "lang", "source")
    m = E.fit_one_hot(t, ["lang", "source"])
    return m.inverse(m.transform(t))


@query("c11_encoded_layout", sql="""
WITH k AS (SELECT (SELECT count(DISTINCT lang) FROM documents) AS l, (SELECT count(DISTINCT source) FROM documents) AS s),
d AS (SELECT 0 AS i, 'n_chars' AS "column", 1 AS dim, 'continuous' AS kind UNION ALL SELECT 1, 'lang', l, 'discrete' FROM k
  UNION ALL SELECT 2, 'source', s, 'discrete' FROM k)
SELECT "column", CAST(coalesce(sum(dim) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
       CAST(dim AS INTEGER) AS dim, kind FROM d""")
def c11(spark, sf):
    t = X.table(spark, sf, "documents").select("n_chars", "lang", "source")
    return E.encoded_layout(["n_chars", "lang", "source"], E.sorted_vocabulary(t, ["lang", "source"])).table(t)


@query("c12_frequency_vocabulary", sql="""
WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type)
SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) - 1 AS INTEGER) AS code FROM v""")
def c12(spark, sf):
    return E.frequency_vocabulary(X.table(spark, sf, "part"), ["p_brand", "p_type"])


@query("c13_active_modes", sql=f"""
WITH {_MODES_SQL}, a AS (SELECT CASE WHEN d0 >= greatest(d1, d2, d3) THEN 0 WHEN d1 >= greatest(d2, d3) THEN 1 WHEN d2 >= d3 THEN 2 ELSE 3 END AS mode FROM m),
w AS (SELECT unnest([0, 1, 2, 3]) AS mode, unnest([0.3, 0.45, 0.2, 0.05]) AS weight)
SELECT CAST(w.mode AS INTEGER) AS mode, CAST(w.weight AS DOUBLE) AS weight, (weight > 0.005 AND w.mode IN (SELECT mode FROM a)) AS used FROM w""")
def c13(spark, sf):
    found = M.active_modes(_prices(spark, sf), {"o_totalprice": list(GIVEN)}, eps=0.005)["o_totalprice"]
    return spark.createDataFrame([(i, m.weight, m.used) for i, m in enumerate(found)], "mode INT, weight DOUBLE, used BOOLEAN")


@query("c14_draw_mode", sql=f"WITH {_MODES_SQL} SELECT o_orderkey, CAST(mode AS INTEGER) AS mode FROM m")
def c14(spark, sf):
    t = _prices(spark, sf)
    return t.select("o_orderkey", M.draw_mode(F.col("o_totalprice"), GIVEN, uniform("mode.o_totalprice", "o_orderkey")).alias("mode"))


@query("c15_reorder_modes_by_use", sql=f"""
WITH {_MODES_SQL} SELECT CAST(mode AS INTEGER) AS mode, slot, count(v.o_orderkey) AS n FROM o LEFT JOIN v USING (mode) GROUP BY mode, slot""")
def c15(spark, sf):
    model = _given_model()
    coded = model.encode(_prices(spark, sf), "o_orderkey")
    order = model.order["o_totalprice"]
    slots = spark.createDataFrame([(mode, slot) for slot, mode in enumerate(order)], "mode INT, slot INT")
    n = coded.groupBy(F.col("o_totalprice_slot").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return slots.join(n, "slot", "left").select("mode", "slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("c16_mixed_column_given", sql="""
SELECT CASE WHEN l_discount = 0 THEN 0 WHEN l_discount = 0.05 THEN 1 ELSE 2 END AS slot,
       round(CASE WHEN l_discount = 0 THEN -0.5 WHEN l_discount = 0.05 THEN 0.0 ELSE greatest(least((l_discount - 0.05) / (4 * 0.025), 0.99), -0.99) END, 6) AS scalar,
       count(*) AS n FROM lineitem GROUP BY ALL""")
def c16_given(spark, sf):
    t = X.rare_lines(spark, sf).select("line_id", "l_discount")
    mode = M.Mode(0.05, 0.025, 1.0)
    model = M.ModeModel({"l_discount": [mode]}, {"l_discount": [0.0, 0.05]},
                        {"l_discount": M.modal_scalars([0.0, 0.05], [mode])})
    coded = model.encode(t, "line_id", reorder=False)
    return coded.groupBy(F.col("l_discount_slot").alias("slot"), F.round("l_discount_value", 6).alias("scalar")) \
                .agg(F.count(F.lit(1)).alias("n"))


@query("c16_mixed_column", sql="""
SELECT round(CASE WHEN l_tax = 0.08 THEN -9999999 ELSE l_tax END, 4) AS l_tax, count(*) AS n FROM lineitem WHERE l_tax IN (0, 0.08) GROUP BY 1""")
def c16(spark, sf):
    t = X.rare_lines(spark, sf).select("line_id", F.when(F.col("l_tax") == 0.08, F.lit(M.MISSING)).otherwise(F.col("l_tax")).alias("l_tax"))
    model = M.mode_normalize(t, [], {"l_tax": (0.0, M.MISSING)})
    back = model.decode(model.encode(t, "line_id"))
    # the modal values come back exactly; the other values were drawn to a mode
    return back.where(F.col("l_tax").isin(0.0, M.MISSING)).groupBy(F.round("l_tax", 4).alias("l_tax")).agg(F.count(F.lit(1)).alias("n"))


@query("c16_mixed_column_rest", sql="SELECT count(*) AS n, true AS in_range, true AS exact FROM lineitem WHERE l_tax NOT IN (0, 0.08)")
def c16_rest(spark, sf):
    """The other values of a mixed column lie in the range of the mode they were drawn to, and come back as they were unless they were clipped to it."""
    tax = F.col("l_tax").cast("double")
    t = X.rare_lines(spark, sf).select("line_id", F.when(tax == 0.08, F.lit(M.MISSING)).otherwise(tax).alias("l_tax"), tax.alias("was"))
    model = M.mode_normalize(t, [], {"l_tax": (0.0, M.MISSING)})
    coded = model.encode(t, "line_id").withColumns({"slot": F.col("l_tax_slot"), "scalar": F.col("l_tax_value")})
    used, order = model.used("l_tax"), model.order["l_tax"]
    modes = [used[i - 2] if i > 1 else None for i in order]  # the two modal values come first in the fitted order
    mean, sd = (F.element_at(F.array(*[F.lit(getattr(m, k) if m else None).cast("double") for m in modes]), F.col("slot") + 1) for k in ("mean", "sd"))
    back = model.decode(coded).where(~F.col("was").isin(0.0, 0.08))
    inside = F.coalesce(F.abs(F.col("l_tax") - mean) <= M.SPREAD * M.EDGE * sd + 1e-9, F.lit(False))
    same = (F.abs(F.col("l_tax") - F.col("was")) < 1e-9) | (F.abs("scalar") >= M.EDGE)
    return back.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("in_range"), F.bool_and(same).alias("exact"))


@query("c17_general_scale", sql="""
WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, -0.001 AS qa, max(l_quantity) + 0.001 AS qb FROM lineitem)
SELECT round((l_extendedprice - a) / ((b - a) / 2) - 1, 6) AS price, round((l_quantity - qa) / ((qb - qa) / 2) - 1, 6) AS quantity, count(*) AS n
FROM lineitem, s GROUP BY ALL""")
def c17(spark, sf):
    t = X.table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    z = E.general_scale(t, ["l_extendedprice", "l_quantity"], integer=["l_quantity"]).transform(t)
    return z.groupBy(F.round("l_extendedprice", 6).alias("price"), F.round("l_quantity", 6).alias("quantity")).agg(F.count(F.lit(1)).alias("n"))


@query("c18_inverse_with_reject", sql=f"""
WITH {_MODES_SQL}, b AS (SELECT o_orderkey, scalar * 4 * CASE mode WHEN 0 THEN 30000.0 WHEN 1 THEN 50000.0 ELSE 40000.0 END
  + CASE mode WHEN 0 THEN 60000.0 WHEN 1 THEN 200000.0 ELSE 400000.0 END AS x FROM v)
SELECT o_orderkey, CAST(round_even(x, 0) AS BIGINT) AS o_totalprice FROM b WHERE x >= 1500 AND x <= 450000""")
def c18(spark, sf):
    model = _given_model()
    rows, accepted = model.decode_or_reject(model.encode(_prices(spark, sf), "o_orderkey"), integer=["o_totalprice"])
    return E.round_integers(rows.where(accepted).select("o_orderkey", "o_totalprice"), {"o_totalprice": "bigint"})


@query("c18_reject_count", sql=f"""
WITH {_MODES_SQL}, b AS (SELECT o_orderkey, scalar * 4 * CASE mode WHEN 0 THEN 30000.0 WHEN 1 THEN 50000.0 ELSE 40000.0 END
  + CASE mode WHEN 0 THEN 60000.0 WHEN 1 THEN 200000.0 ELSE 400000.0 END AS x FROM v)
SELECT (x >= 1500 AND x <= 450000) AS accepted, count(*) AS n FROM b GROUP BY 1""")
def c18_count(spark, sf):
    model = _given_model()
    rows, _ = model.decode_or_reject(model.encode(_prices(spark, sf), "o_orderkey"))
    return rows.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query("c19_inverse_without_reject", sql=f"""
WITH {_MODES_SQL} SELECT o_orderkey, round(scalar * 4 * CASE mode WHEN 0 THEN 30000.0 WHEN 1 THEN 50000.0 ELSE 40000.0 END
  + CASE mode WHEN 0 THEN 60000.0 WHEN 1 THEN 200000.0 ELSE 400000.0 END, 4) AS o_totalprice FROM v""")
def c19(spark, sf):
    model = _given_model()
    return _rounded(model.decode(model.encode(_prices(spark, sf), "o_orderkey")), ["o_totalprice"], 4)


@query("c20_round_integer_columns", sql="SELECT p_partkey, p_size FROM part")
def c20(spark, sf):
    t = X.table(spark, sf, "part").select("p_partkey", "p_size")
    m = E.general_scale(t, ["p_size"], integer=["p_size"])
    return E.round_integers(E.general_inverse(m, m.transform(t)), {"p_size": "int"})


@query("c21_per_group_scale", sql="""
WITH s AS (SELECT c_mktsegment, min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer GROUP BY c_mktsegment)
SELECT c_custkey, c_mktsegment, round((c_acctbal - a) / ((b - a) / 2) - 1, 6) AS c_acctbal FROM customer JOIN s USING (c_mktsegment)""")
def c21(spark, sf):
    t = X.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return _rounded(E.per_group_scale(t, ["c_acctbal"], "c_mktsegment", "mms11").transform(t), ["c_acctbal"])


@query("c21_per_group_standardize", sql="""
WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders GROUP BY o_orderstatus)
SELECT o_orderkey, o_orderstatus, round((o_totalprice - m) / d, 5) AS z, round(o_totalprice, 2) AS back FROM orders JOIN s USING (o_orderstatus)""")
def c21_std(spark, sf):
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("z"))
    m = E.per_group_scale(t, ["z"], "o_orderstatus", "stds")
    z = m.transform(t)
    back = m.inverse(z).select("o_orderkey", F.round("z", 2).alias("back"))
    return _rounded(z, ["z"], 5).join(back, "o_orderkey")


def _grid_sql(name: str, start: str, step: str, before: str) -> str:
    """The likeliest of 25 lambdas from ``start`` on for every customer, as a CTE."""
    y = "CASE WHEN abs(lam) < 1e-12 THEN ln(1 + x) ELSE (power(x + 1, lam) - 1) / lam END"
    return f"""{name}v AS (SELECT o.o_custkey, o.x, i, {start} + i * {step} AS lam FROM o {before}, range(0, 25) r(i)),
{name}s AS (SELECT o_custkey, i, lam, avg({y}) AS m, var_pop({y}) AS v, count(*) AS n, sum(ln(1 + x)) AS slope FROM {name}v GROUP BY 1, 2, 3),
{name} AS (SELECT o_custkey, arg_max(struct_pack(lam := lam, m := m, d := sqrt(v)), -n / 2 * ln(v) + (lam - 1) * slope) AS b FROM {name}s WHERE v > 0 GROUP BY 1)"""


@query("c5_yeo_johnson_per_group", sql=f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice / 10000.0 AS x FROM orders), {_grid_sql("one", "-2.0", "0.25", "")},
{_grid_sql("two", "coalesce(one.b.lam, 1.0) - 0.25", "(0.5 / 24)", "LEFT JOIN one USING (o_custkey)")},
z AS (SELECT o.*, two.b.lam AS lam, two.b.m AS m, two.b.d AS d FROM o LEFT JOIN two USING (o_custkey))
SELECT o_orderkey, o_custkey, round(CASE WHEN lam IS NULL THEN 0 WHEN abs(lam) < 1e-12 THEN (ln(1 + x) - m) / d ELSE ((power(x + 1, lam) - 1) / lam - m) / d END, 5) AS z,
  round(x, 6) AS back FROM z""")
def c5_groups(spark, sf):
    """A map per customer; two rounds of the grid, which SQL can follow to the last lambda."""
    t = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 10000.0).alias("z"))
    m = E.per_group_yeo_johnson(t, ["z"], "o_custkey", rounds=2)
    z = m.transform(t)
    return _rounded(z, ["z"], 5).join(m.inverse(z).select("o_orderkey", F.round("z", 6).alias("back")), "o_orderkey")
