"""Inverses, hand-computed values and independence from partitioning."""
import math

import pytest
from pyspark.sql import functions as F

from ballast.functions.draws import choose_by_weight, normal, uniform
from ballast.functions.ranks import expand, fold_of, ranked
from ballast.operators import encode as E
from ballast.operators import modes as M
from ballast.operators import prepare as P
from ballast.plans import fixtures as X
from ballast.spec import TableSpec, UnknownColumns, infer_spec, validate_columns

COLS = ["l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def lines(spark, sf):
    return X.rare_lines(spark, sf).cache()


@pytest.mark.parametrize("name", ["None", "stds", "mms01", "mms11", "stds-pca", "yeo"])
def test_scalers_invert(lines, name):
    m = E.fit_scaler(name, lines, COLS)
    coded = m.transform(lines)
    back = m.inverse(coded.select("line_id", "pca") if name == "stds-pca" else coded, clip=True)
    both = lines.alias("a").join(back.alias("b"), "line_id")
    worst = both.agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in COLS]).first()
    assert all(worst[c] < 1e-5 * max(1.0, 1e5 if c == "l_extendedprice" else 1.0) for c in COLS)


def test_unknown_scaler_raises(lines):
    with pytest.raises(ValueError):
        E.fit_scaler("nms", lines, COLS)


def test_yeo_johnson_makes_values_normal(spark):
    df = spark.range(4000).select(F.exp(normal("t", "id")).alias("x"))
    m = E.yeo_johnson_fit(df, ["x"])
    z = m.transform(df).agg(F.skewness("x").alias("s"), F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).first()
    assert abs(z["s"]) < 0.15 and abs(z["m"]) < 1e-6 and abs(z["d"] - 1) < 1e-6


def test_per_group_yeo_johnson_equals_separate_fits(lines):
    m = E.per_group_yeo_johnson(lines, ["l_extendedprice"], "l_returnflag")
    found = {r["l_returnflag"]: r["_y_l_extendedprice"]["lam"] for r in m.models.collect()}
    for flag in "ANR":
        alone = E.yeo_johnson_fit(lines.where(F.col("l_returnflag") == flag), ["l_extendedprice"])
        assert math.isclose(found[flag], alone.lam["l_extendedprice"], abs_tol=1e-6)
    back = m.inverse(m.transform(lines))
    worst = lines.alias("a").join(back.alias("b"), "line_id").agg(F.max(F.abs(F.col("a.l_extendedprice") - F.col("b.l_extendedprice")))).first()[0]
    assert worst < 0.01


def test_per_group_yeo_johnson_of_many_groups(spark):
    """Ten thousand groups, of both signs; constant, single, null and not-a-number values; a null group; a group that was not fitted."""
    rows = spark.range(60_000).select((F.col("id") % 10_000).cast("int").alias("g"), (F.hash("id") / F.lit(2.0 ** 30) + (F.col("id") % 7)).alias("x"))
    odd = spark.createDataFrame([(20_000, 5.0), (20_000, 5.0), (20_001, -3.0), (20_002, None), (20_003, float("nan")), (None, 1.0)], "g INT, x DOUBLE")
    t = rows.unionByName(odd).withColumn("keep", F.col("x")).cache()
    m = E.per_group_yeo_johnson(t, ["x"], "g")
    assert m.models.count() == 10_002
    z = m.transform(t)
    ok = z.where("g < 10000").groupBy("g").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).agg(F.max(F.abs("m")), F.max(F.abs(F.col("d") - 1))).first()
    assert ok[0] < 1e-6 and ok[1] < 1e-6
    assert m.inverse(z).where("g < 10000").agg(F.max(F.abs(F.col("x") - F.col("keep"))), F.count("x")).first()[:] == pytest.approx((0, 60_000), abs=1e-6)
    assert [r["x"] for r in z.where("g IN (20000, 20001)").collect()] == [0.0, 0.0, 0.0]
    assert z.where("g IS NULL OR g IN (20002, 20003)").where("x IS NOT NULL").isEmpty() and z.count() == t.count()


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id INT, x DOUBLE")
    for name, want in (("stds", 0.0), ("mms01", 0.0), ("mms11", -1.0)):
        m = E.fit_scaler(name, df, ["x"])
        assert {r["x"] for r in m.transform(df).collect()} == {want}
        assert {r["x"] for r in m.inverse(m.transform(df)).collect()} == {5.0}


def test_layout_lookup():
    layout = E.encoded_layout(["a", "b", "c"], {"b": ["x", "y"]}, {"c": 3})
    assert layout.spans == (("a", 0, 1, "continuous"), ("b", 1, 2, "discrete"), ("c", 3, 4, "modes")) and layout.width == 7
    assert layout.value_id("b", "y") == {"discrete_column_id": 0, "column_id": 1, "value_id": 1}
    with pytest.raises(ValueError):
        layout.value_id("b", "z")
    with pytest.raises(UnknownColumns):
        layout.value_id("q", "z")


def test_mixture_finds_two_modes(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 100 + normal("a", "id")).otherwise(normal("a", "id")).alias("x"), "id")
    found = M.active_modes(df, M.mixture_1d(df, ["x"]))["x"]
    used = [m for m in found if m.used]
    assert sum(m.weight for m in used if abs(m.mean) < 10) == pytest.approx(2 / 3, abs=0.05)
    assert sum(m.weight for m in used if abs(m.mean - 100) < 10) == pytest.approx(1 / 3, abs=0.05)


def test_mode_normalization_inverts(lines):
    model = M.mode_normalize(lines, ["l_extendedprice"])
    coded = model.encode(lines, "line_id")
    lim = coded.agg(F.min("l_extendedprice_value"), F.max("l_extendedprice_value"), F.max("l_extendedprice_slot")).first()
    assert lim[0] >= -0.99 and lim[1] <= 0.99 and lim[2] < model.slots("l_extendedprice")
    back = model.decode(coded)
    inside = lines.alias("a").join(coded.select("line_id", "l_extendedprice_value"), "line_id").join(back.alias("b"), "line_id") \
        .where(F.abs("l_extendedprice_value") < 0.99)
    assert inside.agg(F.max(F.abs(F.col("a.l_extendedprice") - F.col("b.l_extendedprice")))).first()[0] < 1e-6


def test_slots_ordered_by_use(lines):
    model = M.mode_normalize(lines, ["l_tax"])
    counts = [r["n"] for r in model.encode(lines, "line_id").groupBy("l_tax_slot").agg(F.count(F.lit(1)).alias("n")).orderBy("l_tax_slot").collect()]
    assert counts == sorted(counts, reverse=True)


def test_mixed_column_marks_missing(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else 0.0 if i % 5 == 1 else float(i)) for i in range(200)], "id BIGINT, x DOUBLE")
    model = M.mode_normalize(df, [], {"x": (0.0, M.MISSING)})
    back = {r["id"]: r["x"] for r in model.decode(model.encode(df, "id")).collect()}
    assert all(back[i] == M.MISSING for i in range(0, 200, 5)) and all(back[i] == 0.0 for i in range(1, 200, 5))


def test_spec_and_validation(lines):
    spec = infer_spec(lines, "rare", "line_id")
    assert spec.continuous == ("l_extendedprice", "l_discount", "l_tax") and spec.categorical == ("l_returnflag",)
    with pytest.raises(UnknownColumns, match="nope"):
        validate_columns(lines, ["l_tax", "nope"])


def test_describe_and_low_cardinality(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "a", "x")], "id INT, label STRING, c STRING")
    rows = P.describe_table(df, TableSpec(features=("c",), label="label", categorical=("c",))).collect()
    assert [(r["label"], r["n"], r["imbalance_ratio"], r["classes"]) for r in rows] == [("a", 3, 1.0, 2), ("b", 1, 3.0, 2)]
    flags = {r["column"]: r["is_categorical"] for r in P.low_cardinality(df, ["c", "id"], "label").collect()}
    assert flags == {"c": True, "id": False}


def test_make_classification(spark):
    t = P.make_classification(spark, 1000, (0.9, 0.1))
    assert {r["label"]: r["n"] for r in P.class_counts(t, "label").collect()} == {0: 900, 1: 100}
    with pytest.raises(ValueError):
        P.make_classification(spark, 10, (1, 1, 1))


@pytest.mark.parametrize("buckets", [1, 3, 16])
@pytest.mark.parametrize("order", ["num", "text"])
def test_ranks_do_not_depend_on_buckets(spark, buckets, order):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("num"), F.concat(F.lit("row-"), F.format_string("%05d", F.col("id") * 91 % 500)).alias("text"),
                                 F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    rows = ranked(df, "g", order, size="n", buckets=buckets).collect()
    for g in "ab":
        mine = sorted((r[order], r["rank"], r["n"]) for r in rows if r["g"] == g)
        assert [r[1] for r in mine] == list(range(1, len(mine) + 1)) and {r[2] for r in mine} == {len(mine)}


def test_folds_like_ntile(spark):
    for n in (1, 3, 7, 10):
        df = spark.range(1, n + 1).select("id", fold_of(F.col("id"), F.lit(n), 4).alias("f"), F.expr("ntile(4) over (order by id)").alias("t"))
        assert all(r["f"] == r["t"] for r in df.collect())


def test_expand_counts(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 23)], "k STRING, need BIGINT")
    rows = expand(df, "need", chunk=4).collect()
    assert sorted(r["copy"] for r in rows if r["k"] == "c") == list(range(1, 24)) and len(rows) == 28


def test_draws_do_not_depend_on_partitioning(spark):
    a = spark.range(0, 1000, 1, 1).select("id", uniform("t", "id").alias("u"))
    b = spark.range(0, 1000, 1, 7).select("id", uniform("t", "id").alias("u"))
    assert a.exceptAll(b).count() == 0
    m = a.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0] - 0.5) < 0.03 and 0 <= m[1] and m[2] < 1


@pytest.mark.parametrize("as_column", [False, True])
def test_choose_by_weight(spark, as_column):
    w = [0.0, 2.0, 0.0, 1.0, 1.0]
    arg = F.array(*[F.lit(x) for x in w]) if as_column else w
    df = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (0.74,), (0.75,), (0.999,)], "u DOUBLE")
    assert [r[0] for r in df.select(choose_by_weight(F.col("u"), arg)).collect()] == [1, 1, 3, 3, 4, 4]
