"""Rebalancing: counts, geometry and reproducibility."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.functions.ranks import expand
from ballast.operators import counts as C
from ballast.operators import resample as G
from ballast.operators import synth as H
from ballast.operators.prepare import class_counts
from ballast.plans import fixtures as X
from ballast.plans.evaluate import cluster_resampler, sampler_suite
from ballast.spec import TableSpec

SPEC = TableSpec(features=("x", "y"), label="label", row_id=("id",))


def blobs(spark, sizes=(90, 30, 12), seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, float(rng.normal(c * 1.5)), float(rng.normal(c)), "abc"[c]))
            i += 1
    return spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE, label STRING")


def counts(df):
    return {r["label"]: r["n"] for r in class_counts(df, "label").collect()}


@pytest.fixture(scope="module")
def table(spark):
    return blobs(spark).cache()


def test_plans(table):
    need = lambda s: C.plan_counts(table, "label", s).need
    assert need("auto") == need("not majority") == {"a": 0, "b": 60, "c": 78}
    assert need("minority") == {"a": 0, "b": 0, "c": 78}
    assert need("not minority") == {"a": 0, "b": 60, "c": 0}
    assert need({"c": 40}) == {"a": 0, "b": 0, "c": 28}
    assert need(lambda n: {"b": n["a"]}) == {"a": 0, "b": 60, "c": 0}
    assert need("create-new") == {"a": 90, "b": 30, "c": 12}
    for bad in ("most", 0.5, {"c": 1}, {"z": 5}):
        with pytest.raises(ValueError):
            need(bad)


def test_ratio(spark):
    t = blobs(spark, (50, 10))
    assert C.plan_counts(t, "label", 0.5).need == {"a": 0, "b": 15}
    with pytest.raises(ValueError):
        C.plan_counts(t, "label", 0.1)


def test_a_class_short_by_one_gets_one(spark):
    assert C.plan_counts(blobs(spark, (5, 4)), "label").need == {"a": 0, "b": 1}


@pytest.mark.parametrize("fn", [G.random_oversample, G.smote, G.centroid_sample])
def test_auto_balances(table, fn):
    out = fn(table, SPEC)
    assert counts(out) == {"a": 90, "b": 90, "c": 90}
    assert out.where("not is_synthetic").drop("is_synthetic").exceptAll(table).count() == 0
    assert out.where("is_synthetic").where("id is not null").count() == 0


def test_create_new_has_no_real_rows(table):
    for fn in (G.smote, G.random_oversample, H.gaussian_copula):
        out = fn(table, SPEC, "create-new")
        assert counts(out) == counts(table) and out.where("not is_synthetic").count() == 0


def test_smote_stays_between_rows_of_the_class(table):
    made = G.smote(table, SPEC).where("is_synthetic").collect()
    rows = {c: np.array([[r["x"], r["y"]] for r in table.where(F.col("label") == c).collect()]) for c in "bc"}
    for r in made[:60]:
        p, own = np.array([r["x"], r["y"]]), rows[r["label"]]
        a, b = own[:, None, :], own[None, :, :]
        ab = b - a
        length = (ab ** 2).sum(2)
        t = np.where(length > 0, ((p - a) * ab).sum(2) / np.where(length > 0, length, 1), 0).clip(0, 1)
        assert (((a + t[:, :, None] * ab) - p) ** 2).sum(2).min() < 1e-18


def test_centroid_rows_lie_beyond_their_row(table):
    made = G.centroid_sample(table, SPEC, {"c": 24}).where("is_synthetic").collect()
    rows = np.array([[r["x"], r["y"]] for r in table.where("label = 'c'").orderBy("id").collect()])
    centre = rows.mean(0)
    for p in made:
        v = np.array([p["x"], p["y"]]) - centre
        ratio = v / (rows - centre)
        hit = np.abs(ratio[:, 0] - ratio[:, 1]) < 1e-9
        assert hit.any() and 1 <= ratio[hit][0, 0] <= 2
    inner = G.centroid_sample(table, SPEC, {"c": 24}, toward=True).where("is_synthetic")
    assert inner.count() == 12


def test_borderline_and_svm_start_from_few_rows(table):
    for fn in (G.borderline_smote, G.svm_smote):
        out = counts(fn(table, SPEC))
        assert out["a"] == 90 and out["b"] in (30, 90) and out["c"] in (12, 90)


def test_adasyn_is_close_to_the_plan(table):
    out = counts(G.adasyn(table, SPEC))
    assert abs(out["b"] - 90) <= 15 and abs(out["c"] - 90) <= 6


def test_kmeans_smote(table):
    out = counts(G.kmeans_smote(table, SPEC, clusters=3, threshold=0.05, k=3))
    assert out["a"] == 90 and out["b"] >= 90 and out["c"] >= 90
    with pytest.raises(ValueError):
        G.kmeans_smote(table, SPEC, clusters=3, threshold=0.999)


def test_cluster_based(spark):
    rows = [(1, 0.0, 0.0, "a", 0), (2, 1.0, 0.0, "a", 0), (3, 2.0, 0.0, "a", 0), (4, 0.0, 1.0, "b", 0), (5, 1.0, 1.0, "b", 0),
            (6, 9.0, 9.0, "a", 1),                                   # a lone majority row: dropped
            (7, 5.0, 5.0, "b", 2), (8, 6.0, 6.0, "a", 2),             # one row each: passed through
            (9, 7.0, 7.0, "b", -1), (10, 7.5, 7.0, "b", -1), (11, 7.0, 7.5, "b", -1), (12, 8.0, 8.0, "a", -1)]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE, label STRING, cluster INT")
    plan = {(r["cluster"], r["label"]): (r["included"], r["dropped"], r["need"]) for r in G.cluster_plan(df, "cluster", "label").collect()}
    assert plan[(0, "a")] == (True, False, 0) and plan[(0, "b")] == (True, False, 1)
    assert plan[(1, "a")][1] and plan[(-1, "a")] == (False, False, 0)
    for inner in ("cs", "smote"):
        out = G.cluster_based_resample(df, SPEC, "cluster", inner)
        assert out.where("id = 6").count() == 0 and out.where("not is_synthetic").count() == 11
        assert [(r["cluster"], r["label"]) for r in out.where("is_synthetic").collect()] == [(0, "b")]


def test_encoded_wrapper_gives_known_categories(spark, sf):
    t = X.toxic_docs(spark, sf)
    out = G.resample_encoded(G.smote)(t, X.TOXIC)
    known = {r["lang"] for r in t.select("lang").distinct().collect()}
    assert {r["lang"] for r in out.select("lang").distinct().collect()} <= known and dict(out.dtypes)["n_chars"] == "bigint"
    with pytest.raises(ValueError):
        G.smote(t, X.TOXIC)


def test_single_row_class_raises(spark):
    with pytest.raises(ValueError):
        G.smote(blobs(spark, (10, 1)), SPEC)


def test_same_rows_for_any_number_of_partitions(spark, table):
    seen = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            out = G.smote(table.repartition(n), SPEC).where("is_synthetic")
            seen.append(sorted((r["label"], r["x"], r["y"]) for r in out.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] == seen[2]


def test_registry():
    G.register_resampler("mine", G.random_oversample)
    assert "mine" in sampler_suite()
    with pytest.raises(TypeError):
        G.register_resampler("bad", object())
    del G.RESAMPLERS["mine"]


def test_cluster_resampler(table):
    out = cluster_resampler(table, SPEC, factor=2.0)
    assert out.where("is_synthetic").count() > 0 and "cluster" not in out.columns


@pytest.mark.parametrize("fn", [H.gaussian_copula, H.subspace_resample, H.clustered_resample])
def test_synthesizers_balance(table, fn):
    options = {"max_clusters": 4} if fn is H.clustered_resample else {"max_components": 2, "rounds": 8} if fn is H.subspace_resample else {}
    out = fn(table, SPEC, **options)
    assert counts(out) == {"a": 90, "b": 90, "c": 90}
    means = {r["label"]: r["m"] for r in out.where("is_synthetic").groupBy("label").agg(F.avg("x").alias("m")).collect()}
    assert abs(means["b"] - 1.5) < 0.8 and abs(means["c"] - 3.0) < 1.2


def test_balance_clusters(table):
    out = H.clustered_resample(table, SPEC, "balance-clusters", max_clusters=4)
    assert out.where("not is_synthetic").count() == 132


def test_copula_keeps_dependence(spark):
    t = spark.range(3000).select("id", F.expr("id % 2").cast("string").alias("label"), ((F.col("id") * 7919) % 1000 / 100).alias("x"))
    t = t.withColumn("y", F.col("x") * 2 + (F.col("id") % 10) / 10)
    out = H.gaussian_copula(t, SPEC, "create-new")
    assert out.stat.corr("x", "y") > 0.9


def test_accept_matching_gives_up(table):
    from ballast.functions.draws import uniform
    gen = lambda slots: slots.withColumn("ok", uniform("g", "label", "copy", "attempt") < F.when(F.col("label") == "a", 0.5).otherwise(0.0))
    out = H.accept_matching(table, {"a": 20, "b": 3}, "label", gen, F.col("ok"), max_tries=4)
    assert counts(out) == {"a": 20}


@pytest.mark.parametrize("estimator, inner", [("hac", "cs"), ("hac", "smote"), ("dbscan", "cs"), ("dbscan", "smote")])
def test_cluster_resampler_follows_the_strategy(table, estimator, inner):
    made = lambda s: {r["label"]: r["count"] for r in cluster_resampler(table, SPEC, s, factor=0.5, estimator=estimator, inner=inner)
                      .where("is_synthetic").groupBy("label").count().collect()}
    have = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    assert made("create-new") == have
    assert made({"c": have["c"] + 7}) == {"c": 7}


@pytest.mark.parametrize("many", [500, 5000])
def test_copula_of_many_categories(spark, many):
    rows = [(i, float(i % 97), f"v{i % many}", "ab"[i % 3 == 0]) for i in range(2 * many)]
    t = spark.createDataFrame(rows, "id INT, x DOUBLE, k STRING, y STRING")
    spec = TableSpec(features=("x", "k"), label="y", row_id=("id",), categorical=("k",))
    out = H.gaussian_copula(t, spec, "create-new").where("is_synthetic")
    assert out.count() == 2 * many and out.join(t, "k", "left_anti").count() == 0


def test_classes_of_one_row_get_their_rows(spark):
    rows = [(i, float(i), "a" if i < 30 else "b" if i < 40 else "c") for i in range(41)]
    t = spark.createDataFrame(rows, "id INT, x DOUBLE, y STRING")
    out = H.subspace_resample(t, TableSpec(features=("x",), label="y", row_id=("id",)), max_components=2, rounds=5)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 30, "b": 30, "c": 30}
    assert all(abs(r["x"] - 40) < 1e-6 for r in out.where("y = 'c' AND is_synthetic").collect())


def test_conditions_of_many_categories_follow_their_shares(spark):
    probs = spark.createDataFrame([("k", f"v{i:04d}", 1, 0.5 if i == 7 else 0.5 / 2999) for i in range(3000)], "column STRING, value STRING, n INT, p DOUBLE")
    got = H.draw_conditions(spark, 4000, probs, ["k"]).groupBy("value").count().collect()
    seen = {r["value"]: r["count"] for r in got}
    assert sum(seen.values()) == 4000 and 1850 < seen["v0007"] < 2150 and len(seen) > 1000


def broadcast_copies(df):
    """Whether a broadcast of the plan as it ran holds the copies that ``expand`` makes."""
    deep, found = None, False
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if "Initial Plan" in line:
            break
        at = len(line) - len(line.lstrip(" :+-*"))
        deep = None if deep is not None and at <= deep else deep
        deep = at if deep is None and "BroadcastExchange" in line else deep
        found |= deep is not None and "Generate explode(sequence" in line
    return found


def test_copies_are_not_broadcast(spark):
    """Chunks of copies look tiny, so that adaptive execution gathered all copies on the driver to broadcast them."""
    need = spark.createDataFrame([("a", 300_000)], "label STRING, need BIGINT")
    rows = spark.range(1, 400_001).selectExpr("'a' AS label", "id AS copy", "uuid() AS v").repartition(8)
    out = expand(need, "need").join(rows, ["label", "copy"]).where("length(v) > 1").groupBy("label").count()
    assert [tuple(r) for r in out.collect()] == [("a", 300_000)]
    assert not broadcast_copies(out)


@pytest.mark.parametrize("fn", [G.random_oversample, G.smote])
def test_resampling_broadcasts_no_copies(spark, fn):
    t = spark.range(0, 6000).selectExpr("id", "CAST(id % 977 AS DOUBLE) AS x", "CAST(id % 641 AS DOUBLE) AS y", "CAST(id >= 4000 AS INT) AS label")
    out = fn(t, SPEC, {1: 102_000}).where("is_synthetic").groupBy("label").agg(F.count(F.lit(1)), F.sum("x"))
    assert [tuple(r)[:2] for r in out.collect()] == [(1, 100_000)]
    assert not broadcast_copies(out)


def test_accept_matching_broadcasts_no_copies(spark):
    rows, seen = spark.range(1, 400_001).selectExpr("id AS copy", "uuid() AS v").repartition(8), []

    def generate(slots):
        drawn = slots.join(rows, "copy")
        size = drawn.agg(F.count("v"))
        size.collect()
        seen.append(broadcast_copies(size))
        return drawn.limit(5)

    table = spark.createDataFrame([("a",)], "label STRING")
    assert H.accept_matching(table, {"a": 200_000}, "label", generate, F.lit(True), max_tries=1).count() == 5
    assert seen == [False]
