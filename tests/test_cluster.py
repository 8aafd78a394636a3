"""Clustering on data with a known answer."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import cluster as E
from ballast.spec import TableSpec


def clouds(spark, centres=((0, 0), (10, 0), (0, 10)), n=60, seed=0, spread=0.5):
    rng = np.random.default_rng(seed)
    rows = [(i * n + j, [float(v) for v in rng.normal(c, spread)], i) for i, c in enumerate(centres) for j in range(n)]
    return spark.createDataFrame(rows, "id BIGINT, features ARRAY<DOUBLE>, truth INT")


def agrees(df):
    pairs = df.select("truth", "cluster").distinct().collect()
    return len(pairs) == len({p["truth"] for p in pairs}) == len({p["cluster"] for p in pairs})


@pytest.fixture(scope="module")
def data(spark):
    return clouds(spark).cache()


def test_kmeans_finds_three(data):
    c = E.choose_k_kmeans(data, max_clusters=6)
    assert c.k == 3 and agrees(c.labelled)


def test_mixture_finds_three(data):
    c = E.choose_k_mixture(data, max_clusters=5, rounds=15)
    assert c.k == 3 and agrees(c.labelled)


def test_bic_by_hand(spark):
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    df = spark.createDataFrame([([float(v[0])],) for v in x], "features ARRAY<DOUBLE>")
    m = E.fit_mixtures(df, "features", [1], ["full"], rounds=5, ridge=0.0)["all"][0]
    var = x.var()
    loglik = float((-0.5 * (x - 1.5) ** 2 / var - 0.5 * math.log(2 * math.pi * var)).sum())
    assert m.bic == pytest.approx(-2 * loglik + 2 * math.log(4))


def test_hierarchical_and_ward(data):
    c = E.hierarchical(data, max_clusters=6)
    assert c.k == 3 and agrees(c.labelled)
    assert agrees(E.ward(data, "features", 20.0))
    assert E.ward(data, "features", 0.0).select("cluster").distinct().count() == 180


def test_class_subspaces(data):
    rows, model = E.class_subspaces(data.withColumn("label", F.when(F.col("truth") < 2, "p").otherwise("q")), "features", "label", 3, rounds=15)
    table = {(r["label"], r["cluster"]): r["p"] for r in model.collect()}
    assert table == {("p", 0): 0.5, ("p", 1): 0.5, ("q", 2): 1.0}
    assert rows.where("cluster is null").count() == 0


def test_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), "big") for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    rows += [(300, 25.0, 25.0, "big"), (301, 40.0, -40.0, "small")]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE, label STRING")
    kept = E.drop_majority_outliers(df, TableSpec(features=("x", "y"), label="label", row_id=("id",)), limit=0.6)
    ids = {r["id"] for r in kept.collect()}
    assert 300 not in ids and 301 in ids and len(ids) > 270


def test_profile_and_padding(data):
    c = data.withColumn("x", F.col("features")[0])
    rows = E.cluster_profile(c, "truth", ["x"]).collect()
    assert [r["n"] for r in rows] == [60, 60, 60] and all(r["min_x"] < r["max_x"] for r in rows)
    assert E.pad_to_multiple(data, "id", 64).count() == 192 and E.pad_to_multiple(data, "id", 60).count() == 180
    p = E.p_cluster_given_class(data.withColumn("u", F.col("id") % 2), "u", "truth").groupBy("truth").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in p)


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from ballast.operators import density

    n, steps, write = 400, [], density.written
    names = np.random.default_rng(3).permutation(n).tolist()
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1)] + [(900, 901), (905, 905), (None, 5)], "a BIGINT, b BIGINT").coalesce(1)
    monkeypatch.setattr(density, "written", lambda df, name: steps.append(name) or (write(df.coalesce(1), name) if len(steps) < 45 else pytest.fail("too many steps")))
    found = {r["node"]: r["component"] for r in density.components(edges).collect()}
    assert found == {i: 0 for i in range(n)} | {900: 900, 901: 900, 905: 905}


def test_rows_that_go_down_a_tree_together_end_where_each_would():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (300, 2)).astype(float)
    x[7, 1] = np.nan
    tree = E._grow(np.nan_to_num(x), rng, 8)
    feature, cut, child, leaf, steps = E._stepped(tree)
    node = np.zeros(len(x), np.int64)
    for _ in range(steps):
        node = child[2 * node + (x[np.arange(len(x)), feature[node]] <= cut[node])]
    for row, at in zip(x, node):
        me = 0
        while tree[me][0] >= 0:
            me = tree[me][2] if row[tree[me][0]] <= tree[me][1] else tree[me][3]
        assert me == at and leaf[at] == tree[me][5] + E._path(tree[me][4])
