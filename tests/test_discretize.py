"""Discretizers against small independent implementations."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import discretize as D
from ballast.plans import fixtures as X


def table(spark, n=120, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, n).astype(float)
    y = [(int(v) // 14 + int(rng.integers(0, 2))) % classes for v in x]
    return x, np.array(y), spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id INT, x DOUBLE, y INT")


def chi(a, b):
    both, sa, sb = a + b, a.sum(), b.sum()
    ea, eb = both * sa / (sa + sb), both * sb / (sa + sb)
    ok = both > 0
    return (((a - ea) ** 2)[ok] / ea[ok] + ((b - eb) ** 2)[ok] / eb[ok]).sum()


def chi_merge_brute(x, y, k):
    values = np.unique(x)
    classes = np.unique(y)
    parts = [[v, np.array([((x == v) & (y == c)).sum() for c in classes], float)] for v in values]
    while len(parts) > k:
        scores = [chi(a[1], b[1]) for a, b in zip(parts, parts[1:])]
        i = int(np.argmin(scores))
        parts[i:i + 2] = [[parts[i][0], parts[i][1] + parts[i + 1][1]]]
    return [p[0] for p in parts][1:]


@pytest.mark.parametrize("k", [2, 4, 7])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_chi_merge(spark, k, seed):
    x, y, df = table(spark, seed=seed)
    assert D.chi_merge_cuts(df, ["x"], "y", {"x": k})["x"] == chi_merge_brute(x, y, k)


def test_chi_merge_starts_from_equal_blocks_on_demand(spark):
    x, y, df = table(spark)
    cuts = D.chi_merge_cuts(df, ["x"], "y", {"x": 4}, start_intervals=10)["x"]
    assert len(cuts) == 3 and cuts == sorted(cuts) and set(cuts) <= set(x)


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("classes", [2, 3])
def test_chi_merge_of_long_runs_is_exact(spark, k, classes):
    x = np.arange(60).astype(float)
    y = np.minimum((x // 20).astype(int), classes - 1)
    y[30:33] = 0
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x DOUBLE, y INT")
    assert D.chi_merge_cuts(df, ["x"], "y", {"x": k})["x"] == chi_merge_brute(x, y, k)


def test_chi_merge_refuses_too_many_runs(spark):
    _, _, df = table(spark)
    with pytest.raises(ValueError):
        D.chi_merge_cuts(df, ["x"], "y", {"x": 4}, max_runs=3)


def runs_of(kind, n, seed):
    """(x, y) with every row a value of its own."""
    rng = np.random.default_rng(seed)
    y = {"mixed": (rng.random(n) < 0.3 + 0.4 * (np.arange(n) * 4 // n % 2)).astype(int), "alternating": np.arange(n) % 2,
         "three": rng.integers(0, 3, n), "rare": (rng.random(n) < 0.05).astype(int)}[kind]
    return np.arange(n).astype(float), y


@pytest.mark.parametrize("kind, piece, k", [("mixed", 7, 5), ("alternating", 7, 5), ("three", 40, 2), ("rare", 20, 3)])
def test_chi_merge_in_pieces_keeps_the_order_of_one_heap(spark, monkeypatch, kind, piece, k):
    monkeypatch.setattr(D, "PIECE", piece)
    x, y = runs_of(kind, 400, 3)
    df = spark.createDataFrame([(float(a), float(a // 3), int(b)) for a, b in zip(x, y)], "x DOUBLE, z DOUBLE, y INT")
    got = D.chi_merge_cuts(df, ["x", "z"], "y", {"x": k, "z": k + 1})
    assert got["x"] == chi_merge_brute(x, y, k) and got["z"] == chi_merge_brute(x // 3, y, k + 1)


def test_chi_merge_of_many_runs_equals_one_heap(spark):
    x, y = runs_of("mixed", 720_000, 1)
    opens = np.r_[True, y[1:] != y[:-1]]
    run = np.cumsum(opens) - 1
    counts = np.stack([np.bincount(run, y == c) for c in (0, 1)], 1)
    assert len(counts) > 300_000
    kept = D.merge_intervals(counts, 6)[0]
    df = spark.range(len(x)).select(F.col("id").cast("double").alias("x")).join(
        spark.createDataFrame([(float(v),) for v in x[y == 1]], "x DOUBLE").withColumn("y", F.lit(1)), "x", "left").fillna(0, ["y"])
    assert D.chi_merge_cuts(df, ["x"], "y", {"x": 6}, max_runs=D.PIECE)["x"] == x[opens][kept][1:].tolist()


@pytest.mark.parametrize("classes", [2, 3, 9])
def test_pair_scores_agree_to_the_last_bit(classes):
    rng = np.random.default_rng(classes)
    a, b = rng.integers(0, 50, (500, classes)), rng.integers(0, 3, (500, classes))
    a[:, 0] += 1
    b[:, -1] += 1
    got = D.pair_scores(a, b)
    assert got.tolist() == [D._pair_score(x, y) for x, y in zip(a.astype(float).tolist(), b.astype(float).tolist())]
    assert got == pytest.approx([chi(x, y) for x, y in zip(a.astype(float), b.astype(float))])


def test_auto_weights_follow_the_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(100), *range(1000, 1300)]], "x DOUBLE")
    for strategy in ("bins-uni", "bins-q", "bins-bgm"):
        model = D.fit_discretizer(df, ["x"], strategy, 3, bin_weights="auto")
        assert len(model.weights["x"]) == model.bins("x") and abs(sum(model.weights["x"]) - 1) < 1e-9
    assert D.cut_weights([D.Mode(0.0, 1.0, 0.25), D.Mode(5.0, 1.0, 0.75)], [1.0, 2.0]) == [0.25, 0.0, 0.75]


def caim_brute(x, y):
    classes = np.unique(y)

    def score(cuts):
        code = np.searchsorted(sorted(cuts), x, side="right")
        return np.mean([max((y[code == b] == c).sum() for c in classes) ** 2 / (code == b).sum() for b in range(len(cuts) + 1)])

    cuts, best = [], -1.0
    for step in range(1, len(classes) + 1):
        tried = [(score([*cuts, v]), -v) for v in np.unique(x)[1:-1] if v not in cuts]
        top, neg = max(tried)
        if step < len(classes) or top > best:
            cuts, best = sorted([*cuts, -neg]), top
    return cuts


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("classes", [2, 3])
def test_caim(spark, seed, classes):
    x, y, df = table(spark, seed=seed, classes=classes)
    assert D.caim_cuts(df, ["x"], "y")["x"] == caim_brute(x, y)


def test_caim_score_by_hand(spark):
    # values 1..4, classes 0 0 1 1: the cut at 3 splits perfectly, mean(2^2/2, 2^2/2) = 2
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "x DOUBLE, y INT")
    t, k = D.caim_table(df, ["x"], "y")
    assert {r["cut"]: round(r["score"], 4) for r in D.caim_scores(t, {"x": []}, k).collect()} == {2.0: round((1 + 4 / 3) / 2, 4), 3.0: 2.0}


def test_quantiles_are_exact(spark):
    x, _, df = table(spark, n=97)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    assert D.exact_quantiles(df, ["x"], {"x": probs})["x"] == pytest.approx(list(np.quantile(x, probs)))


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 50 + [1, 2, 3]], "x DOUBLE")
    assert len(D.quantile_cuts(df, ["x"], {"x": 10})["x"]) < 9


def test_kmeans_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 50, 51, 52, 100, 101, 102]], "x DOUBLE")
    assert D.kmeans_cuts(df, ["x"], {"x": 3})["x"] == pytest.approx([26.0, 76.0])


@pytest.mark.parametrize("strategy", D.STRATEGIES)
def test_codes_rise_with_the_value(spark, sf, strategy):
    t = X.rare_lines(spark, sf)
    m = D.fit_discretizer(t, ["l_extendedprice"], strategy, 4, label="rare")
    r = m.transform(t.select("l_extendedprice", F.col("l_extendedprice").alias("x")))
    bins = r.groupBy("l_extendedprice").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("a").collect()
    assert all(p["b"] < q["a"] for p, q in zip(bins, bins[1:]))
    if strategy != "bins-bgm":
        assert [b["l_extendedprice"] for b in bins] == sorted(b["l_extendedprice"] for b in bins)


def test_many_cuts_use_the_same_bins(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), "id")
    cuts = [float(v) for v in range(1, 200, 2)]
    m = D.DiscretizerModel({"x": cuts})
    assert all(r["x"] == int(np.searchsorted(cuts, r["id"], side="right")) for r in m.transform(df).collect())


def test_errors(spark):
    df = spark.createDataFrame([(1.0,)], "x DOUBLE")
    with pytest.raises(ValueError):
        D.fit_discretizer(df, ["x"], "bins-z")
    with pytest.raises(ValueError):
        D.fit_discretizer(df, ["x"], "caim")


def test_an_outlier_does_not_hide_the_modes(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, 6000), rng.normal(20, 2, 3000), [500.0]]
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    found = D.mixture_1d(df, ["x"], 5)["x"]
    for mean, share in ((0, 6000 / 9001), (20, 3000 / 9001)):
        near = [m for m in found if abs(m.mean - mean) < 3]
        assert near and abs(sum(m.weight for m in near) - share) < 0.05
    assert len(D.kmeans_cuts(df.where("x < 100"), ["x"], {"x": 2})["x"]) == 1


def test_kmeans_settles_on_many_values(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.uniform(0, 1, 20_000), rng.uniform(3, 4, 20_000)]
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    cut, = D.kmeans_cuts(df, ["x"], {"x": 2})["x"]
    assert abs(cut - (x[x < cut].mean() + x[x >= cut].mean()) / 2) < 1e-9
