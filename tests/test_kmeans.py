"""Array sums, all numbers of clusters at once and mixtures, against plain numpy."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.functions import sums as S
from ballast.operators import cluster as E
from ballast.operators import kmeans as K


def frame(spark, x, **columns):
    names = list(columns)
    rows = [([float(v) for v in row], *[columns[c][i] for c in names]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "features ARRAY<DOUBLE>" + "".join(f", {c} STRING" for c in names))


def mixed(seed=3, n=200):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, s, (n, 2)) for c, s in (((0, 0), 0.5), ((6, 1), 1.0), ((1, 7), 0.3))])


@pytest.mark.parametrize("parts", [1, 8, 9, 150])
def test_arrays_of_many_tasks_are_added(spark, parts):
    def fold(batches):
        total = np.zeros(20_000)  # three blocks
        for b in batches:
            for v in b.column("id").to_pylist():
                total[v] += v
                total[-1] += 1
        return {7: total}

    found = S.array_sums(spark.range(0, 10_000, 1, parts), fold)
    assert list(found) == [7] and found[7][-1] == 10_000
    assert (found[7][:10_000] == np.arange(10_000)).all() and not found[7][10_000:-1].any()


def lloyd(x, c, rounds=20, tol=1e-4):
    for turn in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        within = sum(((x[own == j] - new[j]) ** 2).sum() for j in range(len(c)))
        if ((new - c) ** 2).sum(1).max() <= tol * tol or turn == rounds - 1:
            return c, within, own
        c = new


def test_every_k_equals_lloyds_rounds_alone(spark):
    x = mixed()
    points = K.weighted_points(frame(spark, x).repartition(5), "features")
    seeds = K.seeds_of(points, 9)["all"]
    assert seeds.n == len(x) and np.allclose(seeds.mean, x.mean(0)) and np.allclose(seeds.var, x.var(0))
    assert seeds.weights.sum() == len(x) and len(seeds.points) == 1 + 5 * 18
    fitted = K.fit_all(points, seeds, range(2, 10))
    for k, (c, within) in fitted.items():
        alone, least, _ = lloyd(x, seeds.centres(k, 42))
        assert np.allclose(c, alone) and within == pytest.approx(least)


def test_scores_of_every_k_follow_from_the_labels(spark):
    x = mixed(5) + 1e6  # far from zero
    found = E.choose_k_kmeans(frame(spark, x), max_clusters=8)
    assert found.k == 3
    total = ((x - x.mean(0)) ** 2).sum()
    for k, c in found.detail["centres"].items():
        own = np.array([r[0] for r in frame(spark, x).select(K.nearest("features", c)).collect()])
        within = sum(((x[own == j] - x[own == j].mean(0)) ** 2).sum() for j in set(own))
        assert found.scores[k] == pytest.approx(within / total + 0.02 * k, rel=1e-6)


def test_a_vector_held_by_a_third_of_the_rows(spark):
    x = np.vstack([mixed(n=100), np.repeat([[6.0, 1.0]], 150, 0)])
    points = K.weighted_points(frame(spark, x), "features")
    assert points.count() == 301 and points.agg(F.max("w")).first()[0] == 150
    found = E.choose_k_kmeans(frame(spark, x), max_clusters=6)
    assert found.k == 3 and found.labelled.count() == 450


def test_fewer_points_than_clusters(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 2.0]], 20, 0)
    found = E.choose_k_kmeans(frame(spark, x), max_clusters=6)
    assert found.k == 2 and found.scores[2] == pytest.approx(0.04)
    assert found.labelled.groupBy("cluster").count().count() == 2
    one = E.choose_k_kmeans(frame(spark, np.zeros((5, 2))), max_clusters=4)
    assert one.k == 2 and one.labelled.select("cluster").distinct().count() == 1


def test_the_fit_does_not_depend_on_partitions(spark):
    x = mixed(9)
    a, b = (E.choose_k_kmeans(frame(spark, x).repartition(p), max_clusters=6) for p in (2, 40))
    assert a.k == b.k and all(a.scores[k] == pytest.approx(b.scores[k], rel=1e-9) for k in a.scores)


def em(x, mean, kind, rounds, ridge=1e-6, tol=1e-3):
    """Plain EM with loops over components; BIC of the likelihood of the last round."""
    n, d = x.shape
    k = len(mean)
    var = x.var(0) + ridge
    cov = [np.diag(var) if kind != "spherical" else np.eye(d) * var.mean() for _ in range(k)]
    weight, last = np.full(k, 1 / k), -math.inf
    for _ in range(rounds):
        dens = np.array([weight[j] * np.exp(-0.5 * np.einsum("bi,ij,bj->b", x - mean[j], np.linalg.inv(cov[j]), x - mean[j]))
                         / math.sqrt((2 * math.pi) ** d * np.linalg.det(cov[j])) for j in range(k)]).T
        loglik = np.log(dens.sum(1)).sum()
        p = dens / dens.sum(1, keepdims=True)
        size = p.sum(0)
        mean = (p.T @ x) / size[:, None]
        cov = [((x - mean[j]).T * p[:, j]) @ (x - mean[j]) / size[j] for j in range(k)]
        if kind == "tied":
            cov = [sum(size[j] * cov[j] for j in range(k)) / n] * k
        if kind == "diag":
            cov = [np.diag(np.diag(c)) for c in cov]
        if kind == "spherical":
            cov = [np.eye(d) * np.diag(c).mean() for c in cov]
        cov, weight = [c + ridge * np.eye(d) for c in cov], size / n
        if abs(loglik - last) / n < tol:
            break
        last = loglik
    shape = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[kind]
    return -2 * loglik + (k * d + k - 1 + shape) * math.log(n)


def test_bic_of_every_mixture_equals_plain_em(spark):
    x = np.round(mixed(n=100), 1)  # rounding makes equal vectors
    y = np.vstack([x, mixed(8, 50) * 3 + 100])
    g = ["p"] * 300 + ["q"] * 150
    df = frame(spark, y, g=g).repartition(6)
    seeds = K.seeds_of(K.weighted_points(df, "features", "g"), 4)
    found = E.fit_mixtures(df, "features", range(1, 5), group="g", rounds=25)
    for name, rows in (("p", y[:300]), ("q", y[300:])):
        assert {(m.kind, m.k) for m in found[name]} == {(kind, k) for kind in E.COVARIANCES for k in range(1, 5)}
        for m in found[name]:
            assert m.bic == pytest.approx(em(rows, seeds[name].centres(m.k, 42), m.kind, 25), rel=1e-6), (name, m.kind, m.k)


def test_leaves_hold_every_point_once_and_few_are_dealt_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random(5000), rng.integers(0, 9, 5000) / 8])
    points = K.weighted_points(frame(spark, x).repartition(3), "features")
    rows = K.packed(points).toArrow().to_batches()
    held = np.concatenate([v[w > 0] for _, v, w, _ in K.leaves(rows)])
    assert sorted(map(tuple, held)) == sorted(map(tuple, np.unique(x, axis=0)))
    seen = []
    monkeypatch.setattr(K, "array_sums", lambda data, fold: fold(rows))
    monkeypatch.setattr(K.np, "isfinite", lambda v, real=np.isfinite: seen.append(real(v)) or seen[-1])
    c = np.array([[0.2, 0.3], [0.8, 0.7]])
    seeds = type("Given", (), {"centres": lambda self, k, seed: c})()
    (found, within), = K.fit_all(points, seeds, [2], rounds=1, packs=points).values()
    assert seen and (found == c).all() and within == pytest.approx(lloyd(x, c, rounds=1)[1])


def test_draws_of_leaves_are_those_of_the_rows(spark):
    from ballast.functions.draws import uniform

    h = [0, 1, -5, 1 << 62, -(1 << 63)]
    rows = spark.createDataFrame([(v,) for v in h], "h BIGINT").select(uniform("kmeans.3", F.lit("all"), "h", seed=7)).collect()
    assert K._draws("kmeans.3", "all", np.array([h]), 7).tolist() == [[r[0] for r in rows]]


def test_labels_of_every_fit_are_those_of_each(spark):
    x = mixed(6, 20)
    fits = [x[:2], x[50:57]]
    rows = frame(spark, x).select(K.nearest_of_each("features", fits).alias("e"), *[K.nearest("features", c).alias(f"l{i}") for i, c in enumerate(fits)]).collect()
    assert len(rows) == 60 and all(r["e"] == [r["l0"], r["l1"]] for r in rows)


def test_leaves_of_all_tasks_together_tile_the_space(spark):
    """A leaf is the smaller the more points there are, however many tasks hold them, so that few lie across a border (F3)."""
    x = np.random.default_rng(3).random((8000, 1))
    points = K.weighted_points(frame(spark, x).repartition(8), "features")
    rows = K.packed(points).toArrow().to_batches()
    assert sum(np.ptp(v[:, :, 0], axis=1).sum() for _, v, _, _ in K.leaves(rows)) < 2.0
    held = [(v, w, K._numbers(b.column("s"))) for b in rows for _, v, w, _ in K.leaves([b])]
    for v, w, s in held:
        total, inner, mean, box, half = s.T
        assert (total == w.sum(1)).all() and mean == pytest.approx((v[:, :, 0] * w).sum(1) / total)
        assert inner == pytest.approx((w * (v[:, :, 0] - mean[:, None]) ** 2).sum(1), abs=1e-12) and (abs(v[:, :, 0] - box[:, None]) <= half[:, None] + 1e-12).all()
