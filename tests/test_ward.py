"""Ward's tree against merging the cheapest pair first."""
import math

import numpy as np
import pytest

from ballast.operators import cluster as E
from ballast.operators import ward as W


def greedy(x, n):
    """Merges (smaller first point, the other, cost) of the cheapest pair, one after the other."""
    n, c = n.astype(float).copy(), x.astype(float).copy()
    cost = 2.0 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * ((c[:, None, :] - c[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    merges = []
    for _ in range(len(n) - 1):
        a, b = sorted(divmod(int(cost.argmin()), len(n)))
        merges.append((a, b, cost[a, b]))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        cost[b, :] = cost[:, b] = np.inf
        row = 2.0 * n[a] * n / (n[a] + n) * ((c - c[a]) ** 2).sum(1)
        row[~np.isfinite(cost[a])] = np.inf
        cost[a, :] = cost[:, a] = row
    return merges


def labels(count, merges):
    own = np.arange(count)
    for a, b, _ in merges:
        own[own == b] = a
    return np.unique(own, return_inverse=True)[1]


def table(spark, x, copies):
    rows = [(i * 10 + j, [float(v) for v in p]) for i, (p, k) in enumerate(zip(x, copies)) for j in range(k)]
    return spark.createDataFrame(rows, "id BIGINT, features ARRAY<DOUBLE>").repartition(5)


def some_points(seed, count, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims)) * 6
    x = np.r_[centres[rng.integers(0, 7, count - 20)] + rng.normal(size=(count - 20, dims)), rng.normal(size=(20, dims)) * 25]
    x = x[np.lexsort(x.T[::-1])]
    return x, rng.integers(1, 4, count)


def got_labels(df):
    rows = sorted((r["id"] // 10, r["cluster"]) for r in df.select("id", "cluster").distinct().collect())
    assert len({i for i, _ in rows}) == len(set(rows))
    return np.array([c for _, c in sorted(set(rows))])


def test_rounds_build_the_tree_of_the_cheapest_pair_first(spark, monkeypatch):
    monkeypatch.setattr(W, "CELL", 150)
    monkeypatch.setattr(W, "LAST", 200)
    x, copies = some_points(1, 1200, 2)
    want = greedy(x, copies)
    df = table(spark, x, copies)
    points = W.distinct_points(df, "features")
    place = {tuple(p): i for i, p in enumerate(x)}
    names = {r["id"]: place[tuple(r["vec"])] for r in points.collect()}
    edges = {(names[r["into"]], names[r["node"]]): r["cost"] for r in W.merge_rounds(points).collect()}
    assert edges == pytest.approx({(a, b): c for a, b, c in want})
    cut = [m for m in want if math.sqrt(m[2]) < 0.6]
    assert (got_labels(E.ward(df, "features", 0.6)) == labels(len(x), cut)).all()


def test_labels_and_scores_at_two_thousand_points(spark):
    count = 2000
    x, copies = some_points(4, count, 3)
    want = greedy(x, copies)
    df = table(spark, x, copies)
    assert [tuple(r["vec"]) for r in W.distinct_points(df, "features").orderBy("id").collect()] == [tuple(p) for p in x]
    assert (got_labels(E.hierarchical(df, k=17).labelled) == labels(count, want[:count - 17])).all()
    for threshold in (0.4, 40.0):
        cut = [m for m in want if math.sqrt(m[2]) < threshold]
        assert (got_labels(E.ward(df, "features", threshold)) == labels(count, cut)).all()
    mean = (copies[:, None] * x).sum(0) / copies.sum()
    total = (copies * ((x - mean) ** 2).sum(1)).sum()
    scores = E.hierarchical(df, max_clusters=20).scores
    assert sorted(scores) == list(range(2, 20))
    for k in (2, 9, 19):
        own = labels(count, want[:count - k])
        within = sum((copies[own == j] * ((x[own == j] - np.average(x[own == j], axis=0, weights=copies[own == j])) ** 2).sum(1)).sum() for j in range(k))
        assert scores[k] == pytest.approx(within / total + 0.02 * k, abs=1e-9)


def test_points_that_share_values_merge_within_boxes(spark, monkeypatch):
    """Points on a few lines: no wall lies on a line, so one round within boxes merges most of them, into the same tree."""
    monkeypatch.setattr(W, "CELL", 40)
    monkeypatch.setattr(W, "LAST", 100)
    rng = np.random.default_rng(6)
    x = np.array([[i % 6, i // 6 % 5, v] for i, v in enumerate(rng.random(900))]) * [1.0, 1.0, 3.0]
    x = x[np.lexsort(x.T[::-1])]
    points = W.distinct_points(table(spark, x, [1] * 900), "features")
    order = {i: k for k, i in enumerate(sorted(r["id"] for r in points.collect()))}
    edges = W.merge_rounds(points).collect()
    assert {(order[r["into"]], order[r["node"]]): r["cost"] for r in edges} == pytest.approx({(a, b): c for a, b, c in greedy(x, np.ones(900))})
    assert sum(r["turn"] == 0 for r in edges) > 450


def test_only_across_boxes(spark, monkeypatch):
    """With walls that stop every pair, rounds of nearest neighbours across boxes alone build the same tree."""
    monkeypatch.setattr(W, "CELL", 50)
    monkeypatch.setattr(W, "LAST", 60)
    monkeypatch.setattr(W, "_in_boxes", lambda clusters, *rest: clusters.selectExpr("id", "n", "vec", "top", "cast(null as bigint) as into", "0 as step"))
    x, copies = some_points(9, 200, 3)
    points = W.distinct_points(table(spark, x, copies), "features")
    order = {i: k for k, i in enumerate(sorted(r["id"] for r in points.collect()))}
    edges = {(order[r["into"]], order[r["node"]]): r["cost"] for r in W.merge_rounds(points).collect()}
    assert edges == pytest.approx({(a, b): c for a, b, c in greedy(x, copies)})


def test_by_hand(spark):
    df = table(spark, np.array([[0.0], [1.0], [5.0]]), [1, 1, 1])
    heights = sorted(math.sqrt(r["cost"]) for r in W.merge_rounds(W.distinct_points(df, "features")).collect())
    # the pair at distance 1, then {0, 1} with 5: sqrt(2 * 2 * 1 / 3) * 4.5
    assert heights == pytest.approx([1.0, math.sqrt(4 / 3) * 4.5])
    assert got_labels(E.hierarchical(df, k=3).labelled).tolist() == [0, 1, 2] and got_labels(E.ward(df, "features", 2.0)).tolist() == [0, 0, 1]


def test_one_point_and_equal_points(spark):
    one = table(spark, np.array([[1.0, 2.0]]), [3])
    assert E.hierarchical(one).k == 1 and got_labels(E.ward(one, "features", 1.0)).tolist() == [0]
    grid = table(spark, np.array([[float(i), float(j)] for i in range(6) for j in range(6)]), [1] * 36)  # ties everywhere
    assert E.hierarchical(grid, k=4).labelled.groupBy("cluster").count().count() == 4
    assert E.ward(grid, "features", 1.0).select("cluster").distinct().count() == 36


def test_a_box_is_merged_in_halves_of_halves(spark, monkeypatch):
    """One round within boxes of many points takes in most of them, though no step compares more than a few; ``last`` is where a turn's edges lead (F1)."""
    monkeypatch.setattr(W, "LAST", 90)
    monkeypatch.setattr(W, "LEAF", 8)
    monkeypatch.setattr(W, "DENSE", 120)
    most = []
    real = W._merge_blocks
    monkeypatch.setattr(W, "_merge_blocks", lambda places, *rest: most.append(max(map(len, places))) or real(places, *rest))
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 3, 1100) * 4.0, rng.random(1100)])
    x = x[np.lexsort(x.T[::-1])]
    ids = np.arange(1100)
    left, edges = W._merge_in_box(ids.copy(), np.ones(1100), x.copy(), np.zeros(1100), np.full(2, -np.inf), np.full(2, np.inf), 1.0, math.inf)
    assert len(left[0]) < 60 and max(most) <= 120
    want = {(a, b): c for a, b, c in greedy(x, np.ones(1100))}
    assert all(want[int(a), int(b)] == pytest.approx(c) for node, into, height, _ in edges for a, b, c in zip(into, node, height))
    monkeypatch.undo()
    monkeypatch.setattr(W, "LAST", 90)
    points = W.distinct_points(table(spark, x, [1] * 1100), "features")
    order = {i: k for k, i in enumerate(sorted(r["id"] for r in points.collect()))}
    edges = W.merge_rounds(points).collect()
    assert {(order[r["into"]], order[r["node"]]): r["cost"] for r in edges} == pytest.approx(want)
    for turn in {r["turn"] for r in edges}:
        own = {r["node"]: r for r in edges if r["turn"] == turn}
        for node, r in own.items():
            while node in own:
                node = own[node]["into"]
            assert node == r["last"]


def test_labels_are_joined_as_they_are_read(spark, monkeypatch):
    """Rows are not written again with their labels, as a caller may want their numbers alone (F1)."""
    seen = []
    real = E.written
    monkeypatch.setattr(E, "written", lambda df, name="stage": seen.append(df.columns) or real(df, name))
    df = table(spark, np.array([[0.0], [1.0], [5.0], [7.0]]), [1, 2, 1, 1])
    assert sorted(map(tuple, E.hierarchical(df, k=2).labelled.groupBy("cluster").count().collect())) == [(0, 3), (1, 2)]
    assert sorted(map(tuple, E.ward(df, "features", 2.9).groupBy("cluster").count().collect())) == [(0, 3), (1, 2)]
    assert seen and not any("id" in c for c in seen)
