"""Neighbour search against brute force, with cells and blocks small enough to be many."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import density as D
from ballast.operators import neighbors as N


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 24)
    monkeypatch.setattr(D, "BLOCK", 24)


def points(spark, n=300, copies=90, dims=2, seed=3):
    """Random points; almost a third of the rows are one and the same point."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)) * 10)  # whole numbers: distances are exact
    x[n - copies:] = x[0]
    rows = [(i, [float(v) for v in x[i]], "abc"[i % 3], i % 2) for i in rng.permutation(n).tolist()]
    return x, spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, label STRING, part INT")


def brute(x, ids, k, self_too, allowed):
    out = {}
    for i in ids:
        d = ((x - x[i]) ** 2).sum(1)
        near = sorted((round(float(d[j]), 9), j) for j in ids if allowed(i, j) and (self_too or j != i))[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("dims", [1, 2, 5])
def test_knn(spark, small_blocks, include_self, dims):
    x, df = points(spark, dims=dims)
    got = {r["id"]: [e["id"] for e in r["neighbors"]]
           for r in N.knn(df, df, F.col("v"), "id", 4, carry=["label"], include_self=include_self).collect()}
    assert got == brute(x, range(len(x)), 4, include_self, lambda i, j: True)


def test_knn_within_groups(spark, small_blocks):
    x, df = points(spark)
    got = {r["id"]: [e["id"] for e in r["neighbors"]]
           for r in N.knn(df, df, F.col("v"), "id", 3, within=["part"], include_self=False, with_vector=True).collect()}
    assert got == brute(x, range(len(x)), 3, False, lambda i, j: i % 2 == j % 2)


def test_knn_small_and_missing_groups(spark, small_blocks):
    _, df = points(spark)
    left = df.withColumn("part", F.when(F.col("id") == 5, 99).otherwise(F.col("part")))
    got = {r["id"]: len(r["neighbors"]) for r in N.knn(left, df, F.col("v"), "id", 3, within=["part"]).collect()}
    assert got[5] == 0 and got[6] == 3 and len(got) == 300


def test_radius(spark, small_blocks):
    x, df = points(spark)
    got = {r["id"]: (r["neighbors"], r["same_class"]) for r in N.radius_counts(df, df, F.col("v"), "id", 3.0, "label").collect()}
    pairs = {(r["id"], r["neighbor"]) for r in N.radius_pairs(df, df, F.col("v"), "id", 3.0).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = d <= 9.0
    label = np.array(["abc"[i % 3] for i in range(len(x))])
    assert got == {i: (int(near[i].sum()), int((near[i] & (label == label[i])).sum())) for i in range(len(x))}
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(near))}


def test_point_types_by_hand(spark):
    # 1-D: 0 and 1 share a class; 10 sits among others; 100 is far from everything
    rows = [(1, 0.0, "a"), (2, 1.0, "a"), (3, 2.0, "a"), (4, 10.0, "a"), (5, 10.5, "b"), (6, 11.0, "b"), (7, 11.5, "b"),
            (8, 9.5, "b"), (9, 9.0, "b"), (10, 100.0, "a")]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, label STRING")
    v = N.vector(["x"])
    rad = {r["id"]: r["point_type"] for r in N.point_types(df, v, "label", "id", method="rad", radius=2.5).collect()}
    assert rad == {1: "Core", 2: "Core", 3: "Core", 4: "Outlier", 5: "Border", 6: "Border", 7: "Border", 8: "Border", 9: "Border", 10: "Isolated"}
    knn3 = {r["id"]: r["point_type"] for r in N.point_types(df, v, "label", "id", k=3).collect()}
    assert knn3[1] == "Core" and knn3[4] == "Border" and knn3[7] == "Core"
    assert {r["id"] for r in N.safe_border_filter(N.point_types(df, v, "label", "id", method="rad", radius=2.5)).collect()} == {1, 2, 3, 5, 6, 7, 8, 9}
    with pytest.raises(ValueError):
        N.point_types(df, v, "label", "id", method="cosine")


def dbscan_brute(x, eps, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= min_samples
    label, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = number
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.nonzero(d[j])[0]:
                    if label[m] < 0:
                        label[m] = number
                        stack.append(m)
        number += 1
    return label


@pytest.mark.parametrize("eps", [1.0, 2.0, 5.0])
def test_dbscan(spark, small_blocks, eps):
    x, df = points(spark, n=240, copies=60)
    got = {r["id"]: r["cluster"] for r in D.dbscan(df, F.col("v"), "id", eps, 4).collect()}
    assert [got[i] for i in range(len(x))] == list(dbscan_brute(x, eps, 4))


def test_median_pair_distance(spark, small_blocks):
    x, df = points(spark, n=151, copies=30)
    want = float(np.median(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))))
    assert abs(D.median_pair_distance(df, F.col("v"), "id", 2.0) - want / 2.0) < 1e-9


def test_cells_cover_the_ball():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 3)), 1)
    cells = N.place_cells(x, 16)
    home = cells.locate(x)
    radius = rng.uniform(0, 1, size=500)
    i, c = cells.within(x, radius)
    reached = set(zip(i.tolist(), c.tolist()))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for a, b in zip(*np.nonzero(d <= radius[:, None])):
        assert (a, home[b]) in reached
    assert len(reached) == len(i)


def test_walls_meet_no_shared_value():
    """Walls lie between values and part them as before; a value of most points, neighbouring floats and equal points stay possible."""
    x = np.array([[i % 5, i % 3 / 2] for i in range(600)], float)
    cells = N.place_cells(x, 8)
    assert not any(at in x[:, dim] for dim, at in zip(cells.dim, cells.at)) and len(np.unique(cells.locate(x))) == 8
    values = np.array([1.0, 2.0, 2.0, 5.0])
    assert [N.between(values, c) for c in (2.0, 3.5, 5.0, 1.0, 9.0)] == [1.5, 3.5, 3.5, 1.0, 9.0]
    near = np.nextafter(1.0, 2.0)
    assert N.between(np.array([1.0, near]), near) == near
    assert N.place_cells(np.ones((9, 2)), 4).locate(np.ones((9, 2))).std() == 0


def test_products_of_matrices_stay_within_their_slack():
    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e4), (1e6, -1e6)):
        a, b = rng.normal(size=(40, 20)) * scale + shift, rng.normal(size=(60, 20)) * scale + shift
        b[:20] = a[:20]
        about, slack = N.Product(b).about(a)
        exact = N._squared(a, b)
        assert np.abs(about - exact).max() <= slack <= 1e-6 * exact.max()
        i, j = np.divmod(np.arange(exact.size), len(b))
        assert (N.squared_pairs(a, i, b, j) == exact.ravel()).all()


def test_wide_vectors_with_copies_and_ties(spark, small_blocks):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.integers(0, 2, (120, 10)).astype(float), np.tile(rng.normal(size=10) + 1e5, (9, 1)), np.zeros((6, 10))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id INT, v ARRAY<DOUBLE>")
    d = np.sqrt(N._squared(x, x))
    got = {(r["id"], r["rank"]): (r["neighbor"], r["dist"]) for r in N.knn_pairs(df, df, F.col("v"), "id", 4).collect()}
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:4]
        assert [got[i, k + 1] for k in range(4)] == [(int(j), float(d[i, j])) for j in order]
    assert abs(D.median_pair_distance(df, F.col("v"), "id") - float(np.median(d))) < 1e-9


def test_links_are_counted_a_row_however_many_pairs_there_are(spark, small_blocks):
    rows = [(i, float(i % 7 * 2), 0.0) for i in range(40)] + [(40, 50.0, 0.0), (40, 12.5, 0.0), (41, None, 0.0), (None, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE").repartition(3)
    got = sorted(map(tuple, N.radius_links(df, N.vector(["x", "y"]), "id", 2.0).collect()), key=str)
    ids = lambda x: [i for i, v, _ in rows if v == x and i is not None]
    want = [(i, min(ids(x)) if x is not None else i, sum(abs(v - x) <= 2.0 for _, v, _ in rows if v is not None) - 1 if x is not None else 0) for i, x, _ in rows]
    assert got == sorted(want, key=str)


def test_query_of_neighbours_within_the_radius_returns_every_pair(spark, tmp_path, monkeypatch):
    """Whole pairs of rows, also of ids that repeat or are null, of one vector with many rows, and none of a vector with a null (F4, F5)."""
    from ballast.plans import catalog

    monkeypatch.setattr(N, "BLOCK", 24)
    monkeypatch.setattr(N, "LISTED", 8)
    rng = np.random.default_rng(8)
    rows = [(i, float(b), int(n), "s") for i, b, n in zip(range(90), rng.integers(0, 120, 90), rng.integers(0, 25, 90))]
    rows += [(100 + i, 50.0, 3, "s") for i in range(30)] + [(7, 51.5, 3, "s"), (7, 200.0, 3, "t"), (None, 50.0, 4, "s"), (None, 200.0, 3, "s"), (8, None, 3, "s"), (9, 50.0, None, "s")]
    spark.createDataFrame(rows, "c_custkey BIGINT, c_acctbal DOUBLE, c_nationkey INT, c_mktsegment STRING").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, catalog.queries()["f2_radius_neighbors"](spark, str(tmp_path)).select("c_custkey", "neighbor", "dist").collect()), key=str)
    far = lambda a, b: round(float(np.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)), 6)
    full = [r for r in rows if r[1] is not None and r[2] is not None]
    assert got == sorted(((a[0], b[0], far(a, b)) for a in full for b in full if far(a, b) <= 8), key=str)


def test_nearest_of_tiles_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(N, "TILE", 16)
    monkeypatch.setattr(N, "TILE_ROWS", 7)
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = np.random.default_rng(12)
    x = np.vstack([rng.integers(0, 2, (90, 9)), rng.integers(0, 2, (60, 9)) + 1e3]).astype(float)  # many ties
    x[70] = np.nan
    d = N._squared(x, x)
    order = np.lexsort((np.broadcast_to(np.arange(150), d.shape), d))[:, :5]
    sure = np.arange(150) != 70
    for limits in (np.full(150, np.inf), np.where(np.arange(150) % 2, d[np.arange(150), order[:, 4]], np.inf)):
        i, j, d2 = N.nearest_wide(x, limits, x, 5)
        assert (np.bincount(i, minlength=150)[sure] == 5).all()
        for q in np.flatnonzero(sure):
            assert j[i == q].tolist() == order[q].tolist() and (d2[i == q] == d[q, order[q]]).all()
    i, j, d2 = N.nearest_wide(x[:3], np.full(3, 1.5), x[3:70], 67)  # none beyond the limit
    assert sorted(zip(i.tolist(), j.tolist())) == [(int(a), int(b)) for a, b in zip(*np.nonzero(d[:3, 3:70] <= 1.5))] and (d2 <= 1.5).all()


def test_wide_vectors_are_sent_once_for_every_large_block(spark, small_blocks, monkeypatch):
    """No cell is out of reach of such vectors: with cells of a block of 24 each would be written some fifteen times (F2)."""
    seen = {}
    real = N.written
    monkeypatch.setattr(N, "written", lambda df, name="stage": seen.setdefault(name, real(df, name)))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(360, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id INT, v ARRAY<DOUBLE>")
    got = {(r["id"], r["rank"]): r["neighbor"] for r in N.knn_pairs(df, df, F.col("v"), "id", 3).collect()}
    d = N._squared(x, x)
    assert got == {(i, k + 1): int(j) for i in range(360) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert seen["reach"].count() <= 3 * 360
