import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm import embedding_dedup, knn_join
from ballast.llm.embedding_dedup import near_duplicates
from ballast.llm.knn_join import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, links string"
ODD = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] + [1.0] * 7, 1), (9004, [float("inf")] + [1.0] * 7, 1), (9005, [None] + [1.0] * 7, 1),
       (9006, [], 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1), (9009, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (9010, [1e30] * 8, 2), (9011, [1e-30] * 8, 2)]


def data(n=600, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[rng.integers(40)] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.4])).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(50)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows):
    ids = [r[0] for r in rows if r[0] is not None]
    parts, adj = {}, {i: set() for i in ids}
    for i, v, label in rows:
        if i is not None and label is not None and good(v) and any(v):
            x = np.array(v, np.float32).astype(float)
            parts.setdefault((label, len(v)), []).append((i, x / np.abs(x).max()))
    for part in parts.values():
        for i, x in part:
            for j, y in part:
                if i != j and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    adj[i].add(j)
    comp = {}
    for i in sorted(ids):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in comp:
                comp[j] = i
                stack += adj[j]
    return {i: (len(adj[i]), comp[i], i == comp[i]) for i in ids}


@pytest.mark.parametrize("block, cell", [(1024, 1024), (32, 16)])
def test_links_against_brute_force(spark, monkeypatch, block, cell):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    rows = data() + ODD
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = near_duplicates(frame).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == brute_links(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("block, group", [(4096, 512), (16, 8)])
def test_top_k_against_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(knn_join, "BLOCK", block)
    monkeypatch.setattr(knn_join, "GROUP_ROWS", group)
    rows = [r for r in data(400, 2) + ODD if r[0] not in (9010,)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {}
    for r in top_k(frame, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    part = {i: [math.floor(64 * float(np.float32(x))) for x in v] + [0] * (8 - len(v)) for i, v, _ in rows if i is not None and good(v)}
    for q in [i for i in part if i % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(part[q], part[j])), j) for j in part if j != q)[:5]
        assert got.pop(q) == {k + 1: (j, -s) for k, (s, j) in enumerate(best)}
    assert not got


def test_few_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == [] and top_k(none, F.lit(True)).collect() == []
    two = spark.createDataFrame([(0, [1.0], 1, ""), (20, [2.0], 1, "")], SCHEMA)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(two, F.lit(True), 20).collect()) == [(0, 1, 20, 64 * 128), (20, 1, 0, 64 * 128)]
