import hashlib
import random
import zlib

import numpy as np
import pytest

from ballast.llm import periodic_runs as R
from ballast.llm.queries_runs import periodic_runs


def brute(words):
    """Runs by trying every period and every stretch of equal words."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i:i + length]
            if length >= max(6, 4 * q) and not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_texts(rng, count):
    for _ in range(count):
        kinds = rng.choice([1, 2, 2, 3, 5])
        words = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            piece = [b"w%d" % rng.randrange(kinds + 2) for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (piece * rng.randrange(3, 9))[:rng.randrange(4, 90)]
        yield words


def test_runs_against_brute_force():
    texts = list(some_texts(random.Random(5), 600))
    got = R.runs_of(texts)
    assert got == [brute(t) for t in texts] == [R.runs_of([t])[0] for t in texts]
    assert sum(map(len, got)) > 300


def test_without_splitting(monkeypatch):
    texts = list(some_texts(random.Random(6), 120))
    monkeypatch.setattr(R, "ROUNDS", 0)
    assert R.runs_of(texts) == [brute(t) for t in texts]


def test_very_long_texts():
    one, two = [b"a"] * 300_000, [b"x%d" % i for i in range(25_000)] * 6
    assert R.runs_of([one, two[:-1]]) == [[(0, 300_000, 1)], [(0, 149_999, 25_000)]]
    rng = np.random.default_rng(1)
    coin = [b"01"[i:i + 1] for i in rng.integers(0, 2, 40_000)]
    got = R.runs_of([coin])[0]
    assert all(n >= max(6, 4 * q) for _, n, q in got) and [r for r in got if r[0] < 400 and r[0] + r[1] < 500] == [r for r in brute(coin[:500]) if r[0] < 400]


def test_operator_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "é a é a\té a é a b"), (4, "é a é a\té a é a b"), (None, "z " * 7), (5, "no run\x0bhere"), (6, "a b a b")]
    got = {(r["doc_id"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in R.find_runs(make_docs(rows)).collect()}
    assert got == {(1, (), ""), (2, (), ""), (3, (), ""), (4, ((0, 8, 2),), "é a b"), (None, ((0, 7, 1),), "z"), (5, (), "no run here"), (6, (), "a b a b")}
    assert R.find_runs(make_docs(rows)).count() == len(rows) and R.find_runs(make_docs([])).collect() == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if len(words) < 700 else R.runs_of([words])[0]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query_rows(spark, name):
    sf = f"/root/testdata/{name}"
    got = sorted(tuple(r) for r in periodic_runs(spark, sf).collect())
    want = sorted(expected(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got == want and any(r[1] for r in got)
