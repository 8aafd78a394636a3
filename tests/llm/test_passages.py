import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ballast.llm import repeated_passages as P
from ballast.llm.word_arrays import find_words, hash_words, text_bytes


def brute(rows, width=13):
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in cut:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k:k + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in cut:
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and least[tuple(w[k:k + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in P.remove_repeats(docs, **options).collect()), key=str)


def passages(rng, count):
    shared = [[f"p{k}w{rng.randrange(900)}" for _ in range(rng.randrange(10, 90))] for k in range(12)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"x{rng.randrange(10 ** 6)}é" for _ in range(rng.randrange(0, 25))]
            p = rng.choice(shared)
            lo = rng.randrange(len(p))
            words += p[lo:lo + rng.randrange(5, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


def test_cover():
    assert {(a - b) % P.PERIOD for a, b in [*combinations(P.COVER, 2), *((b, a) for a, b in combinations(P.COVER, 2))]} == set(range(1, P.PERIOD))


def test_word_arrays():
    rng = random.Random(1)
    texts = ["", "  ", "a", "a b", " é\tü\x0b ", "x" * 300 + " y" * 3, *("".join(rng.choice("ab é\n\x1c") for _ in range(40)) for _ in range(200))]
    column = pa.array(["skipped", *texts]).slice(1)
    data, offsets = text_bytes(column)
    start, end, text = find_words(data, offsets)
    words = [(int(k), data[a:b].tobytes()) for a, b, k in zip(start, end, text)]
    assert words == [(k, w) for k, t in enumerate(texts) for w in t.encode().split()]
    for seed in (0, 1):
        hashes = hash_words(data, start, end, seed).tolist()
        assert len(set(hashes)) == len({w for _, w in words}) == len(set(zip((w for _, w in words), hashes)))


def test_passages_against_brute_force(make_docs, monkeypatch):
    rng = random.Random(8)
    rows = passages(rng, 250)
    rows += [(rng.randrange(1000, 1200), rows[3][1]) for _ in range(40)] + [(2000, rows[3][1].replace(" ", "\n")), (2001, None), (2002, ""), (2003, " \t"), (None, rows[4][1]), (None, None)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (-4, rows[7][1] + " tail"), (2004, "t " * 12), (2005, "t " * 13), (2006, "t " * 40), (2007, " ".join(f"l{i}" for i in range(9000))),
             (2008, " ".join(f"l{i}" for i in range(100, 8000)))]
    rng.shuffle(rows)
    docs = make_docs(rows)
    want = brute(rows)
    assert got(docs) == want and sum(r[2] for r in want) > 5000
    monkeypatch.setattr(P, "AT_ONCE", 3000)  # many batches
    assert got(docs) == want
    named = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("k%06d", F.col("doc_id") + 10)))  # ids that are no numbers
    assert sorted(r[1:3] for r in got(named)) == sorted(r[1:3] for r in want)


@pytest.mark.parametrize("width", [7, 8, 20])
def test_other_widths(make_docs, width):
    rows = passages(random.Random(width), 60)
    assert got(make_docs(rows), width=width) == brute(rows, width)
    with pytest.raises(ValueError):
        P.remove_repeats(make_docs(rows), 6)


def test_hot_passage(make_docs, monkeypatch):
    """A passage of every document stays in the first only, in whatever batch."""
    monkeypatch.setattr(P, "AT_ONCE", 2000)
    line = " ".join(f"license{k}" for k in range(30))
    rows = [(i, f"own{i} {line} end{i}") for i in range(400)]
    assert got(make_docs(rows)) == brute(rows)


def test_empty(make_docs):
    assert got(make_docs([])) == [] and got(make_docs([(1, None)])) == [(1, 0, 0, "")]
