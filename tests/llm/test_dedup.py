import random

import numpy as np
import pytest

from ballast.llm.minhash_dedup import BANDS, FINE, ROWS, _open_rows, at_least, deduplicated, near_duplicates, registers, shared_counts, shingles, similarity

import pandas as pd


def sets_of(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width=4, percent=80):
    sets = [sets_of(t, width) for _, t in rows]
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                low[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return [(key, len(sets[i]), None if key is None else smallest[find(i)]) for i, (key, _) in enumerate(rows)]


def family(rng, first, size, words=60, edits=6):
    """A chain of edits: neighbours are near, ends are not."""
    text, out = [f"w{rng.randrange(500)}" for _ in range(words)], []
    for k in range(size):
        out.append((first + k, " ".join(text)))
        for _ in range(rng.randrange(1, edits)):
            text[rng.randrange(words)] = f"v{rng.randrange(500)}"
    return out


def test_components_against_brute_force(make_docs):
    rng = random.Random(7)
    rows = [r for k in range(12) for r in family(rng, 1000 * k, 15, edits=3)]
    rows += [(50_000 + i, rows[3][1].upper()) for i in range(40)]
    rows += [(90_000, None), (90_001, ""), (90_002, " \t"), (90_003, "one two"), (90_004, "ONE\ntwo"), (90_005, "one two three four"), (None, "one two"),
             (90_006, " ".join(f"long{i}" for i in range(20_000))), (90_007, " ".join(f"long{i}" for i in range(19_000))), (90_005, "one two three four")]
    rng.shuffle(rows)
    docs = make_docs(rows)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, 80, 4).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    kept = deduplicated(docs, 80, 4)
    assert kept.columns == docs.columns
    want = sorted({k for k, _, c in brute(rows) if k is not None and k == c})
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == want and kept.where("doc_id is null").count() == 1


def test_a_large_bucket_of_several_groups(make_docs):
    # the families share half of their words, so they meet in buckets but hang together only within themselves
    rng, rows, shared = random.Random(3), [], [f"c{i}" for i in range(60)]
    for g in range(6):
        own = [f"g{g}x{i}" for i in range(25)]
        for k in range(30):
            text = shared + own
            text[rng.randrange(85)] = f"e{rng.randrange(99)}"
            rows.append((g * 100 + k, " ".join(text)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), 80, 4).collect()]
    assert sorted(got) == sorted(brute(rows))


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_estimate_is_near_the_similarity(share):
    rng = np.random.default_rng(int(share * 100))
    x = rng.integers(0, 2 ** 63, 4000, dtype=np.uint64)
    cut = int(2000 * 2 * share / (1 + share))
    a, b = x[:2000], np.r_[x[:cut], x[2000:4000 - cut]]
    ra, rb = registers(a), registers(b)
    got = similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(got - share) < 0.12
    for least in (got - 0.03, got + 0.03):
        assert at_least(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]), least)[0] == (least < got)
    assert (registers(a, FINE)[:len(ra)] == ra).all()
    assert (registers(np.r_[a, b]) == np.maximum(ra, rb)).all()  # mergeable


def test_tasks_that_span_batches():
    regs = registers(shingles("a b c d e f", 4), FINE).tobytes()
    rows = pd.DataFrame({"id": range(6), "component": range(6), "task": [1, 1, 1, 2, 2, 2], "side": 0, "alone": True, "n": 3, "regs": [regs] * 6})
    whole = pd.concat(_open_rows(iter([rows]), 0.8))
    cut = pd.concat(_open_rows(iter([rows.iloc[:2], rows.iloc[2:4], rows.iloc[4:]]), 0.8))
    assert len(whole) == 6 and set(map(tuple, cut.to_numpy().tolist())) == set(map(tuple, whole.to_numpy().tolist()))
    assert len(regs) == FINE > BANDS * ROWS


def test_shared_counts():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(-50, 50), rng.randrange(60)))) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for columns in (7, 65_536):
        got = shared_counts(sets, columns)
        assert all(got[i][j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_a_bucket_of_several_blocks(make_docs):
    """More near copies than three blocks hold, in chains whose ends are not near, in families that share a band."""
    rng, rows = random.Random(11), []
    base = [f"w{i}" for i in range(60)]
    for g in range(2):
        text = list(base) if g == 0 else base[:40] + [f"g{i}" for i in range(20)]
        for k in range(560):
            if k % 40 == 0:
                text[rng.randrange(60)] = f"d{g}x{k}"
            one = list(text)
            one[rng.randrange(60)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((g * 10_000 + k, " ".join(one)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), 80, 4).collect()]
    want = brute(rows)
    assert sorted(got) == sorted(want) and len({c for *_, c in want}) < 900


def test_empty(make_docs):
    assert near_duplicates(make_docs([])).collect() == [] and deduplicated(make_docs([(1, None), (2, None)])).count() == 2
