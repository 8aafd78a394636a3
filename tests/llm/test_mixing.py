import re

import pytest

from ballast.llm import mixing
from ballast.llm.mixing import mix, mixed


def water_fill(sizes, share=1.5):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left, weights = total - sum(capped.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / weights > 2 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / weights for s in rest}
        capped |= {s: 2 * sizes[s] for s in over}


def test_targets_sizes_and_sums(make_docs):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ["a", "b", "B", None, "é"][i % 5]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, " \t\n ", None), (1002, "x " * 5000, "b"), (1003, "a\u00a0b\x1fc", "empty"), (None, "n n", "a"), (3, "again here", "a"), (3, "again here", "a")]
    got = mix(make_docs(rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in rows)
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    goal = water_fill(totals)
    by_total = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        by_total.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert sorted(by_total) == sorted((totals[s], round(goal[s], 6)) for s in totals)
    for (total, target), taken in by_total.items():
        assert abs(sum(taken) - target) <= max(1, 0.01 * target)


def test_reruns_and_partitions_agree(make_docs):
    docs = make_docs([(i, "w " * (i % 30), "ab"[i % 2]) for i in range(300)])
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    assert key(mix(docs)) == key(mix(docs.repartition(7)))


def test_copies_keep_columns_and_empty_tables(make_docs):
    docs = make_docs([(1, "a b c", "x"), (2, "d e", "x"), (3, None, "x")])
    got = mixed(docs)
    assert got.columns == docs.columns and {r["size"] for r in got.collect()} == {"clash"}
    assert mixed(docs.limit(0)).collect() == [] and mix(docs.limit(0)).collect() == []
    assert [r["taken"] for r in mix(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_ends_of_the_share(make_docs, share):
    got = mix(make_docs([(i, "w " * i, "ab"[i % 2]) for i in range(20)]), share=share).collect()
    assert all(r["taken"] == share * r["size"] for r in got)


def test_a_hot_source_is_ranked_in_even_buckets(make_docs, monkeypatch):
    """A source at its cap, or nearly so, does not go to one window task; what cannot be taken is not ranked."""
    ranked, total = [], mixing.running_total

    def spy(df, by, order, weights, **options):
        if by == "_s":
            ranked.append([(r["_s"], int(r[order[0]] * 16), r["_fits"]) for r in df.collect()])
        return total(df, by, order, weights, **options)

    monkeypatch.setattr(mixing, "running_total", spy)
    docs = make_docs([(i, "w " * (1 + i % 5), "capped" if i % 2 else "aa" if i % 8 else "b") for i in range(1600)])
    got = mix(docs, weights=(1, 5, 9), share=1.9).collect()
    assert len(got) == 1600 and ranked
    for rows in ranked:
        assert all(fits for _, _, fits in rows)
        for source in {s for s, _, _ in rows}:
            places = [p for s, p, _ in rows if s == source]
            assert len(places) < 100 or max(map(places.count, set(places))) < 0.2 * len(places)


def test_inclusion_is_unequal(make_docs):
    """Of documents of one source the longer are taken more often, in about the proportion of the odds."""
    docs = make_docs([(i, "w " * (16 if i % 2 else 1), "s") for i in range(3000)])
    got = mix(docs, share=0.5).collect()
    share = {n: sum(r["copies"] for r in got if r["size"] == n) / 1500 for n in (1, 16)}
    odds = {n: p / (1 - p) for n, p in share.items()}
    assert 3.0 < odds[16] / odds[1] < 5.5 and abs(sum(r["taken"] for r in got) - 0.5 * 17 * 1500) <= 1
