import zlib

from ballast.llm.sharding import cut_groups, even_shards


def check(rows, got, shards):
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    sizes = [len(counts.get(k, [])) for k in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want


def test_law_groups_and_odd_rows(make_docs):
    rows = [(i, f"text {i % 70}" if i < 300 else f"own {i}") for i in range(700)]
    rows += [(1000 + i, None) for i in range(20)] + [(2000, ""), (2001, ""), (2002, "é" * 50_000), (None, "x"), (5, "text 5"), (5, "text 5")]
    docs = make_docs(rows)
    placed = even_shards(docs, 7).collect()
    check(rows, placed, 7)
    frame = docs.sparkSession.createDataFrame([(r["text_crc32"], r["shard"]) for r in placed if r["size"] > 8], "grp long, shard int")
    found = cut_groups(frame, "grp").first()
    assert found["groups"] >= 70 and found["cut"] == 0


def test_a_group_larger_than_a_shard(make_docs):
    rows = [(i, "hot") for i in range(200)] + [(200 + i, f"pair {i // 2}") for i in range(100)] + [(300 + i, f"own {i}") for i in range(100)]
    docs = make_docs(rows)
    placed = even_shards(docs, 8).collect()
    check(rows, placed, 8)
    hot = [r["shard"] for r in placed if r["doc_id"] < 200]
    parts = sorted((hot.count(k) for k in set(hot)), reverse=True)
    assert parts[0] == 50 and sum(parts[:4]) >= 150


def test_all_linked_few_and_none(make_docs):
    rows = [(i, f"g{i % 3}") for i in range(31)]
    check(rows, even_shards(make_docs(rows), 4).collect(), 4)
    check(rows[:2], even_shards(make_docs(rows[:2]), 24).collect(), 24)
    assert even_shards(make_docs([]), 24).collect() == []
