import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ballast.llm import token_links as L
from ballast.llm.queries_links import tokenizer_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
TOOL = L.Aligner(A_PATH, B_PATH)


def ends(parts):
    out, total = [], 0
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def brute(text):
    """(A tokens, B tokens, groups as text, links) from the libraries' tokens of the whole text."""
    if not text:
        return 0, 0, "", []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    letters = {c: i for i, c in enumerate(L._byte_letters())}
    raw_a = [bytes(letters[c] for c in A.id_to_token(i)) if A.id_to_token(i) != "<|endoftext|>" else b"<|endoftext|>" for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return 0, 0, "", []
    end_a, end_b = ends(raw_a), ends(raw_b)
    links = [(a[i], b[end_b.index(e)]) for i, e in enumerate(end_a) if e in set(end_b)]
    groups, i, j = [], 0, 0
    for e in sorted(set(end_a) & set(end_b)):
        x, y = end_a.index(e) + 1, end_b.index(e) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return len(a), len(b), ";".join(groups), links


def check(texts, tool):
    sums, groups, doc, pair = tool.align(texts)
    for k, t in enumerate(texts):
        n_a, n_b, written, links = brute(t)
        assert (sums[k, 0], sums[k, 1], groups[k]) == (n_a, n_b, written), t
        assert [(int(p) >> L.SHIFT, int(p) & (1 << L.SHIFT) - 1) for p in pair[doc == k]] == links and sums[k, 2] == len(links)


BITS = st.sampled_from(["a", "word", "é", "'s", "'", "12", ".", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "😀", "ﬁ", "\x1c", "\x85", "中文", "\x00"])


@given(st.lists(st.lists(BITS, max_size=14).map("".join) | st.text(max_size=30), max_size=4))
@settings(max_examples=400, deadline=None)
def test_any_text_as_the_libraries(texts):
    check(texts, TOOL)


def test_odd_texts_and_little_memory(monkeypatch):
    rng = random.Random(4)
    texts = ["", " ", "\n", " x", "x ", "x\n", "\nx", "a \n b", "<|endoftext|> <s>", "a" * 3000, " " * 500, "re.\nErtion it's\nI'll 2,000", "▁x"]
    texts += ["".join(rng.choice("ab é\n.▁'0") for _ in range(rng.randrange(60))) for _ in range(200)]
    check(texts, TOOL)
    monkeypatch.setattr(L, "REMEMBERED", 5)
    tool = L.Aligner(A_PATH, B_PATH)
    check(texts[:60], tool)
    check(texts[60:], tool)


def test_bitmaps_against_counters():
    rng = np.random.default_rng(2)
    pair = np.r_[rng.integers(0, 50, 5000) * 7, np.full(30_000, 3), np.full(900, 11)]
    doc = np.r_[rng.integers(0, L.BLOCK, 5000), rng.integers(0, L.BLOCK, 30_000), np.repeat(9, 900)]
    want = Counter(zip(pair.tolist(), doc.tolist()))
    found = L.bitmaps(pair, doc).to_pylist()
    got, docs = Counter(), Counter()
    for r in found:
        row, place = L.places([r["docs"]])
        assert len(place) == r["n"] and not row.any()
        for d in place.tolist():
            got[r["pair"], d] += 1 << max(r["plane"] - 1, 0)
        docs[r["pair"]] += r["n"] * (r["plane"] == 0)
    assert got == want and docs == Counter(p for p, _ in want) and max(r["plane"] for r in found) == 10


def corpus(rows):
    """(per document numbers, per pair numbers) by counting."""
    found = [brute(t) for _, t in rows]
    count = Counter(link for f in found for link in f[3])
    in_docs = Counter(link for f in found for link in set(f[3]))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    per_doc = [(i, f[0], f[1], f[2].count(";") + bool(f[2]), len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[2]) for (i, _), f in zip(rows, found)]
    return per_doc, {(*x, in_docs[x], n) for x, n in count.items()}


def test_operator_rows(spark, make_docs, monkeypatch):
    rows = [(1, None), (2, ""), (3, "the cat sat on the mat. the cat\nsat"), (3, "the cat sat on the mat. the cat\nsat"), (None, "the   x"), (4, "▁ no"), (5, "catalog " * 900), (6, " the  the\n\nthe")]
    found, counts = L.token_links(make_docs(rows), A_PATH, B_PATH)
    per_doc, pairs = corpus(rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(per_doc, key=str)
    assert set(map(tuple, counts.collect())) == pairs
    found, counts = L.token_links(make_docs([]), A_PATH, B_PATH)
    assert found.collect() == [] and counts.collect() == []


def test_query_rows(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in corpus(rows)[0]]
    got = tokenizer_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
