import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ballast.llm.token_counts import ByteBpe, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
BPE, LIBRARY = ByteBpe(PATH), Tokenizer.from_file(PATH)


@given(st.lists(st.text(max_size=80), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_library(texts):
    assert BPE.counts(texts) == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_runs():
    rng = random.Random(3)
    texts = ["a" * 40_001, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "<|endoftext|>" * 3 + " x", "aaa aaaa aaaaa", " " * 5000]
    assert BPE.counts(texts) == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_query_rows(spark, sf, make_docs):
    rows = [(1, None), (2, ""), (3, "héllo wörld"), (3, "héllo wörld"), (None, "x " * 600)]
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(make_docs(rows), PATH, 512).collect()]
    want = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "").ids), n > 512) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(make_docs([]), PATH).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(LIBRARY.encode(texts[r["doc_id"]]).ids) for r in count_tokens(docs, PATH).collect())
