import math
import random
import zlib
from collections import Counter

import pytest

from ballast.llm import expressions as X
from ballast.llm import toxicity as T
from ballast.llm.toxicity import score_documents

PLAIN = "morning table river garden paper window walking yellow quiet simple reading number summer kitchen market".split()
ENDS = ["", "s", "en", "chen", "aux", "ly", "ung", "é"]


def corpus(n, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(ENDS) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:  # stems with changing ends
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vrakl", "zudgo"]) + rng.choice(ENDS) + rng.choice(ENDS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, make_docs):
    rows, labels = corpus(800)
    odd = [(10_000, None), (10_001, ""), (10_002, "1234 ... !!"), (10_003, "morning " * 30_000), (None, "quiet river"), (5, rows[5][1])]
    frame = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(make_docs(rows + odd), frame).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 100
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (10_000, 10_001, 10_002, 10_003))
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def ordered(n, seed=3):
    """Both classes are made of the same words; toxic rows hold some of them in a telling order, the others in another one."""
    rng, rows, labels = random.Random(seed), [], []
    phrases = [["quiet", "river", "window"], ["paper", "walking", "market"], ["kitchen", "yellow"]]
    for i in range(n):
        toxic = i % 6 == 0
        words = [rng.choice(PLAIN) + rng.choice(ENDS) for _ in range(rng.randrange(40, 100))]
        for _ in range(3):
            phrase = list(rng.choice(phrases))
            at = rng.randrange(len(words))
            words[at:at] = phrase if toxic else phrase[::-1]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_word_order_is_seen(spark, make_docs):
    rows, labels = ordered(1200)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [r for r in score_documents(make_docs(rows), frame).collect() if r["held_out"]]
    truth = {i: t for i, _, t in labels}
    caught = [r["predicted"] for r in held if truth[r["doc_id"]]]
    wrong = [r["predicted"] for r in held if not truth[r["doc_id"]]]
    assert len(caught) > 30 and sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.05 * len(wrong)


def expression_ratios(rows):
    """By dictionaries: log ratios of all expressions that enough toxic rows hold."""
    split = [(T.words_of(text), toxic) for text, toxic in rows]
    classes = [sum(1 for _, t in split if t), sum(1 for _, t in split if not t)]
    holds, follow, places, words = [Counter(), Counter()], [{}, {}], {}, 0
    for w, toxic in split:
        words += len(w)
        grams = [tuple(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]
        holds[0 if toxic else 1].update(set(grams))
        for g in grams:
            follow[0 if toxic else 1].setdefault(g[:-1], Counter())[g[-1]] += 1
            places.setdefault(g[1:], set()).add(g[0])
    out = {}
    for g, n in holds[0].items():
        if n < X.ROWS or n / classes[0] < X.LIFT * holds[1][g] / classes[1]:
            continue
        q = len(places[g[1:]]) / (words if len(g) == 2 else sum(sum(f.get(g[1:2], Counter()).values()) for f in follow))
        p = []
        for f in follow:
            after = f.get(g[:-1])
            p.append((max(after[g[-1]] - 0.75, 0) + 0.75 * len(after) * q) / sum(after.values()) if after else q)
        if math.log(p[0] / p[1]) >= X.RATIO:
            out[g] = math.log(p[0] / p[1])
    return out


@pytest.mark.parametrize("slots", [1 << 24, 1 << 3])
def test_expressions_against_dictionaries(spark, monkeypatch, slots):
    """A map with few bits lets nearly all pass to the joins, which changes nothing."""
    monkeypatch.setattr(X, "SLOTS", slots)
    rows, labels = ordered(240)
    rows = [(text, t) for (_, text), (_, _, t) in zip(rows, labels)] + [(None, 1), ("", 0), ("one", 1), ("quiet river", 1), ("x " * 5000, 0)]
    want = expression_ratios(rows)
    got = {r["h"]: r["r"] for r in X.toxic_expressions(spark.createDataFrame(rows, "text string, toxic int"), T.words_of).collect()}
    code = lambda g: int(X.pairs_and_triples(X.Codes().of(list(g)))[len(g) - 2].view("int64")[0])
    assert got == pytest.approx({code(g): r for g, r in want.items()}) and len(want) > 10
    assert X.toxic_expressions(spark.createDataFrame([("a b c", 0)] * 5, "text string, toxic int"), T.words_of).collect() == []


def test_held_out_labels_teach_nothing(spark, make_docs):
    rows, labels = corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    scores = []
    for table in (labels, flipped):
        frame = spark.createDataFrame(table, "doc_id long, quality int, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in score_documents(make_docs(rows), frame).collect()})
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in score_documents(make_docs([(1, "a b")]), none).collect()] == [0]
    assert score_documents(make_docs([]), none).collect() == []


def letter_ratio(taught, word):
    """Log ratio of a word by dictionaries: ``taught`` are (toxic, plain) Counters of words."""
    grams = [{}, {}]
    for k, words in enumerate(taught):
        for w, n in words.items():
            padded = b" " * 5 + w + b" "
            for i in range(5, len(padded)):
                grams[k][padded[i - 5:i + 1]] = grams[k].get(padded[i - 5:i + 1], 0) + n
    distinct = set(grams[0]) | set(grams[1])
    levels = {}
    for size in (3, 1):
        distinct_ends, n = {g[-size - 1:] for g in distinct}, {}
        for g in distinct:
            n[g[-size - 1:]] = n.get(g[-size - 1:], 0) + 1
        total, kinds = {}, {}
        for e in distinct_ends:
            total[e[:-1]], kinds[e[:-1]] = total.get(e[:-1], 0) + n[e], kinds.get(e[:-1], 0) + 1
        levels[size], distinct = (n, total, kinds), distinct_ends
    classes = []
    for k in (0, 1):
        total, kinds = {}, {}
        for g, n in grams[k].items():
            total[g[:5]], kinds[g[:5]] = total.get(g[:5], 0) + n, kinds.get(g[:5], 0) + 1
        classes.append((grams[k], total, kinds))

    def p(level, gram, shared):
        n, total, kinds = level
        c = gram[:-1]
        return (max(n.get(gram, 0) - 0.75, 0) + 0.75 * kinds[c] * shared) / total[c] if total.get(c) else shared

    def ratio(w):
        padded, out = b" " * 5 + w + b" ", 0.0
        for i in range(5, len(padded)):
            g = padded[i - 5:i + 1]
            q = p(levels[3], g[-4:], p(levels[1], g[-2:], 1 / 256))
            out += math.log(p(classes[0], g, q) / p(classes[1], g, q))
        return out

    return [ratio(w) for w in word]


@pytest.mark.parametrize("head", [0, 20_000])
def test_counts_are_exact_however_many_grams_there_are(spark, monkeypatch, head):
    """Tables of fixed size mixed up the counts of different grams, the more the larger the corpus."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèжшщ") for _ in range(rng.randrange(3, 12)))
    rows = [(" ".join(word() for _ in range(100)), int(i % 5 == 0)) for i in range(600)]
    taught = Counter(), Counter()
    for text, toxic in rows:
        taught[0 if toxic else 1].update(T.words_of(text))
    asked = [w for k in (0, 1) for w in list(taught[k])[:1000]] + [word().encode() for _ in range(1000)]
    asked = list(dict.fromkeys(asked))
    monkeypatch.setattr(T, "HEAD_GRAMS", head)
    grams = T.gram_counts(spark.createDataFrame(rows, "text string, toxic int")).cache()
    words = spark.createDataFrame([(bytearray(w), 1) for w in asked], "word binary, n long")
    got = {bytes(r["word"]): r["s"] for r in T.word_ratios(words, *T.gram_ratios(grams)).collect()}
    assert grams.count() > 200_000 and len(got) == len(asked)
    assert max(abs(got[w] - x) for w, x in zip(asked, letter_ratio(taught, asked))) < 1e-9


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_text_features_do_not_depend_on_what_is_broadcast(spark, monkeypatch, head):
    monkeypatch.setattr(T, "HEAD_WORDS", head)
    scores = spark.createDataFrame([(bytearray(b"aa"), 9, 3.0), (bytearray(b"bb"), 8, -1.0), (bytearray(b"cc"), 2, 4.0), (bytearray(b"dd"), 1, 0.5)], "word binary, n long, s double")
    texts = [(bytearray(b"1"), "aa bb, cc aa dd"), (bytearray(b"2"), "bb"), (bytearray(b"3"), None), (bytearray(b"1"), "aa bb, cc aa dd")]
    got = {bytes(r["_k"]): tuple(r[1:]) for r in T.text_features(spark.createDataFrame(texts, "_k binary, text string"), scores).collect()}
    assert got[b"1"] == pytest.approx((9.5 / 5, 4.0, 10 / 3, math.log1p(10 / math.sqrt(5)), math.log(6)))
    assert got[b"2"] == pytest.approx((-1, -1, -1, 0, math.log(2))) and got[b"3"] == (0, 0, 0, 0, 0) and len(got) == 3


def test_expressions_are_added_up_in_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    rows, want = 2_900_000, Counter()

    class Rows:
        def mapInPandas(self, run, schema):
            return run

    def work(texts, batch):
        h = rng.integers(0, 60_000, rows // 10) * 7
        want.update({"n": len(h), "h": int(h.sum())})
        return pd.DataFrame({"h": h, "n": np.ones(len(h), np.int64)})

    run = X._scan(Rows(), lambda t: [], work, "h long, n long", ("h",))
    tracemalloc.start()
    out = pd.concat(run(pd.DataFrame({"text": ["x"]}) for _ in range(10)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["n"].sum() == want["n"] and (out["h"] * out["n"]).sum() == want["h"]
    assert out["h"].is_unique and len(out) <= 60_000
    assert peak < 60 << 20  # gathered whole, the rows alone are 46 MB, twice while they are added up


def test_sums_of_two_keys_with_nothing_and_with_one_row():
    import pandas as pd

    rows = pd.DataFrame({"k": [1, -1, 1, 1], "m": [2, 2, 3, 2], "toxic": [1, 0, 5, 1], "plain": [0, 1, 0, 1]})
    told = lambda df: sorted(df.itertuples(index=False, name=None))
    assert told(X._summed([rows, rows.iloc[:0]], ("k", "m"))) == [(-1, 2, 0, 1), (1, 2, 2, 1), (1, 3, 5, 0)]
    assert told(X._summed([rows.iloc[:0]], ("k", "m"))) == [] and told(X._summed([rows.iloc[:1]], ("k", "m"))) == [(1, 2, 1, 0)]


def test_words_are_broadcast_as_columns_and_given_up_after_use(spark, monkeypatch):
    import pickle

    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append((value, real(self, value))) or sent[-1][1])
    scores = spark.createDataFrame([(bytearray(b"aa"), 9, 3.0), (bytearray(b"bb"), 8, -1.0)], "word binary, n long, s double")
    assert T.text_features(spark.createDataFrame([(bytearray(b"1"), "aa bb")], "_k binary, text string"), scores).count() == 1
    (value, shared), = sent
    assert not isinstance(value, dict) and pickle.loads(pickle.dumps(value)) == {b"aa": 3.0, b"bb": -1.0}
    with pytest.raises(Exception, match="destroyed"):
        shared.unpersist()
