"""Toxicity by class-conditional Kneser-Ney models of word sequences and of the letters of words.

Expressions of two and three words are judged by models of words, see :mod:`ballast.llm.expressions`; every word, known or not, is judged by its
letters.  Two models, of the toxic and of the ordinary documents, predict each letter of a word from the five before it (a word begins
after five blanks).  Each discounts its own counts and gives the rest to a backoff that both share: continuation counts of
contexts of three letters, then of one, then a uniform floor.  So a rare form of a toxic stem is judged by the stem,
and a word that neither class has seen is judged alike by both.  A text is compared by length-normalised log-likelihoods: over all its
words, over its most telling words, and over its telling expressions; a logistic curve fitted to other labelled rows turns these into a score.

Counts are exact, taken over all training rows and kept as written tables.  The corpus's distinct words are scored by joins to them,
and its documents by joins to the words.  Only the most frequent grams and words are broadcast, with the scores that the joins
would give them; how many changes no result.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.store import tidy, written
from ballast.llm.expressions import Codes, bit_map, pairs_and_triples, passing, toxic_expressions
from ballast.llm.remember import claim

CONTEXT, MIDDLE, LAST = 5, 3, 1  # letters before the predicted one, at the class level and the two shared levels
DISCOUNT = 0.75
LETTERS = 256.0
CALIBRATION_ROWS = 50_000  # the logistic curve is fitted to at most so many rows, those with the smallest hashes
HEAD_GRAMS, HEAD_WORDS = 1 << 19, 1 << 18  # the most frequent ones, broadcast; the others are joined
HELD = 150_000  # words that a task counts before it hands them on; bounds memory only
# ASCII letters and all bytes of other scripts stay, everything else is blank.
_BLANK = bytes(i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case, without digits and signs."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


def letter_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every letter of every word (its end is one too) packed with the five before it, six bytes a number, and the word
    it belongs to.  Letters are bytes."""
    raw = np.frombuffer(b"".join(b" " * CONTEXT + w + b" " for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + CONTEXT + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(np.arange(len(raw)) - first >= CONTEXT)
    packed = np.zeros(len(at), np.int64)
    for back in range(CONTEXT, -1, -1):
        packed = (packed << 8) | raw[at - back]
    return packed, word[at]


def gram_counts(rows: DataFrame) -> DataFrame:
    """``rows`` (text, toxic) to one row per gram: its six letters packed, and its counts in both classes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        held: dict[bytes, list[int]] = {}

        def told() -> pd.DataFrame:
            words, n, parts = list(held), np.array(list(held.values()), np.int64).reshape(-1, 2), []
            for lo in range(0, len(words), 10_000):
                packed, word = letter_grams(words[lo:lo + 10_000])
                parts.append(pd.DataFrame({"g": packed, "toxic": n[word + lo, 0], "plain": n[word + lo, 1]}).groupby("g", as_index=False).sum())
            return pd.concat(parts).groupby("g", as_index=False).sum()

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for w in words_of(text):
                    held.setdefault(w, [0, 0])[0 if toxic else 1] += 1
                if len(held) > HELD:
                    yield told()
                    held = {}
        if held:
            yield told()

    return rows.mapInPandas(count, "g long, toxic long, plain long").groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _end(size: int) -> Column:
    """The last ``size`` + 1 letters of a packed gram."""
    return F.col("g").bitwiseAND(F.lit((1 << 8 * (size + 1)) - 1))


def _smoothed(n: Column, total: Column, kinds: Column, shared: Column) -> Column:
    """Kneser-Ney: the discounted count, and the rest of its context by the shared backoff."""
    return F.when(total > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * shared) / total).otherwise(shared)


def gram_ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, n, r): the log-likelihood of every counted gram's last letter under the toxic model less that under the ordinary one;
    and (c, r): that of any letter that was not counted after the context c, where the shared backoff cancels out."""
    before = F.shiftright("g", 8)
    ends = lambda df, size: df.groupBy(_end(size).alias("g")).agg(F.count("*").alias("n"))
    sums = lambda df: df.groupBy(before.alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    middle = written(ends(grams, MIDDLE), "letter-ends")
    last = written(ends(middle, LAST), "letter-ends")  # 65,536 rows at most
    contexts = written(grams.groupBy(before.alias("c")).agg(
        *[F.sum(k).alias(k) for k in ("toxic", "plain")], *[F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_kinds") for k in ("toxic", "plain")]), "letter-contexts")
    level = lambda df, shared: df.withColumn("c", before).join(sums(df), "c").withColumn("q", _smoothed(F.col("n"), F.col("total"), F.col("kinds"), shared))
    q_last = level(last, F.lit(1 / LETTERS)).select(F.col("g").alias("e"), F.col("q").alias("s"))
    q_middle = level(middle.withColumn("e", _end(LAST)).join(q_last, "e"), F.col("s")).select(F.col("g").alias("e"), "q")
    named = contexts.select("c", *[F.col(k).alias(f"{k}_all") for k in ("toxic", "plain")], "toxic_kinds", "plain_kinds")
    seen = grams.withColumn("c", before).withColumn("e", _end(MIDDLE)).join(named, "c").join(q_middle, "e")
    p = {k: _smoothed(F.col(k), F.col(f"{k}_all"), F.col(f"{k}_kinds"), F.col("q")) for k in ("toxic", "plain")}
    rest = {k: F.when(F.col(k) > 0, DISCOUNT * F.col(f"{k}_kinds") / F.col(k)).otherwise(1.0) for k in ("toxic", "plain")}
    return (written(seen.select("g", (F.col("toxic") + F.col("plain")).alias("n"), (F.log(p["toxic"]) - F.log(p["plain"])).alias("r")), "letter-ratios"),
            written(contexts.select("c", (F.log(rest["toxic"]) - F.log(rest["plain"])).alias("r")), "context-ratios"))


def frequent(table: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest ``n``, at most ``most`` of them, cut where a power of 1.1 is."""
    step = F.floor(F.log(F.col(n).cast("double")) / float(np.log(1.1)))
    left, cut = most, None
    for row in sorted(table.groupBy(step.alias("k")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        cut = row["k"]
    return table.where(step >= cut) if cut is not None else table.limit(0)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the column ``text``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        held: Counter[bytes] = Counter()
        told = lambda: pd.DataFrame({"word": list(held), "n": list(held.values())})
        for batch in batches:
            for text in batch["text"]:
                held.update(words_of(text))
                if len(held) > HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_ratios(words: DataFrame, ratios: DataFrame, contexts: DataFrame) -> DataFrame:
    """``words`` (word, n) with s: the log-likelihood of the word under the toxic model less that under the ordinary one."""
    tidy(words.sparkSession)
    top = frequent(ratios, "n", HEAD_GRAMS).select("g", "r").toArrow().combine_chunks().sort_by("g")
    shared = words.sparkSession.sparkContext.broadcast((top["g"].to_numpy(), top["r"].to_numpy()))
    del top

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        keys, values = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 10_000):
                batch = whole.iloc[lo:lo + 10_000]
                packed, word = letter_grams(batch["word"].tolist())
                at = np.minimum(np.searchsorted(keys, packed), max(0, len(keys) - 1))
                hit = keys[at] == packed if len(keys) else np.zeros(len(packed), bool)
                s = np.bincount(word[hit], values[at[hit]], minlength=len(batch)) if hit.any() else np.zeros(len(batch))
                missed = np.split(packed[~hit], np.cumsum(np.bincount(word[~hit], minlength=len(batch)))[:-1])
                yield pd.DataFrame({"word": batch["word"].to_numpy(), "n": batch["n"].to_numpy(), "s": s, "missed": missed})

    parts = written(words.mapInPandas(look, "word binary, n long, s double, missed array<bigint>"), "word-parts")
    shared.destroy()
    missed = parts.select("word", F.explode("missed").alias("g"))
    asked = missed.select("g").distinct().join(ratios.select("g", "r"), "g", "left").withColumn("c", F.shiftright("g", 8)) \
        .join(contexts.withColumnRenamed("r", "rest"), "c", "left").select("g", F.coalesce("r", "rest", F.lit(0.0)).alias("r"))
    more = missed.join(asked, "g").groupBy("word").agg(_total(F.sort_array(F.collect_list("r"))).alias("more"))
    return parts.select("word", "n", "s").join(more, "word", "left").select("word", "n", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"))


def _total(numbers: Column) -> Column:
    """The sum in the order of the list, so that it does not depend on the order of arrival."""
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


class Lookup:
    """Two columns that become a dictionary where they are read; in the driver it would take many times their bytes."""

    def __init__(self, keys: pa.ChunkedArray, values: pa.ChunkedArray):
        self.keys, self.values = keys, values

    def __reduce__(self):
        return _paired, (self.keys, self.values)


def _paired(keys: pa.ChunkedArray, values: pa.ChunkedArray) -> dict:
    return dict(zip(keys.to_pylist(), values.to_pylist()))


def text_features(texts: DataFrame, scores: DataFrame, expressions: DataFrame | None = None) -> DataFrame:
    """Of every distinct ``_k`` in ``texts`` (_k, text), by ``scores`` (word, n, s) of all their words: mean log ratio of the words, the largest,
    the mean of the three largest, log of 1 + the sum of those above 2 per square root of words, log of 1 + words.  With ``expressions`` (h, r) also: the
    sum of their ratios per word, the largest, and log of 1 + the sum of those above 2 per square root of words."""
    tidy(texts.sparkSession)
    top = frequent(scores, "n", HEAD_WORDS).select("word", "s").toArrow()
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(Lookup(top["word"], top["s"]))
    del top
    bits = None if expressions is None else context.broadcast(bit_map(expressions, "h"))
    lists = ("top", "missed", "seen")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        known, codes, none = shared.value, Codes(), np.zeros(0, np.int64)
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch, rows = whole.iloc[lo:lo + 512], []
                for text in batch["text"]:
                    words = words_of(text)
                    found = list(map(known.get, words))
                    missed = [w for w, s in zip(words, found) if s is None] if None in found else []
                    s = np.array([x for x in found if x is not None] if missed else found, float)
                    best = np.sort(np.partition(s, max(0, len(s) - 3))[-3:]) if len(s) else s
                    seen = none
                    if bits is not None:
                        hashes = np.concatenate(pairs_and_triples(codes.of(words)))
                        seen = hashes[passing(hashes, bits.value)].view(np.int64)
                    rows.append((len(words), s.sum(), s[s > 2].sum(), best, missed, seen))
                yield pd.DataFrame(rows, columns=["n", "sum", "telling", *lists]).assign(_k=batch["_k"].to_numpy())

    parts = written(texts.mapInPandas(look, "n long, sum double, telling double, top array<double>, missed array<binary>, seen array<bigint>, _k binary")
                    .withColumn("_n", F.monotonically_increasing_id()), "text-parts")
    shared.destroy()
    if bits is not None:
        bits.destroy()
    missed = parts.select("_n", F.explode("missed").alias("word")).join(scores.select("word", "s").hint("merge"), "word")
    more = missed.groupBy("_n").agg(F.sort_array(F.collect_list("s"), False).alias("more"))
    none = F.array().cast("array<double>")
    both = parts.drop("missed").join(more, "_n", "left").withColumn("more", F.coalesce("more", none))
    best = both.withColumn("best", F.slice(F.sort_array(F.concat("top", F.slice("more", 1, 3)), False), 1, 3)) \
        .withColumn("sum", F.col("sum") + _total(F.col("more"))).withColumn("telling", F.col("telling") + _total(F.filter("more", lambda x: x > 2)))
    some = lambda x: F.when(F.col("n") > 0, x).otherwise(0.0)
    wanted = ["_k", some(F.col("sum") / F.col("n")).alias("mean"), some(F.col("best")[0]).alias("most"),
              some(_total(F.col("best")) / F.size("best")).alias("top"), some(F.log1p(F.col("telling") / F.sqrt("n"))).alias("telling"),
              F.log1p(F.col("n").cast("double")).alias("words")]
    if expressions is not None:
        # equal expressions of a text are counted before they are joined
        seen = parts.select("_n", F.explode("seen").alias("h")).groupBy("_n", "h").agg(F.count(F.lit(1)).alias("times"))
        told = seen.join(expressions.select("h", "r").hint("merge"), "h").groupBy("_n").agg(
            F.sort_array(F.collect_list(F.struct("r", "times")), False).alias("told"))
        best = best.drop("seen").join(told, "_n", "left")
        summed = lambda least: F.aggregate(F.filter("told", lambda e: e["r"] > least), F.lit(0.0), lambda a, e: a + e["r"] * e["times"])
        some = lambda x: F.when(F.col("told").isNotNull(), x).otherwise(0.0)
        wanted += [some(summed(0.0) / F.col("n")).alias("phrase"), some(F.col("told")[0]["r"]).alias("strongest"),
                   some(F.log1p(summed(2.0) / F.sqrt("n"))).alias("expressions")]
    return best.select(*wanted).dropDuplicates(["_k"])


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant first) of a logistic curve, by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.r_[1e-3, np.full(len(w) - 1, penalty)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Labels are learnt from rows whose crc32(id as text) mod 4 is 0 or 1 (counts) and 3 (curve, at most
    ``CALIBRATION_ROWS``); 2 is held out.  Null labels teach nothing; of several labels of an id the largest counts.  Null and empty
    texts get the score of a text without words; a null id is not held out.  Without labels of both classes all scores
    are 0.  Columns named like the new ones are replaced.
    """
    told = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))))
    base = docs.drop("held_out", "score", "predicted", "_k").withColumn("_k", told)  # rows with one key have one text
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    taught = known.where(fold(F.col("_id")) != 2).hint("merge")  # one plan at every size
    texts = base.select(F.col(id_col).alias("_id"), "_k", F.col(text).cast("string").alias("text"))
    fold_of = fold(F.col("_id"))
    marked = written(texts.join(taught, "_id").select("_k", F.when(fold_of < 2, F.col("text")).alias("text"), "toxic", fold_of.alias("fold"),
                                                      F.xxhash64("_id").alias("draw")), "labelled")
    expressions = toxic_expressions(marked.where("fold < 2").select("text", "toxic"), words_of)
    grams = written(gram_counts(marked.where("fold < 2")), "letter-grams")
    words = written(word_counts(texts.select("text")), "words")
    scores = written(word_ratios(words, *gram_ratios(grams)), "word-ratios")
    names = ["mean", "most", "top", "telling", "words", "phrase", "strongest", "expressions"]
    features = written(text_features(texts.select("_k", "text"), scores, expressions), "text-features")
    sample = marked.where("fold = 3").orderBy("draw").limit(CALIBRATION_ROWS).select("_k", "draw", "toxic").join(features, "_k").toPandas()
    sample = sample.assign(_k=[bytes(k) for k in sample["_k"]]).sort_values(["draw", "_k"])
    x, y = sample[names].to_numpy(float), sample["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        mean, scale, w = fit_curve(x, y)
    else:
        counted = [r[0] for r in marked.where("fold < 2").select("toxic").distinct().collect()]
        # no rows for a curve: two telling words a text of fifty are even odds; without both classes nothing is toxic
        mean, scale, w = np.zeros(8), np.ones(8), np.array([-6.0, 0, 0.5, 0.5, 0.5, 0, 0, 0, 0]) if len(counted) == 2 else np.r_[-50.0, np.zeros(8)]
    found = base.join(features.select("_k", F.struct(*names).alias("_f")).hint("merge"), "_k", "left")
    line = F.lit(float(w[0]))
    for n, m, s, b in zip(names, mean, scale, w[1:]):
        line = line + (F.col(f"_f.{n}") - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(b))
    return found.withColumn("held_out", F.coalesce(fold(F.col(id_col)) == 2, F.lit(False))) \
        .withColumn("score", 1 / (1 + F.exp(-line))).drop("_f", "_k") \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
