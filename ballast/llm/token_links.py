"""Two tokenizers held against each other: where their tokens end together, and how often a pair of ids does so in the corpus.

A text is cut at blanks and line ends that follow another character; no token of either vocabulary reaches over such a place, so a piece
is aligned once and remembered.  Documents are numbered, and a task turns the links of a block of documents into one inverted bitmap per pair
of ids: plane 0 holds the documents with the pair, plane j >= 1 those whose further links of it have bit j - 1 set.  A bitmap is
written as the sorted places of its documents, or as bits where that is shorter.  Documents of a pair are the popcounts of plane 0,
links the weighted popcounts of all planes; blocks, and the parts that a large block is written in, hold different documents, so
OR-merging them adds their popcounts.  The pairs' scores then go back along the same postings to the documents.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.store import written
from ballast.llm.remember import claim
from ballast.llm.token_counts import _byte_letters

BLOCK = 1 << 13  # documents of a block
DENSE = BLOCK // 16  # from so many documents on, bits are shorter than places of two bytes
SHIFT = 20  # a pair is a * 2^20 + b
# Links of a block and characters of texts that are laid out at once, and pieces a worker remembers before it starts anew; all bound memory only.
LINKS, LAID_OUT, REMEMBERED = 3_000_000, 2_000_000, 400_000
# Blanks at either end or beside one another: such a text is cut by the slower rule.
ODD = re.compile(r"\A\s|\s\s|\s\Z")
CUT = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> list[str]:
    """The pieces of blank + text, without the blank that starts them; those that keep it were cut by the slower rule."""
    if ODD.search(text):
        return CUT.split(" " + text)
    return text.replace("\n", " \n").split(" ")


class Aligner:
    """Both vocabularies, and the alignment of the pieces met lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, size_a, size_b = {c: i for i, c in enumerate(_byte_letters())}, self.a.get_vocab_size(), self.b.get_piece_size()
        own = [self.a.id_to_token(i) for i in range(size_a)]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in own]
        own = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in own]
        self.blank = self.b.piece_to_id("▁")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = size_a, size_b
        if not self.length_a.all() or not self.length_b.all() or size_b > 1 << SHIFT:
            raise ValueError("tokens without bytes, or too many of them")
        # what an id adds to the groups' text: inside a group, or as the last of its side
        self.written = [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for mark in marks for i in range(size)]
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.texts: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # whether bytes agree, and the numbers of A tokens, B tokens and groups
        self.links, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)  # pairs, and where a piece's begin

    def learn(self, new: list[str]) -> None:
        whole = [w if w[0] in " \n" else " " + w for w in (w or " " for w in new)]
        ids_a = [e.ids for e in self.a.encode_batch(whole, add_special_tokens=False)]
        # B sets a blank before what it gets
        ids_b = self.b.encode([w if w[0] == "\n" else w[1:] for w in whole], num_threads=1)
        ids_b = [[self.blank] if w == " " else i[1:] if w[0] == "\n" and i[:1] == [self.blank] else i for w, i in zip(whole, ids_b)]
        raw = [w.encode("utf-8", "replace") for w in whole]
        agree = [b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b)) for r, a, b in zip(raw, ids_a, ids_b)]
        ids_a, ids_b = ([i if ok else [] for ok, i in zip(agree, ids)] for ids in (ids_a, ids_b))
        count_a, count_b = (np.array([len(i) for i in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([t for i in ids for t in i], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])  # bytes agree, so offsets run on from piece to piece
        common = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a, last_b = np.isin(end_a, common), np.isin(end_b, common)
        piece_end = np.cumsum([len(r) if ok else 0 for ok, r in zip(agree, raw)])
        groups = np.diff(np.r_[0, np.searchsorted(common, piece_end, "right")])
        codes = np.r_[a + self.size_a * last_a, 2 * self.size_a + b + self.size_b * last_b][np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")]
        cuts = np.r_[0, np.cumsum(count_a + count_b)].tolist()
        parts = list(map(self.written.__getitem__, codes.tolist()))
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.texts += ["".join(parts[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        self.facts = np.concatenate([self.facts, np.stack([np.array(agree, np.int64), count_a, count_b, groups], 1)])
        self.links = np.concatenate([self.links, (a[last_a] << SHIFT) + b[last_b]])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(groups)])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text its numbers (A tokens, B tokens, groups) and its groups as text, and of all their links the text's place and the pair.

        An empty text, or one whose bytes one of the vocabularies does not keep, has no tokens.
        """
        claim(self.known)
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [pieces(t) if t and "▁" not in t else [] for t in texts]
        new: set[str] = set()
        for found in cut:
            new.update(found)
        new -= self.known.keys()
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(c) for c in cut], np.int64)
        at = np.fromiter((self.known[w] for c in cut for w in c), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        agree = np.bincount(doc[self.facts[at, 0] == 0], minlength=len(texts)) == 0
        at, doc = at[agree[doc]], doc[agree[doc]]
        sums = np.zeros((len(texts), 3), np.int64)
        np.add.at(sums, doc, self.facts[at, 1:])
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        listed = at.tolist()
        groups = ["".join(map(self.texts.__getitem__, listed[lo:hi]))[:-1] for lo, hi in zip(cuts[:-1], cuts[1:])]
        count = self.facts[at, 3]
        place = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return sums, groups, np.repeat(doc, count), self.links[place]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _plane(pair: np.ndarray, doc: np.ndarray, plane: int) -> pa.Table:
    """(pair, plane, docs, n) of (pair, doc) in order."""
    first = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
    cuts = np.r_[first, len(pair)]
    size = np.diff(cuts)
    docs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((2 * cuts).astype("<i4").tobytes()), pa.py_buffer(doc.astype("<u2").tobytes())])
    dense = np.flatnonzero(size >= DENSE)
    if len(dense):
        values = docs.to_pylist()
        for i in dense.tolist():
            bits = np.zeros(BLOCK, np.uint8)
            bits[doc[cuts[i]:cuts[i + 1]]] = 1
            values[i] = np.packbits(bits).tobytes()
        docs = pa.array(values, pa.binary())
    return pa.table({"pair": pair[first], "plane": np.full(len(first), plane, np.int32), "docs": docs, "n": size})


def bitmaps(pair: np.ndarray, doc: np.ndarray) -> pa.Table:
    """(pair, plane, docs, n) of links of one block, in any order; ``doc`` is a document's place in the block, n a bitmap's popcount."""
    key, times = np.unique(pair * BLOCK + doc, return_counts=True)
    pair, doc, more = key // BLOCK, key % BLOCK, times - 1
    planes = [_plane(pair, doc, 0)]
    for plane in range(1, int(more.max()).bit_length() + 1):
        bit = ((more >> (plane - 1)) & 1) == 1
        if bit.any():
            planes.append(_plane(pair[bit], doc[bit], plane))
    return pa.concat_tables(planes)


def places(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, document's place) of every document of a list of bitmaps."""
    dense = [i for i, d in enumerate(docs) if len(d) == BLOCK // 8]
    sparse = [b"" if len(d) == BLOCK // 8 else d for d in docs]
    which = [np.repeat(np.arange(len(docs)), [len(d) // 2 for d in sparse])]
    found = [np.frombuffer(b"".join(sparse), "<u2").astype(np.int64)]
    for i in dense:
        found.append(np.flatnonzero(np.unpackbits(np.frombuffer(docs[i], np.uint8))))
        which.append(np.full(len(found[-1]), i))
    return np.concatenate(which), np.concatenate(found)


# Rows of documents have no pair, rows of bitmaps have their block's number and no id.
_ROWS = pa.schema([("num", pa.int64()), ("id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups", pa.string()), ("pair", pa.int64()), ("plane", pa.int32()), ("docs", pa.binary()), ("n", pa.int64())])


def _rows(columns: dict, count: int) -> Iterator[pa.RecordBatch]:
    yield from pa.table([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in _ROWS], schema=_ROWS).to_batches(20_000)


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool, text: str, id_col: str) -> DataFrame:
    """A written table of both kinds of rows, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, block, held, count = aligner(path_a, path_b), -1, [], 0

        def postings() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if count:
                found = bitmaps(np.concatenate([p for p, _ in held]), np.concatenate([d for _, d in held]))
                yield from _rows({"num": pa.array(np.full(len(found), block)), **{c: found[c].combine_chunks() for c in found.column_names}}, len(found))
            held, count = [], 0

        for batch in batches:
            nums, texts = np.asarray(batch.column("num"), np.int64), [t or "" for t in batch.column("text").to_pylist()]
            lo = chars = 0
            for i, value in enumerate(texts, 1):
                chars += len(value)
                if chars < LAID_OUT and i < len(texts) and nums[i] // BLOCK == nums[lo] // BLOCK:
                    continue
                if nums[lo] // BLOCK != block:
                    yield from postings()
                    block = int(nums[lo] // BLOCK)
                sums, groups, doc, pair = tool.align(texts[lo:i])
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups
                yield from _rows({"num": pa.array(nums[lo:i]), "id": batch.column("id").slice(lo, i - lo), "n_a": pa.array(sums[:, 0]), "n_b": pa.array(sums[:, 1]), "n_groups": pa.array(sums[:, 2]),
                                  "n_links": pa.array(np.bincount(doc, minlength=i - lo)), "groups": pa.array(groups, pa.string())}, i - lo)
                held.append((pair, nums[lo:i][doc] % BLOCK))
                count += len(pair)
                if count >= LINKS:
                    yield from postings()
                lo, chars = i, 0
        yield from postings()

    known = docs.select(F.monotonically_increasing_id().alias("num"), F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return written(known.mapInArrow(run, "num long, id string, n_a long, n_b long, n_groups long, n_links long, groups string, pair long, plane int, docs binary, n long"), "aligned")


#: Links that a document of a bitmap stands for.
WEIGHT = "shiftleft(1L, greatest(plane - 1, 0))"


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links): in how many documents, and how often in all, tokens of both ids end together."""
    counts = rows.where("pair is not null").groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(F.col("n") * F.expr(WEIGHT)).alias("links"))
    return written(counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "docs", "links"), "pair-counts")


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per document of the scores of its pairs; rows come sorted by block, which may go on in the next batch."""
    block, best, total = -1, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

    def sums() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at), pa.array(best[at]), pa.array(total[at])], ["num", "n_best", "count_sum"])

    for batch in batches:
        blocks, plane, links = (np.asarray(batch.column(c), np.int64) for c in ("block", "plane", "links"))
        top, docs = np.asarray(batch.column("best").cast(pa.int64()), np.int64), batch.column("docs").to_pylist()
        weight = np.int64(1) << np.maximum(plane - 1, 0)
        cuts = np.flatnonzero(np.r_[True, np.diff(blocks) != 0, True]) if len(blocks) else np.zeros(0, int)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if blocks[lo] != block:
                yield sums()
                block = int(blocks[lo])
                best[:], total[:] = 0, 0
            row, place = places(docs[lo:hi])
            np.add.at(best, place, (weight * top)[lo + row])
            np.add.at(total, place, (weight * links)[lo + row])
    yield sums()


def token_links(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """How texts' tokens under a byte-level BPE file (A) and a sentencepiece model (B) end together, and the table of :func:`pair_counts`.

    The first table has a row per document: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups).  Byte offsets at which tokens of
    both end cut a text into groups, written `a1,a2|b1;a3|b2,b3`, or as the SHA-256 of that with ``digest``.  A link is a pair of tokens that end
    together; its count is that of its ids in the whole corpus, and it is best if no other A id has a higher count with its B id.
    A null or empty text, or one whose bytes a vocabulary does not keep, has no tokens: zeros and ''.  Blanks count as text.  Rows are
    documents of their own, whatever their ids; repeated rows count as often as they occur.  An empty table gives empty tables; other columns are left aside.
    """
    rows = aligned(docs, path_a, path_b, digest, text, id_col)
    counts = pair_counts(rows)
    scores = counts.join(counts.groupBy("b").agg(F.max("links").alias("most")), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    postings = rows.where("pair is not null").select(F.col("num").alias("block"), "pair", "plane", "docs")
    scored = postings.join(scores, "pair").select("block", "plane", "docs", "links", "best")
    back = scored.repartition("block").sortWithinPartitions("block").mapInArrow(_give_back, "num long, n_best long, count_sum long")
    found = rows.where("pair is null").join(back, "num", "left")
    per_doc = found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", "n_links",
                           *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups")
    return per_doc, counts.select("a", "b", "docs", "links")
