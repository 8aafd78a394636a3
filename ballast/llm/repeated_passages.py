"""Words of passages that a document with a smaller id holds as well, found by difference-cover anchors.

A passage is a window of ``width`` consecutive words.  The residues of a difference cover modulo ``PERIOD`` contain, for any two
places, two residues at the same distance: of two equal windows at any places of two documents, at least one word offset below
PERIOD is a cover place in both.  So it is enough to hash the shorter windows of ``width - PERIOD + 1`` words at cover places (three
out of seven): equal windows share such an anchor.  Anchors of all documents are dealt to buckets by hash; what is alone there
is done with.  Around the anchors that several documents hold the windows are extended to full width, and those again are dealt to
buckets by 96-bit hash, where every document but the one with the smallest id learns that it repeats.

No task holds a group: a batch sends an anchor or window once, however many of its documents hold it, and settles those itself; what
a bucket receives of one passage is eight or 28 bytes for each batch.  What documents learn returns to them as marks, packed for a
stretch of documents at a time.  Equal texts count as anchors and windows like others, but only
the one of smallest id is extended: its copies go whole.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.bounds import shuffle_width
from ballast.functions.ranks import ranked
from ballast.functions.store import written
from ballast.llm.word_arrays import find_words, hash_windows, hash_words, text_bytes

PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 is one of two residues of the cover
AT_ONCE = 4_000_000  # bytes of texts that are worked on at once, and so many documents at most
SEVERAL = (1 << 16) - 1  # stands for the documents of a batch if several hold an anchor
ANCHORS, WINDOWS = 4_000_000, 1_500_000  # so many of them a bucket, about; bounds a task's memory
STRETCH = 1024  # documents whose marks travel together
MARK = np.dtype([("low", "<u2"), ("hash", "<u8")])  # a document's place in its stretch, and an anchor or window of it
WINDOW = np.dtype([("high", "<u8"), ("low", "<u4"), ("num", "<i8"), ("place", "<i8")])  # what a batch says of a window
MASK48 = np.uint64((1 << 48) - 1)


def _slices(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Values as bytes by key."""
    if not len(keys):
        return keys[:0], []
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
    return keys[cuts[:-1]], [values[lo:hi].tobytes() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded bytes and documents."""
    _, offsets = text_bytes(batch.column(text))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + AT_ONCE, "right")) - 1)
        hi = min(hi, lo + SEVERAL, len(batch))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _by_bucket(batches: Iterator[pa.RecordBatch], settle: Callable, passed: Callable) -> Iterator[pa.RecordBatch]:
    """``settle(numbers, entries)`` of every bucket's rows, which come sorted by bucket; rows without entries go to ``passed``."""
    bucket, nums, held = -1, [], []
    for batch in batches:
        yield from passed(batch.filter(pa.compute.is_null(batch.column("entries"))))
        batch = batch.filter(pa.compute.is_valid(batch.column("entries")))
        for b, num, entries in zip(batch.column("bucket").to_pylist(), batch.column("num").to_pylist(), batch.column("entries").to_pylist()):
            if b != bucket:
                if held:
                    yield from settle(nums, held)
                bucket, nums, held = b, [], []
            nums.append(num)
            held.append(entries)
    if held:
        yield from settle(nums, held)


def _tables(schema: pa.Schema, columns: dict, count: int) -> Iterator[pa.RecordBatch]:
    if count:
        yield from pa.table([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema).to_batches(10_000)


def _marks(schema: pa.Schema, nums: np.ndarray, hashes: np.ndarray, buckets: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (num: the stretch, marks) that say which hashes concern which documents."""
    marks = np.zeros(len(nums), MARK)
    marks["low"], marks["hash"] = nums % STRETCH, hashes
    keys, values = _slices(nums // STRETCH, marks)
    columns = {"num": pa.array(keys, pa.int64()), "marks": pa.array(values, pa.binary()), "bucket": pa.array(keys % buckets, pa.int32())}
    yield from _tables(schema, columns, len(keys))


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(num, marks) of every document, from rows sorted by stretch, which may go on in the next batch."""
    stretch, held = -1, []

    def documents() -> pa.RecordBatch:
        marks = np.frombuffer(b"".join(held), MARK)
        keys, values = _slices(marks["low"], marks["hash"])
        return pa.RecordBatch.from_arrays([pa.array(stretch * STRETCH + keys.astype(np.int64)), pa.array(values, pa.binary())], ["num", "marks"])

    for batch in batches:
        for s, marks in zip(batch.column("num").to_pylist(), batch.column("marks").to_pylist()):
            if s != stretch:
                yield documents()
                stretch, held = s, []
            held.append(marks)
    yield documents()


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.select("num", "marks").repartition("num").sortWithinPartitions("num").mapInArrow(_per_document, "num long, marks binary")


# ---------------------------------------------------------------- anchors

_DEALT = pa.schema([("bucket", pa.int32()), ("num", pa.int64()), ("id", pa.string()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()),
                    ("marks", pa.binary()), ("entries", pa.binary())])
_FACTS = pa.schema([f for f in _DEALT if f.name not in ("bucket", "entries")])
_DDL = "num long, id string, d1 long, d2 long, n_words long, kept string, marks binary"


def anchors(words: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, 48-bit hash) of the windows of ``length`` words at cover places; text k has the words first[k]..first[k] + size[k]."""
    n = np.maximum(size - length + 1, 0)
    begin = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(begin, n)
    at = (np.repeat(first, n) + inner)[np.isin(inner % PERIOD, COVER)]
    return at, hash_windows(words, at, length) >> np.uint64(16)


def _anchor_rows(buckets: int, width: int, digest: bool) -> Callable:
    length = width - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, "text")):
            data, offsets = text_bytes(part.column("text"))
            start, end, text = find_words(data, offsets)
            size = np.bincount(text, minlength=len(part))
            nums = np.asarray(part.column("num"), np.int64)
            kept = [b" ".join(data[lo:hi].tobytes().split()) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            kept = [hashlib.sha256(k).hexdigest() if digest else k.decode("utf-8", "replace") for k in kept]
            yield from _tables(_DEALT, {"bucket": pa.array(nums % buckets, pa.int32()), "n_words": pa.array(size, pa.int64()), "kept": pa.array(kept, pa.string()),
                                        **{c: part.column(c) for c in ("num", "id", "d1", "d2")}}, len(part))
            compared = np.asarray(part.column("id").is_valid()) & (size >= width)  # a text of fewer words has no window
            at, hash_ = anchors(hash_words(data, start, end), np.cumsum(size) - size, np.where(compared, size, 0), length)
            key = np.unique((hash_ << np.uint64(16)) | text[at].astype(np.uint64))
            hash_, owner = key >> np.uint64(16), (key & np.uint64(SEVERAL)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, hash_[1:] != hash_[:-1]]) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(key)])
            shared = np.repeat(count > 1, count)
            yield from _marks(_DEALT, nums[owner[shared]], hash_[shared], buckets)
            entries = np.where(count > 1, key[first] | np.uint64(SEVERAL), key[first])
            bucket = ((hash_[first] >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            keys, values = _slices(bucket, entries)
            yield from _tables(_DEALT, {"bucket": pa.array(keys, pa.int32()), "num": pa.array(np.full(len(keys), nums[0])), "entries": pa.array(values, pa.binary())}, len(keys))

    return run


def _settle_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks for the documents whose anchors other batches hold as well, next to the rows that only pass through."""

    def settle(nums: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries = np.frombuffer(b"".join(held), "<u8")
        batch = np.repeat(np.array(nums, np.int64), [len(h) // 8 for h in held])
        order = np.argsort(entries, kind="stable")
        entries, batch = entries[order], batch[order]
        hash_, owner = entries >> np.uint64(16), (entries & np.uint64(SEVERAL)).astype(np.int64)
        same = hash_[1:] == hash_[:-1]
        hit = (np.r_[same, False] | np.r_[False, same]) & (owner != SEVERAL)
        yield from _marks(_FACTS, (batch + owner)[hit], hash_[hit])

    yield from _by_bucket(batches, settle, lambda rows: [rows.select(_FACTS.names)] if len(rows) else [])


# ---------------------------------------------------------------- windows

_WINDOWS = pa.schema([("bucket", pa.int32()), ("num", pa.int64()), ("marks", pa.binary()), ("entries", pa.binary())])
_MARKS = pa.schema([("num", pa.int64()), ("marks", pa.binary())])


def _hashes(marks: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(m, "<u8") for m in marks.to_pylist()]


def _window_rows(buckets: int, width: int) -> Callable:
    length = width - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, "text")):
            data, offsets = text_bytes(part.column("text"))
            start, end, text = find_words(data, offsets)
            size = np.bincount(text, minlength=len(part))
            first = np.cumsum(size) - size
            words = hash_words(data, start, end)
            at, hash_ = anchors(words, first, size, length)
            cuts = np.searchsorted(text[at], np.arange(len(part) + 1)).tolist()
            shared = np.concatenate([np.isin(hash_[lo:hi], m) for lo, hi, m in zip(cuts[:-1], cuts[1:], _hashes(part.column("marks")))])
            wanted = np.zeros(len(words) + PERIOD, bool)
            for k in range(PERIOD):  # the window's words around the anchor
                wanted[at[shared] - k] = True  # a place before the array wraps to its spare end
            begin = np.flatnonzero(wanted[:len(words)])
            begin = begin[begin + width <= (first + size)[text[begin]]]
            rows = np.zeros(len(begin), WINDOW)
            rows["high"] = hash_windows(words, begin, width)
            rows["low"] = (hash_windows(hash_words(data, start, end, 1), begin, width) >> np.uint64(32)).astype(np.uint32)
            rows["num"] = np.asarray(part.column("num"), np.int64)[text[begin]]
            rows["place"] = np.asarray(part.column("place"), np.int64)[text[begin]]
            rows = rows[np.lexsort((rows["num"], rows["place"], rows["low"], rows["high"]))]
            if len(rows):  # a document says a window once
                rows = rows[np.r_[True, (rows["high"][1:] != rows["high"][:-1]) | (rows["low"][1:] != rows["low"][:-1]) | (rows["num"][1:] != rows["num"][:-1])]]
            later = _later(rows)
            yield from _marks(_WINDOWS, rows["num"][later], rows["high"][later], buckets)
            rows = rows[~later]
            keys, values = _slices((rows["high"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), rows)
            yield from _tables(_WINDOWS, {"bucket": pa.array(keys.astype(np.int32)), "num": pa.array(np.zeros(len(keys), np.int64)), "entries": pa.array(values, pa.binary())}, len(keys))

    return run


def _later(rows: np.ndarray) -> np.ndarray:
    """Of windows sorted by hash and place, those that a smaller place holds as well."""
    if not len(rows):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, (rows["high"][1:] != rows["high"][:-1]) | (rows["low"][1:] != rows["low"][:-1])])
    return rows["place"] > np.repeat(rows["place"][first], np.diff(np.r_[first, len(rows)]))


def _settle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def settle(nums: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(held), WINDOW)
        rows = rows[np.lexsort((rows["place"], rows["low"], rows["high"]))]
        later = _later(rows)
        yield from _marks(_MARKS, rows["num"][later], rows["high"][later])

    yield from _by_bucket(batches, settle, lambda rows: [rows.select(_MARKS.names)] if len(rows) else [])


def _cut_out(width: int, digest: bool) -> Callable:
    """Removes the words under the marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, "text")):
            data, offsets = text_bytes(part.column("text"))
            start, end, text = find_words(data, offsets)
            size = np.bincount(text, minlength=len(part))
            first, words = np.cumsum(size) - size, hash_words(data, start, end)
            removed, kept = [], []
            for k, marks in enumerate(_hashes(part.column("marks"))):
                lo, n = int(first[k]), int(size[k])
                hit = np.isin(hash_windows(words, np.arange(lo, lo + n - width + 1), width), marks)
                edges = np.zeros(n + 1, np.int64)
                edges[:n - width + 1] += hit
                edges[width:] -= hit
                stays = np.cumsum(edges[:n]) == 0
                removed.append(n - int(stays.sum()))
                left = b" ".join(compress(data[offsets[k]:offsets[k + 1]].tobytes().split(), stays.tolist()))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column("num"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["num", "n_removed", "kept"])

    return run


def _buckets(table: DataFrame, amount: Column, each: int) -> int:
    """As many buckets as hold about ``each`` of the amount, and enough for all tasks of a shuffle."""
    total = table.agg(F.sum(amount)).first()[0] or 0
    return int(min(max(2 * shuffle_width(table), total // each + 1), 1 << 16))


def _places(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``place``, a number that rises with the id."""
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return df.withColumn("place", F.col(id_col).cast("long"))
    ids = ranked(written(df.select(id_col).where(F.col(id_col).isNotNull()).distinct(), "ids"), [], id_col, "place")
    return df.join(ids, id_col, "left")


def remove_repeats(docs: DataFrame, width: int = 13, digest: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: the words that stay, joined by one blank, or the SHA-256 of that with ``digest``.

    A word goes if a window of ``width`` consecutive words covers it whose words also stand in a document of smaller id; windows are those of
    the input.  Words end at ASCII white space.  A null, empty or blank text has no words; a text of fewer than ``width`` words
    stays whole.  Rows with one id are not smaller than one another, so repeated rows lose nothing to one another; a row with a
    null id stays whole and takes nothing from others.  An empty table gives an empty table; other columns are left aside.
    """
    if width < PERIOD:
        raise ValueError(f"windows of fewer than {PERIOD} words")
    kind = docs.schema[id_col].dataType
    known = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = known.withColumns({"id": F.col("_id").cast("string"), "d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    amount = F.octet_length("text") * len(COVER) / (6 * PERIOD)  # a word takes six bytes or so
    dealt = known.withColumn("num", F.monotonically_increasing_id()).select("num", "id", "d1", "d2", "text") \
        .mapInArrow(_anchor_rows(_buckets(known, amount, ANCHORS), width, digest), f"bucket int, {_DDL}, entries binary")
    rows = written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle_anchors, _DDL), "anchors")
    facts = _places(rows.where("d1 is not null").withColumn("_id", F.col("id").cast(kind)), "_id")

    # of equal texts the one of smallest id is looked into
    sites = written(facts.where("id is not null").groupBy("d1", "d2").agg(F.min(F.struct("place", "num", "id")).alias("s")).select("d1", "d2", "s.*"), "sites")
    marks = _gathered(rows.where("d1 is null"))
    texts = known.where("id is not null").select("d1", "d2", "id", "text")
    wanted = written(texts.join(sites.join(marks, "num"), ["d1", "d2", "id"]).select("num", "place", "text", "marks"), "wanted")
    amount = F.octet_length("marks") * PERIOD / (8 * len(COVER))
    windows = wanted.mapInArrow(_window_rows(_buckets(wanted, amount, WINDOWS), width), "bucket int, num long, marks binary, entries binary")
    repeats = windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle_windows, "num long, marks binary")
    repeats = _gathered(written(repeats, "repeats"))
    cut = wanted.drop("marks", "place").join(repeats, "num").mapInArrow(_cut_out(width, digest), "num long, n_removed long, kept string").dropDuplicates(["num"])
    changed = written(sites.join(cut, "num", "left").select("d1", "d2", F.col("place").alias("least"), "n_removed", F.col("kept").alias("left")), "changed")

    whole_copy = (F.col("place") > F.col("least")) & (F.col("n_words") >= width)
    nothing = hashlib.sha256(b"").hexdigest() if digest else ""
    own = (F.col("place") == F.col("least")) & F.col("n_removed").isNotNull()
    return facts.join(changed, ["d1", "d2"], "left").select(
        F.col("_id").alias(id_col), "n_words", F.when(whole_copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole_copy, nothing).when(own, F.col("left")).otherwise(F.col("kept")).alias("kept"))
