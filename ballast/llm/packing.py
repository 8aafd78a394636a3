"""Best-two-fit packing of whole documents into sequences of a fixed number of tokens.

Which pieces share a sequence depends on lengths alone, so the plan is made on the histogram of lengths, which has
at most ``capacity`` entries at any size of the corpus.  A sequence is filled greedily with the longest
pieces that fit; then its shortest piece gives way to two unpacked pieces that fill the gap better, if there are any;
the pattern is repeated as long as the histogram holds it.  A plan row says: the pieces of this length
with these ranks go to these sequences at this offset.  Ranks within a length are drawn in Spark.
"""
from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import collect_bounded
from ballast.functions.ranks import ranked
from ballast.functions.store import written
from ballast.llm.remember import claim

REMEMBERED = 600_000  # words a worker remembers with their ids before it starts anew; bounds memory only
PORTION = 4_000_000  # letters of the texts that are looked up together; bounds memory only
# Words whose characters stand alone under Unicode composition, and how the vocabulary cuts such words in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds:
    """Ids of whole texts, as four little-endian bytes each.

    Words between ASCII white space never share a token, so each is encoded once.  A word of plain letters, digits
    and signs is cut further, as the vocabulary cuts it; any other word is left to the library as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        vocab = self.encoder.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that the vocabulary cuts no further: encoded a hundred at a time and told apart by the ids that end a word."""
        lines = [" ".join(parts[lo:lo + 100]) for lo in range(0, len(parts), 100)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.encoder.encode_batch(lines, add_special_tokens=False)])
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(parts):
            return self._encode(parts)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: list[str]) -> None:
        """Ids of words that are not known yet."""
        plain, cores, tails, mixed, cuts, other = [], [], [], [], [], []
        for w in words:
            core = w.rstrip(",.:;?!")
            if core.isascii() and core.isalpha():  # ASCII letters, then perhaps a run of signs
                plain.append(w)
                cores.append(core.lower())
                tails.append(w[len(core):])
            elif PLAIN.fullmatch(w) and "<|" not in w:
                mixed.append(w)
                cuts.append(PARTS.findall(w.lower()))
            else:
                other.append(w)
        known, parts = self.known, self.parts
        parts[""] = b""
        new = list({*cores, *tails, *chain.from_iterable(cuts)} - parts.keys())
        for lo in range(0, len(new), 20_000):
            parts.update(zip(new[lo:lo + 20_000], self._encode_parts(new[lo:lo + 20_000])))
        known.update(zip(plain, map(add, map(parts.__getitem__, cores), map(parts.__getitem__, tails))))
        known.update(zip(mixed, [b"".join([parts[x] for x in cut]) for cut in cuts]))
        for lo in range(0, len(other), 20_000):
            known.update(zip(other[lo:lo + 20_000], self._encode(other[lo:lo + 20_000])))

    def ids(self, texts: list[str], end: int) -> Iterator[bytes]:
        """The ids of each text, then ``end``: the distinct words of all texts are looked up once, and their ids laid out by array."""
        claim(self.known, self.parts)
        if max(len(self.known), len(self.parts)) > REMEMBERED:
            self.known.clear()
            self.parts.clear()
        clean = pa.array([t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())
        split = pc.ascii_split_whitespace(clean)
        coded = pc.dictionary_encode(split.flatten())
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self.known
        self.learn([w for w in words if w and w not in known])  # an empty word stands before or after white space
        known[""] = b""
        found = list(map(known.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        each = size[code]
        stop = np.cumsum(each)
        raw = flat[np.repeat(begin[code] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        last = end.to_bytes(4, "little")
        at = np.concatenate([[0], stop])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for a, b in zip(at, at[1:]):
            yield raw[4 * a:4 * b] + last


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch, as many at a time as hold about ``PORTION`` letters, one at least."""
    group = np.cumsum(batch["text"].str.len().to_numpy(np.int64)) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.iloc[lo:hi]


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids): the token ids of each text, then ``end``, cut only beyond ``capacity``.

    ``ids`` is binary, four little-endian bytes an id.  A null text counts as empty and is one piece of length 1.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(path)
        for batch in batches:
            for some in _portions(batch):
                rows = []
                for key, ids in zip(some["id"], known.ids(some["text"].tolist(), end)):
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * at:4 * (at + capacity)]
                        rows.append((key, k, at, len(piece) // 4, piece))
                out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids"])
                out["id"] = pd.Series([r[0] for r in rows], dtype=some["id"].dtype if some["id"].dtype.kind != "f" else object)
                if some["id"].dtype.kind == "f":  # whole ids beside nulls
                    out["id"] = out["id"].map(lambda v: None if v != v else v)
                yield out

    return chosen.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def _pattern(counts: np.ndarray, lengths: list[int], capacity: int) -> list[int]:
    """Lengths of one sequence, longest first; ``lengths`` are those with a count, in increasing order."""
    gap, used, out = capacity, {}, []
    at = len(lengths) - 1
    while True:
        at = min(at, bisect_right(lengths, gap) - 1)
        if at < 0:
            break
        size = lengths[at]
        take = min(int(counts[size]) - used.get(size, 0), gap // size)
        if take > 0:
            out += [size] * take
            used[size] = used.get(size, 0) + take
            gap -= take * size
        at -= 1
    if gap and len(out) > 1:
        room = gap + out[-1]
        free = np.array([n for n in lengths[:bisect_left(lengths, room)] if counts[n] > used.get(n, 0)])
        if len(free):
            partner = np.searchsorted(free, room - free, "right") - 1
            # a length that is left once cannot be its own partner
            single = (partner == np.arange(len(free))) & np.array([counts[n] - used.get(int(n), 0) < 2 for n in free])
            partner = partner - single
            both = np.where(partner >= 0, free + free[partner], 0)
            best = int(both.argmax())
            if both[best] > out[-1]:
                out[-1:] = sorted((int(free[best]), int(free[partner[best]])), reverse=True)
    return out


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset); ranks and sequences count from 0."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    given, lengths, sequence, rows = np.zeros(capacity + 1, np.int64), [int(n) for n in np.flatnonzero(left)], 0, []
    while lengths:
        sizes = _pattern(left, lengths, capacity)
        need: dict[int, int] = {}
        for n in sizes:
            need[n] = need.get(n, 0) + 1
        times, offset = min(int(left[n]) // k for n, k in need.items()), 0
        for n in sizes:
            rows.append((n, int(given[n]), times, sequence, offset))
            given[n] += times
            offset += n
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del lengths[bisect_left(lengths, n)]
        sequence += times
    return np.array(rows, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"),
          seed: int = 42) -> DataFrame:
    """``pieces`` with sequence_id and offset.  Every length must lie in 1..capacity.

    The input is read three times: write it first.  ``order`` names columns that tell the pieces apart; rows
    equal in all of them may be swapped, which changes nothing but their places.
    """
    counts = {r[0]: r[1] for r in collect_bounded(pieces.groupBy(length).count(), "lengths", capacity)}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    rows = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shift = int(max(counts.values(), default=0)) + 1
    keys, size, first, sequence, offset = rows[:, 0] * shift + rows[:, 1], *(rows[:, k].copy() for k in (0, 1, 3, 4))

    @F.pandas_udf("sequence_id long, offset long")
    def at(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64) - 1
        k = np.searchsorted(keys, n * shift + r, "right") - 1
        assert (size[k] == n).all()
        return pd.DataFrame({"sequence_id": sequence[k] + r - first[k], "offset": offset[k]})

    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *order), 11) / F.lit(float(1 << 53))
    numbered = ranked(pieces.withColumn("_draw", draw), length, ["_draw", *order], "_rank", is_draw=True)
    return numbered.withColumn("_at", at(F.col(length), F.col("_rank"))).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", id_col: str = "doc_id",
         with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: (id, piece, start, length, ids, sequence_id, offset).

    Without ``with_ids`` the ids are replaced by ids_crc32, so that they need not be stored on the way.
    Nulls and empty texts are pieces of one token; repeated ids are packed each for itself; an empty table gives an
    empty table; columns other than id and text are left aside, whatever their names.
    """
    pieces = token_pieces(docs, path, capacity, end, text, id_col).withColumn("ids_crc32", F.crc32("ids"))
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    return place(pieces, capacity, "length", (id_col, "piece", "ids_crc32"))
