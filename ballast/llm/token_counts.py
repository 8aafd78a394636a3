"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern.  The distinct pre-tokens of a batch that
this worker has not met lately are laid out as one ragged numpy array of symbols.  In every round
each sequence finds its lowest-ranked pair and merges all its places at once; sequences without a
pair leave, and what is left of a sequence is its token count.  Merging all places of one rank at
once equals merging them one by one, as a pair that holds a new symbol always ranks below it.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.remember import claim

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = np.iinfo(np.int32).max
# Pre-tokens a worker remembers before it starts anew, and characters laid out at once; both bound memory only.
REMEMBERED = 1_000_000
LAID_OUT = 2_000_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Merge table of a vocabulary file and the counts of the pre-tokens met lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cut = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def merged_lengths(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token after all merges."""
        raw = [t.encode("utf-8", "replace") for t in tokens]
        lengths = np.array([len(r) for r in raw], np.int64)
        out = lengths.copy()
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), lengths)
        rank = np.full(len(sym), NO_PAIR, np.int32)
        same = np.flatnonzero(seq[1:] == seq[:-1])
        rank[same] = self.rank(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[first, len(seq)])
            lowest = np.minimum.reduceat(rank, first)
            out[seq[first]] = size
            if (lowest == NO_PAIR).any():  # those sequences are done
                stay = np.repeat(lowest != NO_PAIR, size)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                if not len(sym):
                    break
                size, lowest = size[lowest != NO_PAIR], lowest[lowest != NO_PAIR]
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            # in a run of overlapping places (a a a) every other one merges, from the left
            begins = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = (np.cumsum(keep) - 1)[hit]
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            touched = np.concatenate([place, place[place > 0] - 1])
            rank[touched] = NO_PAIR
            touched = touched[touched + 1 < len(sym)]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        return out

    def learn(self, tokens: set[str]) -> None:
        batch, laid = [], 0
        for t in tokens:
            batch.append(t)
            laid += len(t)
            if laid >= LAID_OUT:
                self.known.update(zip(batch, self.merged_lengths(batch).tolist()))
                batch, laid = [], 0
        if batch:
            self.known.update(zip(batch, self.merged_lengths(batch).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of a batch: what is new in all its texts is merged in one go."""
        claim(self.known)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = [self.split.split(t) if self.split else [t] for t in texts]
        tokens = [[t for part in cut for t in self.cut.findall(part)] if len(cut) > 1 else self.cut.findall(cut[0]) for cut in parts]
        new: set[str] = set()
        for found in tokens:
            new.update(found)
        self.learn(new - self.known.keys())
        # each special string between two parts is one token
        return [sum(map(self.known.__getitem__, found)) + len(cut) - 1 for found, cut in zip(tokens, parts)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text (null counts as empty), as the vocabulary's own library gives them."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for texts in batches:
            out: list[int] = []
            for lo in range(0, len(texts), 64):
                out += bpe.counts(texts.iloc[lo:lo + 64].tolist())
            yield pd.Series(out, dtype="int64")

    return count(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; other columns are left aside.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit.  Repeated ids keep a row each.
    """
    found = docs.select(F.col(id_col), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                        token_count(F.col(text), path).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
