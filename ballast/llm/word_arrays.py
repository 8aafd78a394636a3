"""Words of whole Arrow batches as arrays: where they begin and end in the batch's bytes, and hashes of words and of windows of words."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LONG = 256  # bytes from which a word is hashed on its own
STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i lies at bytes[offsets[i]:offsets[i + 1]]; the column holds no nulls."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    cuts = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8, int(cuts[-1] - cuts[0]), int(cuts[0])) if data is not None and len(cuts) else np.zeros(0, np.uint8)
    return held, cuts - cuts[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word; words end at ASCII white space (\\x20, \\x09-\\x0D) and with their text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text begins or ends here
    opens = inside & np.r_[True, ~inside[:-1] | edge[1:-1]]
    closes = inside & np.r_[~inside[1:] | edge[1:-1], True]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(offsets, start, "right") - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time over all words that still have some."""
    size = end - start
    h = _mixed(size.astype(np.uint64) * STEP + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    open_, k = np.flatnonzero(size <= LONG), 0
    while len(open_):
        left = size[open_] - k
        piece = eight[start[open_] + k]
        cut = np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        piece = (piece << cut) >> cut
        h[open_] = _mixed((h[open_] ^ _mixed(piece + STEP)) * STEP)
        open_, k = open_[left > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes(), seed)
    return h


def hash_windows(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on."""
    h = np.full(len(at), np.uint64(width))
    for k in range(width):
        h = (h + words[at + k]) * STEP
        h ^= h >> np.uint64(29)
    return h
