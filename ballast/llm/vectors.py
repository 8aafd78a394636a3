"""Shared by the vector operators: which vectors count, bounded samples and their cells."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sample that cells are fitted to holds at most so many numbers (rows times dimensions); a bound of the index
# alone, every vector is assigned.
SAMPLE_VALUES = 2_000_000


def usable(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    big = F.lit(float("inf"))
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(odd, F.lit(True))


def as_matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))


def bounded_sample(vectors: DataFrame, vec: str, key: str, most_rows: int) -> np.ndarray:
    """At most ``most_rows`` vectors, those with the smallest hash of their key; shorter ones are filled up with zeros."""
    width = vectors.agg(F.max(F.size(vec))).first()[0] or 0
    rows = max(1, min(most_rows, SAMPLE_VALUES // max(1, width)))
    taken = vectors.select(vec, F.xxhash64(F.lit(42), key).alias("_h"), key).orderBy("_h", key).limit(rows).collect()
    out = np.zeros((len(taken), width))
    for i, r in enumerate(taken):
        out[i, :len(r[vec])] = r[vec]
    return out


def fit_cells(sample: np.ndarray, cells: int, spherical: bool, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` groups of a sample by k-means; unit vectors and cosines if spherical."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(42).permutation(len(centres))[:cells]].copy()
    for _ in range(rounds if len(centres) > 1 else 0):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centres))
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if spherical:
            norm = np.linalg.norm(centres, axis=1)
            centres[norm > 0] /= norm[norm > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """The centre nearest to each row; for unit centres that of the largest cosine."""
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([(rows[lo:lo + step] @ centres.T - half).argmax(1) for lo in range(0, len(rows), step)] or [np.zeros(0, int)])
