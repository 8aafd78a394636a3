"""Discretizers.  Every fit ends in a short list of cut points per column; transform is a projection."""
from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.bounds import BoundExceeded, collect_bounded, join_model
from ballast.functions.ranks import ranked, running_total
from ballast.functions.store import written
from ballast.operators.encode import column_stats, fit_one_hot
from ballast.operators.modes import Mode, active_modes, likeliest, mixture_1d, starting_points
from ballast.spec import refuse_stream

# Strategy names callers of the reference use.
STRATEGIES = ("bins-uni", "bins-q", "bins-k", "bins-bgm", "chi-merge", "caim")


def unpivoted(df: DataFrame, cols, *keep: str) -> DataFrame:
    """(keep..., column, value) with all columns below each other, nulls left out."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]) \
             .unpivot(list(keep), list(cols), "column", "value").where(F.col("value").isNotNull())


# ---------------------------------------------------------------- equal width

def uniform_cuts(df: DataFrame, cols, bins: dict[str, int]) -> dict[str, list[float]]:
    """Inner edges of equal-width bins between each column's minimum and maximum."""
    s = column_stats(df, cols)
    return {c: [] if s[c]["min"] == s[c]["max"] else
            [s[c]["min"] + (s[c]["max"] - s[c]["min"]) * i / bins[c] for i in range(1, bins[c])] for c in cols}


# ---------------------------------------------------------------- equal population

def exact_quantiles(df: DataFrame, cols, probs: dict[str, list[float]]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of all columns, exact at any size.

    Distinct values are counted once for all columns; running counts then show which value sits at
    each wanted position, so only the few wanted values leave the cluster.
    """
    refuse_stream(df, "exact_quantiles")
    counts = unpivoted(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "value-counts")
    place = running_total(counts, "column", "value", F.col("n"), "upto", size="rows")
    wanted = F.create_map(*[p for c in cols for p in (F.lit(c), F.array(*[F.lit(float(q)) for q in probs[c]]))])
    spot = F.col("prob") * (F.col("rows") - 1).cast("double")
    below, above = F.floor(spot), F.ceil(spot)
    first = F.col("upto") - F.col("n")
    hits = place.withColumn("_probs", F.filter(wanted[F.col("column")], lambda q: (
        (F.ceil(q * (F.col("rows") - 1).cast("double")) >= first) & (F.floor(q * (F.col("rows") - 1).cast("double")) < F.col("upto"))))) \
        .where(F.size("_probs") > 0).withColumn("prob", F.explode("_probs")) \
        .select("column", "prob", "value", spot.alias("spot"),
                ((below >= first) & (below < F.col("upto"))).alias("is_below"),
                ((above >= first) & (above < F.col("upto"))).alias("is_above"))
    low, high, at = {}, {}, {}
    for r in collect_bounded(hits, "quantiles"):
        key = (r["column"], r["prob"])
        at[key] = r["spot"]
        if r["is_below"]:
            low[key] = r["value"]
        if r["is_above"]:
            high[key] = r["value"]
    out = {}
    for c in cols:
        out[c] = []
        for q in probs[c]:
            k = (c, float(q))
            if k in low:
                part = at[k] - np.floor(at[k])
                out[c].append(float(low[k] + (high[k] - low[k]) * part))
    return out


def quantile_cuts(df: DataFrame, cols, bins: dict[str, int], exact: bool = True) -> dict[str, list[float]]:
    """Inner edges of equal-population bins; edges closer than 1e-8 are merged."""
    probs = {c: [i / bins[c] for i in range(bins[c] + 1)] for c in cols}
    if exact:
        edges = exact_quantiles(df, cols, probs)
    else:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs[c], 100_000).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        edges = {c: row[f"q{i}"] for i, c in enumerate(cols)}
    out = {}
    for c in cols:
        kept = edges[c][:1]
        for e in edges[c][1:]:
            if e - kept[-1] > 1e-8:
                kept.append(e)
        out[c] = kept[1:-1]
    return out


# ---------------------------------------------------------------- one-dimensional k-means

def _midpoints(centres: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def kmeans_cuts(df: DataFrame, cols, bins: dict[str, int], passes: int = 300) -> dict[str, list[float]]:
    """Edges midway between the centres of a one-dimensional k-means.

    Lloyd's iterations run on quantiles first, then over all rows (one aggregation for
    all columns per pass) until no centre moves, or for the published 300 ``passes``.
    """
    centres: dict[str, list[float]] = {}
    for c, (x, n) in starting_points(df, cols).items():
        k = min(bins[c], len(x))
        edges = np.linspace(x[0], x[-1], k + 1)
        m = (edges[1:] + edges[:-1]) / 2
        for _ in range(300):
            own = np.searchsorted((m[1:] + m[:-1]) / 2, x, side="right")
            w = np.bincount(own, n, k)
            new = np.where(w > 0, np.bincount(own, n * x, k) / np.maximum(w, 1e-300), m)
            if np.allclose(new, m, rtol=0, atol=1e-12 * max(1.0, abs(x[-1] - x[0]))):
                break
            m = np.sort(new)
        centres[c] = [float(v) for v in m]
    for _ in range(passes):
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            own = bin_code(x, _midpoints(centres[c]))
            aggs += [F.avg(F.when(own == j, x)).alias(f"m{i}_{j}") for j in range(len(centres[c]))]
        row = df.agg(*aggs).first()
        new = {c: sorted(centres[c][j] if row[f"m{i}_{j}"] is None else row[f"m{i}_{j}"] for j in range(len(centres[c])))
               for i, c in enumerate(cols)}
        still = all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for c in cols for a, b in zip(new[c], centres[c]))
        centres = new
        if still:
            break
    return {c: _midpoints(centres[c]) for c in cols}


# ---------------------------------------------------------------- class contingency

def contingency(df: DataFrame, cols, label: str) -> tuple[DataFrame, list]:
    """(column, value, counts): rows per class at each distinct value, as an array in class order.

    Rows are touched once; everything after works on this compressed table.
    """
    classes = sorted(r[0] for r in collect_bounded(
        df.where(F.col(label).isNotNull()).select(label).groupBy(label).count().select(label), "classes", 1000))
    long = unpivoted(df.where(F.col(label).isNotNull()), cols, label)
    per_value = long.groupBy("column", "value").agg(
        F.array(*[F.count(F.when(F.col(label) == F.lit(k), 1)) for k in classes]).alias("counts"))
    return per_value, classes


def chi_square(a: Column, b: Column) -> Column:
    """Chi-square of two adjacent class-count arrays; classes absent from both add nothing."""
    total_a = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    total_b = F.aggregate(b, F.lit(0.0), lambda s, v: s + v)
    n = total_a + total_b
    term = lambda x, y: F.when(x + y == 0, F.lit(0.0)).otherwise(
        F.pow(x - (x + y) * total_a / n, F.lit(2.0)) / ((x + y) * total_a / n)
        + F.pow(y - (x + y) * total_b / n, F.lit(2.0)) / ((x + y) * total_b / n))
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term), F.lit(0.0), lambda s, v: s + v)


def adjacent_chi_square(df: DataFrame, cols, label: str) -> DataFrame:
    """(column, value, next_value, chi2) for each pair of neighbouring distinct values.

    Values are cut into ranges, and each range also carries the first value of the next one, so
    that no task holds a whole column.
    """
    table, _ = contingency(df, cols, label)
    table = written(table, "contingency")
    place = written(running_total(table, "column", "value", F.lit(1).cast("long"), "place"), "places")
    left = place.select("column", "place", "value", "counts")
    right = place.select("column", (F.col("place") - 1).alias("place"), F.col("value").alias("next_value"), F.col("counts").alias("next_counts"))
    return left.join(right, ["column", "place"]) \
               .select("column", "value", "next_value", chi_square(F.col("counts"), F.col("next_counts")).alias("chi2"))


def pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chi-square of rows of ``a`` with rows of ``b`` (class counts), class after class, as :func:`_pair_score` adds it up."""
    a, b = a.astype(float), b.astype(float)
    sa, sb = _in_order(a), _in_order(b)
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        both = x + y
        ea, eb = both * sa / (sa + sb), both * sb / (sa + sb)
        with np.errstate(invalid="ignore", divide="ignore"):
            term = (x - ea) * (x - ea) / ea + (y - eb) * (y - eb) / eb
        out = out + np.where(both > 0, term, 0.0)
    return out


def _in_order(counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(counts))
    for x in counts.T:
        total = total + x
    return total


def _pair_score(a: list[float], b: list[float]) -> float:
    sa, sb, out = sum(a), sum(b), 0.0
    for x, y in zip(a, b):
        both = x + y
        if both > 0:
            ea, eb = both * sa / (sa + sb), both * sb / (sa + sb)
            out += (x - ea) * (x - ea) / ea + (y - eb) * (y - eb) / eb
    return out


def merge_intervals(counts: np.ndarray, k: int = 1, level: float = float("inf")) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Merge the adjacent pair of least chi-square (leftmost on ties) until k intervals are left or all pairs are above ``level``.

    Returns the places of the first members of what is left, their counts, and all counts that the first
    and the last interval had on the way.
    """
    n = len(counts)
    scores = pair_scores(counts[:-1], counts[1:])
    rows = counts.astype(float).tolist()
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive, version = np.ones(n, dtype=bool), [0] * n
    heap = [(s, i, 0) for i, s in enumerate(scores.tolist()) if s <= level]
    heapq.heapify(heap)
    remaining, last = n, n - 1
    firsts, lasts = [rows[0]], [rows[-1]]
    while remaining > k and heap:
        _, i, v = heapq.heappop(heap)
        if not alive[i] or version[i] != v or right[i] >= n:
            continue
        j = right[i]
        rows[i] = [x + y for x, y in zip(rows[i], rows[j])]
        alive[j] = False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        remaining -= 1
        if i == 0:
            firsts.append(rows[0])
        if j == last:
            last = i
            lasts.append(rows[i])
        for a in (left[i], i):
            if a >= 0 and right[a] < n:
                version[a] += 1
                score = _pair_score(rows[a], rows[right[a]])
                if score <= level:
                    heapq.heappush(heap, (score, a, version[a]))
    kept = np.flatnonzero(alive)
    return kept, np.array([rows[i] for i in kept]), firsts, lasts


PIECE = 20_000  # neighbouring intervals that are merged in one task
_CLOSED = "column STRING, piece LONG, start DOUBLE, counts ARRAY<LONG>, firsts ARRAY<ARRAY<DOUBLE>>, lasts ARRAY<ARRAY<DOUBLE>>"


@F.pandas_udf(T.DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), -1.0)  # the last interval of a column has no pair
    some = b.notna().to_numpy()
    if some.any():
        out[some] = pair_scores(np.vstack(a[some].to_numpy()), np.vstack(b[some].to_numpy()))
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def _meets(lasts: pd.Series, firsts: pd.Series, level: pd.Series) -> pd.Series:
    """Whether an interval at a border could have been merged across it, in any two states of its sides."""
    out = []
    for a, b, top in zip(lasts, firsts, level):
        x, y = np.vstack(a), np.vstack(b)
        out.append(any((pair_scores(np.repeat(x[i:i + 1], len(y), 0), y) <= top).any() for i in range(len(x))))
    return pd.Series(out)


def _closed(piece: pd.DataFrame) -> pd.DataFrame:
    piece = piece.sort_values("start")
    kept, counts, firsts, lasts = merge_intervals(np.vstack(piece["counts"].to_numpy()), level=piece["level"].iloc[0])
    none = [None] * (len(kept) - 1)
    return pd.DataFrame({"column": piece["column"].iloc[0], "piece": piece["piece"].iloc[0], "start": piece["start"].to_numpy()[kept],
                         "counts": list(counts.astype(np.int64)), "firsts": [firsts, *none], "lasts": [lasts, *none]})


def _merged_below(table: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, dict[str, bool]]:
    """``table`` (column, start, counts) after all merges that come before every pair is above the column's level.

    The level is that share's quantile of the column's scores.  A column is cut into pieces, each at the largest of
    some thousand scores, and pieces are merged alone.  What a piece does depends on the others only by its
    borders; where the counts on both sides of a border ever gave a score up to the level, the two pieces are joined
    and merged again.  The second result says whether a level is the least score, which cannot be lowered.
    """
    place = written(running_total(table, "column", "start", F.lit(1).cast("long"), "place"), "places")
    after = place.select("column", (F.col("place") - 1).alias("place"), F.col("counts").alias("next"))
    scored = written(place.join(after, ["column", "place"], "left").withColumn("score", _score("counts", "next"))
                     .drop("next").withColumn("stretch", F.floor(F.col("place") / PIECE)), "scores")
    pairs = scored.where("score >= 0").groupBy("column").agg(
        F.min("score").alias("least"), F.percentile_approx("score", [1 / 2 ** i for i in range(1, 21)], 10_000).alias("q"))
    levels = {r["column"]: (max(r["least"], r["q"][round(-np.log2(shares[r["column"]])) - 1]), r["least"]) for r in pairs.collect()}
    level = F.create_map(*[v for c, (top, _) in levels.items() for v in (F.lit(c), F.lit(top))])[F.col("column")]
    borders = scored.groupBy("column", "stretch").agg(F.max_by("place", F.struct("score", "place")).alias("border"))
    dealt = written(scored.join(borders, ["column", "stretch"]).select(
        "column", "start", "counts", level.alias("level"), (F.col("stretch") + (F.col("place") > F.col("border")).cast("long")).alias("piece")), "pieces")
    while True:
        closed = written(dealt.groupBy("column", "piece").applyInPandas(_closed, _CLOSED), "merged")
        ends = closed.where("firsts is not null")
        order = ranked(ends.select("column", "piece", "firsts", "lasts"), "column", "piece", "nth")
        order = written(order, "ends")
        met = order.select("column", "piece", (F.col("nth") + 1).alias("nth"), "lasts").join(
            order.select("column", "nth", F.col("piece").alias("right"), "firsts"), ["column", "nth"])
        joined = collect_bounded(met.where(_meets("lasts", "firsts", level)).select("column", "piece", "right"), "borders")
        if not joined:
            return closed.select("column", "start", "counts"), {c: top <= least for c, (top, least) in levels.items()}
        into: dict[tuple[str, int], int] = {}
        for r in sorted(joined):  # from the left, so that a chain of pieces gets the number of its first
            into[r["column"], r["right"]] = into.get((r["column"], r["piece"]), r["piece"])
        moved = dealt.sparkSession.createDataFrame([(c, p, q) for (c, p), q in into.items()], "column STRING, piece LONG, into LONG")
        dealt = written(join_model(dealt, moved, ["column", "piece"], "left").withColumn("piece", F.coalesce("into", "piece")).drop("into"), "pieces")


def _merged_down(start: DataFrame, bins: dict[str, int]) -> DataFrame:
    """``start`` (column, start, counts) merged level by level while a column has more intervals than one task should hold.

    A level that would leave fewer intervals than wanted is not taken but tried again lower; where the least one already
    does, a single chain of merges leads from there to the end and the column stays as it is.
    """
    sizes = lambda df: {r["column"]: r["count"] for r in df.groupBy("column").count().collect()}
    done, size = None, sizes(start)
    shares = {c: 0.5 for c, n in size.items() if n > max(PIECE, 2 * bins[c])}
    table = start
    while shares:
        rest = table.where(~F.col("column").isin(list(shares)))
        done = rest if done is None else done.unionByName(rest)
        table = table.where(F.col("column").isin(list(shares)))
        merged, least = _merged_below(table, shares)
        left = sizes(merged)
        good = [c for c in shares if left[c] >= bins[c]]
        table = written(merged.where(F.col("column").isin(good)).unionByName(table.where(~F.col("column").isin(good))), "intervals")
        shares = {c: shares[c] if c in good else shares[c] / 2 for c in shares
                  if (left[c] > max(PIECE, 2 * bins[c]) if c in good else not least[c] and shares[c] > 2 ** -20)}
    return table if done is None else done.unionByName(table)


def chi_merge_cuts(df: DataFrame, cols, label: str, bins: dict[str, int], start_intervals: int | None = None,
                   max_runs: int = 5_000_000) -> dict[str, list[float]]:
    """ChiMerge: start from distinct values, merge the least chi-square pair until k intervals.

    Neighbouring values that hold a single, equal class have chi-square zero, so they are merged in
    Spark first.  What is left of a column is cut into pieces of some thousand intervals that are merged apart, level by level, in
    the order that one heap over the column would take; the last ``PIECE`` intervals of a column go through one task.  With
    ``start_intervals`` every column begins from that many intervals of equal row count instead of its values,
    whatever its size.  Where one chain of merges runs through a whole column from above k to below, each
    merge waits for the one before: such a column is refused if it keeps more than ``max_runs`` intervals.
    """
    per_value, classes = contingency(df, cols, label)
    table = written(per_value, "contingency")
    distinct = {r["column"]: r["v"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("v")).collect()}
    large = [c for c in cols if c in distinct]
    if not large:
        return {c: [] for c in cols}
    rows = F.aggregate(F.col("counts"), F.lit(0).cast("long"), lambda s, v: s + v)
    big = running_total(table.where(F.col("column").isin(large)), "column", "value", rows, "upto", size="rows")
    pure = F.when(F.size(F.filter("counts", lambda v: v > 0)) == 1, F.array_position("counts", F.array_max("counts")))
    ordered = written(running_total(written(big.withColumn("pure", pure), "runs"), "column", "value", F.lit(1).cast("long"), "place"), "runs")
    previous = ordered.select("column", (F.col("place") + 1).alias("place"), F.col("pure").alias("before"))
    opened = written(ordered.join(previous, ["column", "place"], "left").withColumn(
        "opens", F.when(F.col("pure").isNotNull() & F.col("before").eqNullSafe(F.col("pure")), 0).otherwise(1)), "runs")
    # with fewer runs than wanted intervals, merging from the left stops early: the rightmost
    # values that would have been merged last stay apart
    numbers = {c: (distinct[c], bins[c]) for c in large}
    lookup = lambda i: F.create_map(*[v for c in large for v in (F.lit(c), F.lit(numbers[c][i]).cast("long"))])[F.col("column")]
    counted = running_total(opened, "column", "value", {"zero": (1 - F.col("opens")).cast("long")}, size="zeros")
    spare = lookup(1) - (lookup(0) - F.col("zeros"))
    apart = F.when((F.col("opens") == 0) & (F.col("zeros") - F.col("zero") < spare), 1).otherwise(F.col("opens"))
    runs = running_total(written(counted.withColumn("opens", apart), "runs"), "column", "value", F.col("opens").cast("long"), "run", size="runs")
    group = F.col("run")
    if start_intervals:
        group = F.floor((F.col("upto") - 1) / F.greatest(F.ceil(F.col("rows") / start_intervals), F.lit(1)))
    merged = runs.withColumn("group", group).groupBy("column", "group").agg(
        F.min("value").alias("start"),
        F.array(*[F.sum(F.col("counts")[i]) for i in range(len(classes))]).alias("counts"))
    start = _merged_down(written(merged.select("column", "start", "counts"), "intervals"), bins)
    most = start.groupBy("column").count().agg(F.max("count")).first()[0]
    if not start_intervals and most > max_runs:
        raise BoundExceeded(f"a column keeps {most} runs of values that only one chain of merges joins; give start_intervals")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        c = pdf["column"].iloc[0]
        kept = merge_intervals(np.vstack(pdf["counts"].to_numpy()), bins[c])[0]
        return pd.DataFrame({"column": c, "cut": pdf["start"].to_numpy(float)[kept]})

    out: dict[str, list[float]] = {c: [] for c in cols}
    for r in collect_bounded(start.groupBy("column").applyInPandas(merge, "column STRING, cut DOUBLE"), "intervals"):
        out[r["column"]].append(r["cut"])
    return {c: sorted(v)[1:] for c, v in out.items()}


# ---------------------------------------------------------------- CAIM

def caim_scores(cumulative: DataFrame, cuts: dict[str, list[float]], k: int) -> DataFrame:
    """(column, cut, score) for every distinct value tried as the next cut.

    The score of a scheme is the mean over its bins of (largest class count)^2 / rows.  Only the bin
    that holds the candidate changes, so running class counts give every score in one projection.
    """
    # per column: the class counts below each existing edge, looked up from the running counts
    edge_rows = collect_bounded(
        cumulative.where(F.coalesce(*[F.when((F.col("column") == c) & F.col("value").isin(v), True)
                                      for c, v in cuts.items() if v], F.lit(False)))
        .select("column", "value", *[f"below{i}" for i in range(k)]), "cuts") if any(cuts.values()) else []
    edges = {c: sorted((r["value"], [r[f"below{i}"] for i in range(k)]) for r in edge_rows if r["column"] == c) for c in cuts}
    totals = {r["column"]: [r[f"t{i}"] for i in range(k)] for r in collect_bounded(
        cumulative.groupBy("column").agg(*[F.max(F.col(f"below{i}") + F.col("counts")[i]).alias(f"t{i}") for i in range(k)]),
        "columns")}
    worth = lambda arr: (max(arr) ** 2 / sum(arr)) if sum(arr) else 0.0
    scored = F.lit(None).cast("double")
    for c in cuts:
        if c not in totals:
            continue
        marks = [[0] * k] + [e[1] for e in edges[c]] + [totals[c]]
        values = [e[0] for e in edges[c]]
        bins = [[b - a for a, b in zip(x, y)] for x, y in zip(marks, marks[1:])]
        whole = sum(worth(b) for b in bins)
        expr = F.lit(None).cast("double")
        for i, b in enumerate(bins):
            low, high = marks[i], marks[i + 1]
            left = [F.col(f"below{j}").cast("double") - F.lit(float(low[j])) for j in range(k)]
            right = [F.lit(float(high[j])) - F.col(f"below{j}").cast("double") for j in range(k)]
            total = lambda v: sum(v[1:], v[0])
            largest = lambda v: F.greatest(*v) if k > 1 else v[0]
            part = lambda v: F.when(total(v) > 0, largest(v) * largest(v) / total(v)).otherwise(0.0)
            score = (F.lit(float(whole - worth(b))) + part(left) + part(right)) / F.lit(float(len(bins) + 1))
            inside = F.lit(True) if i == len(bins) - 1 else F.col("value") < F.lit(values[i])
            if i > 0:
                inside = inside & (F.col("value") > F.lit(values[i - 1]))
            expr = F.when(inside & expr.isNull(), score).otherwise(expr)
        scored = F.when(F.col("column") == c, expr).otherwise(scored)
    return cumulative.where("not first_value and not last_value") \
        .select("column", F.col("value").alias("cut"), scored.alias("score")) \
        .where(F.col("score").isNotNull())


def caim_table(df: DataFrame, cols, label: str) -> tuple[DataFrame, int]:
    """Distinct values with the class counts strictly below each of them, written once."""
    table, classes = contingency(df, cols, label)
    k = len(classes)
    run = written(table, "contingency")
    run = running_total(run, "column", "value", {f"upto{i}": F.col("counts")[i] for i in range(k)})
    run = run.select("column", "value", "counts", *[(F.col(f"upto{i}") - F.col("counts")[i]).alias(f"below{i}") for i in range(k)])
    limits = run.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    run = run.join(F.broadcast(limits), "column") \
        .select("*", (F.col("value") == F.col("_lo")).alias("first_value"), (F.col("value") == F.col("_hi")).alias("last_value")) \
        .drop("_lo", "_hi")
    return written(run, "running-counts"), k


def caim_cuts(df: DataFrame, cols, label: str, max_cuts: int | None = None) -> dict[str, list[float]]:
    """Greedy class-attribute cuts: as many rounds as classes; the last cut must improve the score.

    The smallest value wins ties; a value equal to a cut belongs to the bin on its right.
    """
    cumulative, k = caim_table(df, cols, label)
    cuts: dict[str, list[float]] = {c: [] for c in cols}
    best_so_far = {c: -1.0 for c in cols}
    for round_no in range(1, k + 1):
        scores = caim_scores(cumulative, cuts, k)
        found = scores.groupBy("column").agg(F.max(F.struct("score", (-F.col("cut")).alias("neg"))).alias("b"))
        for r in found.collect():
            c, score, cut = r["column"], r["b"]["score"], -r["b"]["neg"]
            if max_cuts is not None and len(cuts[c]) >= max_cuts:
                continue
            if round_no < k or score > best_so_far[c]:
                cuts[c] = sorted([*cuts[c], cut])
                best_so_far[c] = score
    return cuts


# ---------------------------------------------------------------- bins from mixtures

def auto_bins(df: DataFrame, cols, max_modes: int = 10) -> dict[str, int]:
    """Number of bins = number of mixture components some row is assigned to, at least 2."""
    used = active_modes(df, mixture_1d(df, cols, max_modes, prior=None), eps=-1.0)
    return {c: max(2, sum(m.used for m in used[c])) for c in cols}


def bin_code(x: Column, cuts: list[float]) -> Column:
    """Number of cuts not above the value: left-closed bins, plain arithmetic inside codegen."""
    return sum((F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in cuts), F.lit(0)).cast("int")


def cut_weights(modes: list[Mode], cuts: list[float]) -> list[float]:
    """Weight of each bin: that of the mixture components whose mean lies in it."""
    out = [0.0] * (len(cuts) + 1)
    for m in modes:
        out[bisect_right(cuts, m.mean)] += m.weight
    return out


def _weights_of(modes: list[Mode], means: list[float]) -> list[float]:
    out = [0.0] * len(means)
    for m in modes:
        out[min(range(len(means)), key=lambda i: (abs(means[i] - m.mean), i))] += m.weight
    return out


@dataclass
class DiscretizerModel:
    """Cut points (or mixture modes) and bin weights per column."""

    cuts: dict[str, list[float]]
    modes: dict[str, list[Mode]] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)

    @property
    def cols(self) -> list[str]:
        return [*self.cuts, *self.modes]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each fitted column by its bin number; other columns stay."""
        out = {c: F.when(F.col(c).isNotNull(), likeliest(F.col(c).cast("double"), m)) for c, m in self.modes.items()}
        many = [c for c, v in self.cuts.items() if len(v) > 64]
        out |= {c: F.when(F.col(c).isNotNull(), bin_code(F.col(c).cast("double"), v))
                for c, v in self.cuts.items() if c not in many}
        df = df.withColumns(out) if out else df
        for c in many:  # a binary search per row instead of a long sum
            edges = [float("-inf"), *self.cuts[c], float("inf")]
            names = df.columns
            df = Bucketizer(splits=edges, inputCol="_x", outputCol="_b", handleInvalid="keep") \
                .transform(df.withColumn("_x", F.col(c).cast("double"))) \
                .withColumn(c, F.when(F.col("_x").isNotNull(), F.col("_b").cast("int"))).select(*names)
        return df

    def bins(self, c: str) -> int:
        return len(self.modes[c]) if c in self.modes else len(self.cuts[c]) + 1

    def table(self, df: DataFrame) -> DataFrame:
        """(column, bin, low, high, weight): the model as a small DataFrame."""
        rows = []
        for c, v in self.cuts.items():
            edges = [None, *v, None]
            rows += [(c, i, edges[i], edges[i + 1], float(self._weight(c, i))) for i in range(len(v) + 1)]
        for c, m in self.modes.items():
            rows += [(c, i, None, None, float(self._weight(c, i))) for i in range(len(m))]
        return df.sparkSession.createDataFrame(rows, "column STRING, bin INT, low DOUBLE, high DOUBLE, weight DOUBLE")

    def _weight(self, c: str, i: int) -> float:
        w = self.weights.get(c, [])
        return w[i] if i < len(w) else 1.0


def fit_discretizer(df: DataFrame, cols, strategy: str | None, bins: int | str | None = "auto", label: str | None = None,
                    bin_weights: str | None = None, exact: bool = True) -> DiscretizerModel:
    """One model per continuous column.

    ``strategy``: one of STRATEGIES, or None to leave the columns as they are.
    ``bins``: a number, ``auto``/``auto-bgm`` (see :func:`auto_bins`) or None for 2.
    ``bin_weights``: None for 1.0 each, ``auto`` for mixture weights.
    """
    cols = list(cols)
    if strategy is None:
        return DiscretizerModel({})
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy in ("chi-merge", "caim") and label is None:
        raise ValueError(f"{strategy} needs a class column")
    n = auto_bins(df, cols) if bins in ("auto", "auto-bgm") and strategy != "caim" else \
        {c: 2 if bins is None or isinstance(bins, str) else int(bins) for c in cols}
    weights = {}
    found = mixture_1d(df, cols, prior=None) if bin_weights == "auto" else {}
    if strategy == "bins-bgm":
        modes: dict[str, list[Mode]] = {}
        for size in sorted(set(n.values())):
            modes |= mixture_1d(df, [c for c in cols if n[c] == size], size, prior=None)
        if found:  # a bin has the weight of the components that it is the likeliest for
            weights = {c: _weights_of(found[c], [m.mean for m in modes[c]]) for c in cols}
        return DiscretizerModel({}, modes, weights)
    if strategy == "bins-uni":
        cuts = uniform_cuts(df, cols, n)
    elif strategy == "bins-q":
        cuts = quantile_cuts(df, cols, n, exact)
    elif strategy == "bins-k":
        cuts = kmeans_cuts(df, cols, n)
    elif strategy == "chi-merge":
        cuts = chi_merge_cuts(df, cols, label, n)
    else:
        cuts = caim_cuts(df, cols, label)
    if found:
        weights = {c: cut_weights(found[c], cuts[c]) for c in cols}
    return DiscretizerModel(cuts, {}, weights)


def discretize_one_hot(df: DataFrame, model: DiscretizerModel, cols) -> DataFrame:
    """Discretize, then one-hot every given column as arrays."""
    binned = model.transform(df)
    return fit_one_hot(binned, cols).transform(binned)
