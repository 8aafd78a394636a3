"""Reversible encoders and scalers.

``fit`` runs one aggregation and keeps its single row of statistics; ``transform`` and ``inverse``
are projections with those numbers as literals, so they stay inside whole-stage code generation
and also work on a streaming DataFrame.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ballast.functions.bounds import MAX_MODEL_ROWS, collect_bounded, join_model
from ballast.functions.store import written
from ballast.operators.prepare import value_counts
from ballast.spec import UnknownColumns, refuse_stream, validate_columns


def _num(c: str) -> Column:
    return F.col(c).cast("double")


# ---------------------------------------------------------------- affine scalers

@dataclass(frozen=True)
class AffineModel:
    """x -> (x - shift) / scale + base per column, with the fitted range for clipping."""

    shift: dict[str, float]
    scale: dict[str, float]
    base: float
    low: dict[str, float]
    high: dict[str, float]

    @property
    def cols(self) -> list[str]:
        return list(self.shift)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_num(c) - self.shift[c]) / self.scale[c] + F.lit(self.base) for c in self.cols})

    def inverse(self, df: DataFrame, clip: bool = False) -> DataFrame:
        out = {}
        for c in self.cols:
            x = (_num(c) - F.lit(self.base)) * self.scale[c] + self.shift[c]
            out[c] = clip_to_range(x, self.low[c], self.high[c]) if clip else x
        return df.withColumns(out)


def clip_to_range(x: Column, low, high) -> Column:
    """Limit a decoded value to the range seen at fit time."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(F.least(x, high), low)


def column_stats(df: DataFrame, cols) -> dict[str, dict[str, float]]:
    """mean, population deviation, min and max of every column from one aggregation."""
    validate_columns(df, cols)
    refuse_stream(df, "fitting a scaler")
    parts = [F.avg, F.stddev_pop, F.min, F.max]
    row = df.agg(*[f(_num(c)).alias(f"s{i}_{j}") for i, c in enumerate(cols) for j, f in enumerate(parts)]).first()
    return {c: dict(zip(("mean", "std", "min", "max"), (row[f"s{i}_{j}"] for j in range(4)))) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols, with_mean: bool = True, with_std: bool = True) -> AffineModel:
    """(x - mean) / population deviation; a constant column is divided by one."""
    s = column_stats(df, cols)
    return AffineModel({c: s[c]["mean"] if with_mean else 0.0 for c in cols},
                       {c: (s[c]["std"] or 1.0) if with_std else 1.0 for c in cols}, 0.0,
                       {c: s[c]["min"] for c in cols}, {c: s[c]["max"] for c in cols})


def min_max(df: DataFrame, cols, low: float = 0.0, high: float = 1.0) -> AffineModel:
    """Map the fitted range to [low, high]; a constant column maps to ``low``."""
    s = column_stats(df, cols)
    return AffineModel({c: s[c]["min"] for c in cols},
                       {c: ((s[c]["max"] - s[c]["min"]) or 1.0) / (high - low) for c in cols}, low,
                       {c: s[c]["min"] for c in cols}, {c: s[c]["max"] for c in cols})


@dataclass(frozen=True)
class Passthrough:
    """Columns stay as they are."""

    cols: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def inverse(self, df: DataFrame, clip: bool = False) -> DataFrame:
        return df


def general_scale(df: DataFrame, cols, integer=()) -> AffineModel:
    """One scalar in [-1, 1] by fitted range; integer columns use the range [-0.001, max + 0.001]."""
    s = column_stats(df, cols)
    low = {c: -1e-3 if c in integer else s[c]["min"] for c in cols}
    high = {c: s[c]["max"] + 1e-3 if c in integer else s[c]["max"] for c in cols}
    return AffineModel(low, {c: ((high[c] - low[c]) or 1.0) / 2.0 for c in cols}, -1.0, low, high)


def general_inverse(model: AffineModel, df: DataFrame, integer=()) -> DataFrame:
    """Clip the scalar to [-1, 1], undo :func:`general_scale`, round integer columns."""
    clipped = df.withColumns({c: clip_to_range(_num(c), -1.0, 1.0) for c in model.cols})
    return round_integers(model.inverse(clipped), {c: "double" for c in integer})


def round_integers(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Round decoded columns half to even and give them back their type."""
    return df.withColumns({c: F.rint(_num(c)).cast(t) for c, t in types.items()}) if types else df


# ---------------------------------------------------------------- Yeo-Johnson

def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson map for one lambda."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    down = -F.log1p(-x) if abs(lam - 2.0) < 1e-12 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(y) if abs(lam) < 1e-12 else F.pow(F.greatest(y * lam + 1.0, F.lit(0.0)), F.lit(1.0 / lam)) - 1.0
    down = -F.expm1(-y) if abs(lam - 2.0) < 1e-12 else \
        1.0 - F.pow(F.greatest(1.0 - (2.0 - lam) * y, F.lit(0.0)), F.lit(1.0 / (2.0 - lam)))
    return F.when(y >= 0, up).otherwise(down)


@dataclass(frozen=True)
class YeoJohnsonModel:
    lam: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (yeo_johnson(_num(c), l) - self.mean[c]) / self.std[c] for c, l in self.lam.items()})

    def inverse(self, df: DataFrame, clip: bool = False) -> DataFrame:
        out = {}
        for c, l in self.lam.items():
            x = yeo_johnson_inverse(_num(c) * self.std[c] + self.mean[c], l)
            out[c] = clip_to_range(x, self.low[c], self.high[c]) if clip else x
        return df.withColumns(out)


def _power(x: np.ndarray, lam: float) -> np.ndarray:
    out, pos = np.empty_like(x), x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def _grid_moments(df: DataFrame, cols, grids: dict[tuple, list[float]], group: str | None) -> dict[tuple, tuple]:
    """n, mean, squared deviations and slope of the mapped values for every lambda of every grid.

    ``grids`` is keyed by (group value, column).  Each task reduces its rows to one line per grid
    point; the lines are merged by the pairwise-variance formula.
    """
    key = F.col(group).cast("string") if group else F.lit("all")
    cols = list(cols)

    def partial(batches):
        for pdf in batches:
            lines = []
            for name, part in pdf.groupby("g", sort=False):
                for c in cols:
                    x = part[c].to_numpy(dtype=float)
                    x = x[~np.isnan(x)]
                    if not len(x):
                        continue
                    slope = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                    for i, lam in enumerate(grids[(name, c)]):
                        y = _power(x, lam)
                        lines.append((name, c, i, float(len(x)), float(y.mean()), float(((y - y.mean()) ** 2).sum()), slope))
            yield pd.DataFrame(lines, columns=["g", "column", "i", "n", "m", "m2", "slope"])

    lines = df.select(key.alias("g"), *[_num(c).alias(c) for c in cols]).mapInPandas(
        partial, "g STRING, column STRING, i INT, n DOUBLE, m DOUBLE, m2 DOUBLE, slope DOUBLE")
    merged = lines.groupBy("g", "column", "i").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"),
        F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("msq"),
        F.sum("slope").alias("slope"))
    return {(r["g"], r["column"], r["i"]): (r["n"], r["m"], max(r["inner"] + r["msq"] - r["n"] * r["m"] ** 2, 0.0), r["slope"])
            for r in collect_bounded(merged, "grid points", 1_000_000)}


def _best_lambdas(df: DataFrame, cols, groups: list[str], group: str | None, low: float, high: float, points: int,
                  rounds: int) -> dict[tuple, tuple]:
    """(lambda, mean, deviation) of greatest normal likelihood per (group, column)."""
    pairs = [(g, c) for g in groups for c in cols]
    spans, best = dict.fromkeys(pairs, (low, high)), {}
    for _ in range(rounds):
        grids = {p: list(np.linspace(*spans[p], points)) for p in pairs}
        sums = _grid_moments(df, cols, grids, group)
        for g, c in pairs:
            scored = []
            for i, lam in enumerate(grids[(g, c)]):
                n, m, m2, slope = sums.get((g, c, i), (0.0, 0.0, 0.0, 0.0))
                if m2 > 0 and np.isfinite(m2):
                    scored.append((-n / 2 * math.log(m2 / n) + (lam - 1) * slope, -i, lam, m, math.sqrt(m2 / n)))
            mean = sums.get((g, c, 0), (0.0, 0.0))[1]
            best[(g, c)] = max(scored)[2:] if scored else (1.0, mean, 1.0)
            step = (spans[(g, c)][1] - spans[(g, c)][0]) / (points - 1)
            spans[(g, c)] = (best[(g, c)][0] - step, best[(g, c)][0] + step)
    return best


def yeo_johnson_fit(df: DataFrame, cols, low: float = -2.0, high: float = 4.0, points: int = 25,
                    rounds: int = 4) -> YeoJohnsonModel:
    """Lambda of greatest normal likelihood per column, by a grid that is narrowed ``rounds`` times.

    Every round reads the table once for all columns and all grid points together.
    """
    stats = column_stats(df, cols)
    best = _best_lambdas(df, cols, ["all"], None, low, high, points, rounds)
    part = lambda i: {c: best[("all", c)][i] for c in cols}
    return YeoJohnsonModel(part(0), part(1), part(2), {c: stats[c]["min"] for c in cols}, {c: stats[c]["max"] for c in cols})


# ---------------------------------------------------------------- standardize + PCA

@dataclass(frozen=True)
class PcaModel:
    scaler: AffineModel
    components: np.ndarray  # features x k
    out: str

    def transform(self, df: DataFrame) -> DataFrame:
        z = self.scaler.transform(df.select("*", *[_num(c).alias(f"_z_{c}") for c in self.scaler.cols]))
        terms = [sum((F.col(c) * float(self.components[i, j]) for i, c in enumerate(self.scaler.cols)), F.lit(0.0))
                 for j in range(self.components.shape[1])]
        back = {c: F.col(f"_z_{c}") for c in self.scaler.cols}
        return z.withColumn(self.out, F.array(*terms)).withColumns(back).drop(*[f"_z_{c}" for c in self.scaler.cols])

    def inverse(self, df: DataFrame, clip: bool = False) -> DataFrame:
        z = {c: sum((F.col(self.out)[j] * float(self.components[i, j]) for j in range(self.components.shape[1])),
                    F.lit(0.0)) for i, c in enumerate(self.scaler.cols)}
        return self.scaler.inverse(df.withColumns(z), clip)


def standardize_pca(df: DataFrame, cols, k: int | None = None, out: str = "pca") -> PcaModel:
    """Standardize the features, then project them on their first k principal components."""
    scaler = standardize(df, cols)
    z = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(scaler.transform(df.select(*cols)))
    fitted = PCA(k=k or len(cols), inputCol="_v", outputCol="_p").fit(z)
    return PcaModel(scaler, np.array(fitted.pc.toArray()), out)


# ---------------------------------------------------------------- scalers by name

# The scaler names callers of the reference use.
SCALER_NAMES = ("None", "stds", "mms01", "mms11", "stds-pca", "yeo")


def fit_scaler(name: str | None, df: DataFrame, cols):
    """A fitted scaler by name; an unknown name raises."""
    if name in (None, "None", "none"):
        return Passthrough(tuple(cols))
    if name == "stds":
        return standardize(df, cols)
    if name == "mms01":
        return min_max(df, cols, 0.0, 1.0)
    if name == "mms11":
        return min_max(df, cols, -1.0, 1.0)
    if name == "stds-pca":
        return standardize_pca(df, cols)
    if name == "yeo":
        return yeo_johnson_fit(df, cols)
    raise ValueError(f"unknown scaler {name!r}; known: {', '.join(SCALER_NAMES)}")


# ---------------------------------------------------------------- a scaler per group

class PerGroupScale:
    """C1/C2/C3-style scaling with separate statistics per cluster; categoricals are not touched."""

    def __init__(self, stats: DataFrame, cols, group: str, kind: str):
        self.stats, self.cols, self.group, self.kind = stats, list(cols), group, kind

    def _spread(self, c: str) -> tuple[Column, Column, float]:
        s = F.col(f"_s_{c}")
        one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
        if self.kind == "stds":
            return s["mean"], one(s["std"]), 0.0
        if self.kind == "mms01":
            return s["min"], one(s["max"] - s["min"]), 0.0
        return s["min"], one(s["max"] - s["min"]) / 2.0, -1.0

    def transform(self, df: DataFrame) -> DataFrame:
        joined = join_model(df, self.stats, self.group, "left")
        out = {}
        for c in self.cols:
            shift, scale, base = self._spread(c)
            out[c] = (_num(c) - shift) / scale + F.lit(base)
        return joined.withColumns(out).select(*df.columns)

    def inverse(self, df: DataFrame, clip: bool = True) -> DataFrame:
        joined = join_model(df, self.stats, self.group, "left")
        out = {}
        for c in self.cols:
            shift, scale, base = self._spread(c)
            x = (_num(c) - F.lit(base)) * scale + shift
            out[c] = clip_to_range(x, F.col(f"_s_{c}")["min"], F.col(f"_s_{c}")["max"]) if clip else x
        return joined.withColumns(out).select(*df.columns)


def per_group_scale(df: DataFrame, cols, group: str, kind: str = "mms11") -> PerGroupScale:
    """Fit one scaler per value of ``group`` in one aggregation (partial sums before the shuffle)."""
    if kind not in ("stds", "mms01", "mms11"):
        raise ValueError(f"unknown per-group scaler {kind!r}")
    stats = df.groupBy(group).agg(*[
        F.struct(F.avg(_num(c)).alias("mean"), F.stddev_pop(_num(c)).alias("std"),
                 F.min(_num(c)).alias("min"), F.max(_num(c)).alias("max")).alias(f"_s_{c}") for c in cols])
    return PerGroupScale(stats, cols, group, kind)


def _yeo_johnson_at(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson map with a lambda of the row's own."""
    other = F.lit(2.0) - lam
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    down = F.when(F.abs(other) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, other) - 1.0) / other)
    return F.when(x >= 0, up).otherwise(down)


def _yeo_johnson_back(y: Column, lam: Column) -> Column:
    other = F.lit(2.0) - lam
    up = F.when(F.abs(lam) < 1e-12, F.expm1(y)).otherwise(F.pow(F.greatest(y * lam + 1.0, F.lit(0.0)), 1.0 / lam) - 1.0)
    down = F.when(F.abs(other) < 1e-12, -F.expm1(-y)).otherwise(1.0 - F.pow(F.greatest(1.0 - other * y, F.lit(0.0)), 1.0 / other))
    return F.when(y >= 0, up).otherwise(down)


class PerGroupYeoJohnson:
    """A Yeo-Johnson map per group, joined to the rows; a group without a map (or a null one) gives nulls.

    ``models`` holds a row per group and a struct ``_y_<column>`` of lam, mean, std, low and high.
    """

    def __init__(self, models: DataFrame, cols, group: str):
        self.models, self.cols, self.group = models, list(cols), group

    def transform(self, df: DataFrame) -> DataFrame:
        part = lambda c: F.col(f"_y_{c}")
        joined = join_model(df, self.models, self.group, "left")
        return joined.withColumns({c: (_yeo_johnson_at(_num(c), part(c)["lam"]) - part(c)["mean"]) / part(c)["std"] for c in self.cols}).select(*df.columns)

    def inverse(self, df: DataFrame, clip: bool = True) -> DataFrame:
        joined, out = join_model(df, self.models, self.group, "left"), {}
        for c in self.cols:
            m = F.col(f"_y_{c}")
            x = _yeo_johnson_back(_num(c) * m["std"] + m["mean"], m["lam"])
            out[c] = clip_to_range(x, m["low"], m["high"]) if clip else x
        return joined.withColumns(out).select(*df.columns)


def per_group_yeo_johnson(df: DataFrame, cols, group: str, low: float = -2.0, high: float = 4.0,
                          points: int = 25, rounds: int = 4) -> PerGroupYeoJohnson:
    """Fit the maps of all groups together, whatever their number: one pass per round.

    Every value meets the ``points`` lambdas of its group's and column's span, and moments are added up before they
    are shuffled.  The likeliest lambda (the smaller on ties) is the middle of the next, narrower span.  Nulls and NaN are
    left out; where all values of a group are equal the map is the identity less that value.
    """
    refuse_stream(df, "per_group_yeo_johnson")
    cols = list(cols)
    values = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), *[_num(c).alias(c) for c in cols]) \
        .unpivot(["_g"], cols, "column", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    lim = written(values.groupBy("_g", "column").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mid")), "spans")
    step = (high - low) / (points - 1)
    found = lim.select("_g", "column", F.lit(low).alias("from"))
    for _ in range(rounds):
        lam = F.col("from") + F.col("i") * F.lit(step)
        tried = join_model(values, found.select("_g", "column", "from"), ["_g", "column"]) \
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("lam", lam)
        sums = tried.groupBy("_g", "column", "i", "lam").agg(
            F.count(F.lit(1)).alias("n"), F.avg(_yeo_johnson_at(F.col("x"), F.col("lam"))).alias("mean"),
            F.var_pop(_yeo_johnson_at(F.col("x"), F.col("lam"))).alias("v"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("slope"))
        likely = -F.col("n") / 2 * F.log("v") + (F.col("lam") - 1) * F.col("slope")
        usable = (F.col("v") > 0) & (F.col("v") < F.lit(float("inf")))
        best = sums.groupBy("_g", "column").agg(F.max(F.when(usable, F.struct(
            likely.alias("likely"), (-F.col("i")).alias("i"), F.col("lam"), F.col("mean"), F.sqrt("v").alias("std")))).alias("b"))
        found = written(best.withColumn("from", F.coalesce(F.col("b.lam"), F.lit(1.0)) - F.lit(step)), "lambdas")
        step = 2 * step / (points - 1)
    maps = found.join(lim, ["_g", "column"]).select("_g", "column", F.struct(
        F.coalesce("b.lam", F.lit(1.0)).alias("lam"), F.coalesce("b.mean", "mid").alias("mean"), F.coalesce("b.std", F.lit(1.0)).alias("std"), "low", "high").alias("m"))
    wide = maps.groupBy(F.col("_g").alias(group)).agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"_y_{c}") for c in cols])
    return PerGroupYeoJohnson(written(wide, "maps"), cols, group)


# ---------------------------------------------------------------- categories

def sorted_vocabulary(df: DataFrame, cols, max_values: int = 10_000) -> dict[str, list[str]]:
    """Sorted distinct values (as strings) of several columns, from one shuffle."""
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in collect_bounded(value_counts(df, cols).select("column", "value"), "categories", max_values):
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def frequency_vocabulary(df: DataFrame, cols) -> DataFrame:
    """(column, value, n, code): codes by descending count, ties by value."""
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    counts = value_counts(df, cols)
    if len(counts.limit(MAX_MODEL_ROWS + 1).collect()) > MAX_MODEL_ROWS:
        from ballast.functions.ranks import ranked
        # equal counts are common: their values spread them over the buckets, in the order of the ranks
        image = F.conv(F.rpad(F.hex(F.substring("value", 1, 6).cast("binary")), 12, "0").substr(1, 12), 16, 10).cast("double")
        spread = counts.withColumn("_place", image / F.lit(float(1 << 48)) - F.col("n")).withColumn("_neg", -F.col("n"))
        return ranked(spread, "column", ["_place", "_neg", "value"]) \
            .select("column", "value", "n", (F.col("rank") - 1).cast("int").alias("code"))
    return counts.select("column", "value", "n", (F.row_number().over(order) - 1).alias("code"))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """An array of 0.0/1.0, one slot per vocabulary entry."""
    text = value.cast("string")
    return F.array(*[F.when(text == v, 1.0).otherwise(0.0) for v in vocabulary])


def one_hot_inverse(span: Column, vocabulary: list[str]) -> Column:
    """The category of the first largest slot."""
    return F.element_at(F.array(*[F.lit(v) for v in vocabulary]),
                        F.array_position(span, F.array_max(span)).cast("int"))


@dataclass(frozen=True)
class OneHotModel:
    vocabulary: dict[str, list[str]]

    @property
    def width(self) -> int:
        return sum(len(v) for v in self.vocabulary.values())

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: one_hot(F.col(c), v) for c, v in self.vocabulary.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: one_hot_inverse(F.col(c), v) for c, v in self.vocabulary.items()})


def fit_one_hot(df: DataFrame, cols) -> OneHotModel:
    return OneHotModel(sorted_vocabulary(df, cols)) if cols else OneHotModel({})


@dataclass(frozen=True)
class EncodedLayout:
    """Where each column's numbers sit in the encoded row: (column, start, dim, kind)."""

    spans: tuple[tuple[str, int, int, str], ...]
    vocabulary: dict[str, list[str]]

    @property
    def width(self) -> int:
        return sum(s[2] for s in self.spans)

    def table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(list(self.spans), "column STRING, start INT, dim INT, kind STRING")

    def value_id(self, column: str, value) -> dict[str, int]:
        """Position of a column and of one of its values; unknown names raise."""
        names = [s[0] for s in self.spans]
        if column not in names:
            raise UnknownColumns(f"column {column!r} is not encoded")
        known = self.vocabulary.get(column, [])
        if str(value) not in known:
            raise ValueError(f"value {value!r} does not occur in column {column!r}")
        discrete = [s[0] for s in self.spans if s[3] == "discrete"]
        return {"discrete_column_id": discrete.index(column), "column_id": names.index(column),
                "value_id": known.index(str(value))}


def encoded_layout(columns, vocabulary: dict[str, list[str]], modes: dict[str, int] | None = None) -> EncodedLayout:
    """Running offsets over the columns: categories take one slot each, a mode-normalized column
    takes one value and one slot per mode, any other column one value."""
    spans, start = [], 0
    for c in columns:
        if c in vocabulary:
            dim, kind = len(vocabulary[c]), "discrete"
        elif modes and c in modes:
            dim, kind = 1 + modes[c], "modes"
        else:
            dim, kind = 1, "continuous"
        spans.append((c, start, dim, kind))
        start += dim
    return EncodedLayout(tuple(spans), vocabulary)


def feature_array(spec_features, one_hots: OneHotModel | None = None) -> Column:
    """One array of doubles from scalar features and one-hot spans, in feature order."""
    spans = one_hots.vocabulary if one_hots else {}
    parts = [F.col(c) if c in spans else F.array(_num(c)) for c in spec_features]
    return F.concat(*parts)


def split_features(df: DataFrame, array: str, spec_features, one_hots: OneHotModel) -> DataFrame:
    """Undo :func:`feature_array`: scalars and categories back from the array."""
    at, out = 0, {}
    for c in spec_features:
        if c in one_hots.vocabulary:
            v = one_hots.vocabulary[c]
            out[c] = one_hot_inverse(F.slice(F.col(array), at + 1, len(v)), v)
            at += len(v)
        else:
            out[c] = F.col(array)[at]
            at += 1
    return df.withColumns(out)


to_vector = array_to_vector
to_array = vector_to_array
