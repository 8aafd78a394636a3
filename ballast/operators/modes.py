"""Mode-specific normalization: a value becomes (scalar within one Gaussian mode, mode slot)."""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.bounds import collect_bounded
from ballast.functions.draws import uniform
from ballast.functions.store import written
from ballast.operators.encode import clip_to_range
from ballast.spec import refuse_stream

# Fixed values of the published encoding.
SPREAD = 4.0          # a scalar is (x - mean) / (SPREAD * sd)
EDGE = 0.99           # and is clipped to +-EDGE
SMOOTHING = 1e-6      # added to every responsibility before a mode is drawn
MISSING = -9999999.0  # the modal value that stands for a missing entry
CONCENTRATION = 0.001  # weight prior of the mixture; small values leave few modes in use
TOLERANCE = 1e-3      # of the mean log density, where a mixture has settled
START_POINTS = 1001   # quantiles that a fit starts from


@dataclass(frozen=True)
class Mode:
    """One Gaussian component of a column."""

    mean: float
    sd: float
    weight: float
    used: bool = True


# ---------------------------------------------------------------- one-dimensional mixtures

def starting_points(df: DataFrame, cols, points: int = START_POINTS, where: dict[str, Column] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per column distinct values and weights: ``points`` quantiles, for iterations over all rows to start from.

    Outliers do not thin them out, as they would the bins of a histogram.  Columns without values are left out.
    """
    refuse_stream(df, "starting_points")
    num = {c: F.when(where[c], F.col(c).cast("double")) if where and c in where else F.col(c).cast("double") for c in cols}
    probs = [i / (points - 1) for i in range(points)]
    row = df.agg(*[F.percentile_approx(x, probs, 10_000).alias(f"q{i}") for i, x in enumerate(num.values())]).first()
    found = {c: row[f"q{i}"] for i, c in enumerate(cols) if row[f"q{i}"]}
    return {c: tuple(v.astype(float) for v in np.unique(np.array(q, float), return_counts=True)) for c, q in found.items()}


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by upward recurrence and the asymptotic series."""
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(6):
        out, x = out - 1.0 / x, x + 1.0
    inv = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


@dataclass
class _Posterior:
    """State of a variational Gaussian mixture of one column (normal-gamma prior around the column's own mean and variance)."""

    prior: float
    centre: float
    var: float
    log_weight: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    sd2: np.ndarray
    precision: np.ndarray
    dof: np.ndarray

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Per point and component, and the sum of the log densities (up to a constant)."""
        log_p = self.log_weight[None, :] - 0.5 * (np.log(self.sd2) + np.log(self.dof) - np.log(2) - _digamma(self.dof / 2))[None, :] \
            - 0.5 * (1.0 / self.precision[None, :] + (x[:, None] - self.mean) ** 2 / self.sd2[None, :])
        top = log_p.max(1, keepdims=True)
        p = np.exp(log_p - top)
        norm = p.sum(1, keepdims=True)
        return p / norm, float((top + np.log(norm)).sum())


def _posterior(prior: float, centre: float, var: float, size: np.ndarray, first: np.ndarray, second: np.ndarray) -> _Posterior:
    """The update for given sums of responsibilities, of (x - centre) and of its square, per component."""
    size = size + 1e-10
    bar = first / size
    scatter = np.maximum(second - size * bar ** 2, 0.0)
    later = np.concatenate([np.cumsum(size[::-1])[::-1][1:], [0.0]])
    a, b = 1.0 + size, prior + later
    log_stick = _digamma(a) - _digamma(a + b)
    log_rest = np.concatenate([[0.0], np.cumsum(_digamma(b) - _digamma(a + b))[:-1]])
    precision, dof = 1.0 + size, 1.0 + size
    stick = a / (a + b)
    weight = stick * np.concatenate([[1.0], np.cumprod(1 - stick)[:-1]])
    sd2 = (var + scatter + size / precision * bar ** 2) / dof + 1e-6 * var
    return _Posterior(prior, centre, var, log_stick + log_rest, weight / weight.sum(), centre + size * bar / precision, sd2, precision, dof)


def _sums(x: np.ndarray, resp: np.ndarray, centre: float, n: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, z = resp * np.reshape(n, (-1, 1)), (x - centre)[:, None]
    return w.sum(0), (w * z).sum(0), (w * z * z).sum(0)


def _start(x: np.ndarray, n: np.ndarray, modes: int, prior: float, rounds: int = 100) -> _Posterior:
    """A mixture fitted to weighted points, for the rows to go on from."""
    total, k = n.sum(), min(modes, len(x))
    centre = float((n * x).sum() / total)
    var = float((n * (x - centre) ** 2).sum() / total) or 1e-12
    edges = np.interp((np.arange(k) + 0.5) / k, np.cumsum(n) / total, x)
    resp = np.zeros((len(x), k))
    resp[np.arange(len(x)), np.abs(x[:, None] - edges[None, :]).argmin(1)] = 1.0
    for _ in range(rounds):
        state = _posterior(prior, centre, var, *_sums(x, resp, centre, n))
        new, _ = state.responsibilities(x)
        moved = float((np.abs(new - resp) * n[:, None]).sum() / total)
        resp = new
        if moved < 1e-4:
            break
    return state


def mixture_1d(df: DataFrame, cols, max_modes: int = 10, where: dict[str, Column] | None = None,
               prior: float | None = CONCENTRATION, rounds: int = 100) -> dict[str, list[Mode]]:
    """A variational Gaussian mixture with a stick-breaking weight prior per column.

    The fit starts from that of the column's quantiles; then every round reads all rows once for all columns, until
    the mean log density moves by less than 1e-3, or for the published 100 ``rounds``.  ``prior`` is the
    weight concentration; None stands for 1 / ``max_modes``.
    """
    prior = 1.0 / max_modes if prior is None else prior
    num = {c: F.when(where[c], F.col(c).cast("double")) if where and c in where else F.col(c).cast("double") for c in cols}
    rows = written(df.select(*[x.alias(f"x{i}") for i, x in enumerate(num.values())]), "mixture-values")
    states = {c: _start(x, n, max_modes, prior) for c, (x, n) in starting_points(df, cols, where=where).items()}
    moving, reached = {i: c for i, c in enumerate(cols) if c in states}, {}
    for _ in range(rounds):
        if not moving:
            break
        current = {i: states[c] for i, c in moving.items()}

        def sums(batches):
            for batch in batches:
                out = []
                for i, state in current.items():
                    x = batch[f"x{i}"].to_numpy(float)
                    x = x[~np.isnan(x)]
                    if len(x):
                        resp, density = state.responsibilities(x)
                        out += [(i, j, *map(float, v)) for j, v in enumerate(zip(*_sums(x, resp, state.centre)))]
                        out.append((i, -1, float(len(x)), density, 0.0))
                yield pd.DataFrame(out, columns=["col", "mode", "size", "first", "second"])

        total = rows.mapInPandas(sums, "col INT, mode INT, size DOUBLE, first DOUBLE, second DOUBLE") \
            .groupBy("col", "mode").agg(*[F.sum(v).alias(v) for v in ("size", "first", "second")]).orderBy("col", "mode").collect()
        for i, c in list(moving.items()):
            old, mine = states[c], [r for r in total if r["col"] == i and r["mode"] >= 0]
            n, density = next((r["size"], r["first"]) for r in total if r["col"] == i and r["mode"] < 0)
            new = _posterior(old.prior, old.centre, old.var, *(np.array([r[v] for r in mine]) for v in ("size", "first", "second")))
            states[c] = new
            if abs(density / n - reached.get(c, math.inf)) < TOLERANCE:
                del moving[i]
            reached[c] = density / n
    return {c: [Mode(float(m), float(np.sqrt(v)), float(w)) for m, v, w in zip(states[c].mean, states[c].sd2, states[c].weight)] if c in states else []
            for c in cols}


# ---------------------------------------------------------------- modes in use

def _log_density(x: Column, m: Mode) -> Column:
    """log(weight) + log normal density, up to a common constant."""
    z = (x - F.lit(m.mean)) / F.lit(m.sd)
    return F.lit(float(np.log(max(m.weight, 1e-300)) - np.log(m.sd))) - F.lit(0.5) * z * z


def likeliest(x: Column, modes: list[Mode]) -> Column:
    """Zero-based index of the most probable mode (first on ties)."""
    best = F.array_max(F.array(*[F.struct(_log_density(x, m).alias("d"), F.lit(-i).alias("i")) for i, m in enumerate(modes)]))
    return (-best["i"]).cast("int")


def mode_use(df: DataFrame, models: dict[str, list[Mode]], where: dict[str, Column] | None = None) -> DataFrame:
    """(column, mode, n): rows whose most probable mode it is, all columns in one aggregation."""
    parts = []
    for c, modes in models.items():
        x = F.col(c).cast("double")
        x = F.when(where[c], x) if where and c in where else x
        parts.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), likeliest(x, modes)).alias("mode")))
    return df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(F.col("mode").isNotNull()) \
             .groupBy("column", "mode").agg(F.count(F.lit(1)).alias("n"))


def active_modes(df: DataFrame, models: dict[str, list[Mode]], eps: float = 0.005,
                 where: dict[str, Column] | None = None) -> dict[str, list[Mode]]:
    """Mark as used the modes of weight above ``eps`` that some row is assigned to."""
    seen = {(r["column"], r["mode"]) for r in collect_bounded(mode_use(df, models, where), "modes")}
    return {c: [Mode(m.mean, m.sd, m.weight, m.weight > eps and (c, i) in seen) for i, m in enumerate(modes)]
            for c, modes in models.items()}


def draw_mode(x: Column, modes: list[Mode], draw: Column) -> Column:
    """Index, among the used modes, drawn by smoothed responsibility (not the likeliest one).

    An Arrow batch of values is handled as one matrix of densities; the draw itself stays a hash.
    """
    used = [i for i, m in enumerate(modes) if m.used]
    mean, sd = np.array([m.mean for m in modes]), np.array([m.sd for m in modes])
    scale = np.log([max(m.weight, 1e-300) for m in modes]) - np.log(sd)

    @F.pandas_udf("int")
    def choose(values: pd.Series, draws: pd.Series) -> pd.Series:
        z = (values.to_numpy(float)[:, None] - mean) / sd
        density = scale - 0.5 * z * z
        density = np.exp(density - density.max(1, keepdims=True))
        run = np.cumsum(density[:, used] / density.sum(1, keepdims=True) + SMOOTHING, axis=1)
        index = (run <= (draws.to_numpy(float) * run[:, -1])[:, None]).sum(1)
        return pd.Series(np.minimum(index, len(used) - 1))

    return F.when(x.isNotNull(), choose(F.coalesce(x, F.lit(0.0)), draw))


def order_by_use(df: DataFrame, slots: dict[str, str], sizes: dict[str, int]) -> dict[str, list[int]]:
    """For each column, the slots by descending number of rows, ties by slot."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(s).alias("slot")) for c, s in slots.items()]
    counts = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(F.col("slot").isNotNull()) \
               .groupBy("column", "slot").agg(F.count(F.lit(1)).alias("n"))
    n = {(r["column"], r["slot"]): r["n"] for r in collect_bounded(counts, "mode slots")}
    return {c: sorted(range(sizes[c]), key=lambda i: (-n.get((c, i), 0), i)) for c in slots}


# ---------------------------------------------------------------- the encoder

@dataclass
class ModeModel:
    """Fitted modes of the columns and, for mixed columns, their modal values.

    Encoded form of column ``c``: ``c_value`` (double) and ``c_slot`` (int).  Slots of a mixed
    column start with its modal values; ``order`` lists original slots by descending use.
    """

    modes: dict[str, list[Mode]]
    modal: dict[str, list[float]] = field(default_factory=dict)
    modal_scalar: dict[str, list[float]] = field(default_factory=dict)
    order: dict[str, list[int]] = field(default_factory=dict)
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)

    def used(self, c: str) -> list[Mode]:
        return [m for m in self.modes[c] if m.used]

    def slots(self, c: str) -> int:
        return len(self.modal.get(c, [])) + len(self.used(c))

    def encode(self, df: DataFrame, row_id, seed: int = 42, reorder: bool = True) -> DataFrame:
        """Add value and slot columns; modes are drawn per row."""
        ids = [row_id] if isinstance(row_id, str) else list(row_id)
        for c in self.modes:
            x, used, modal = F.col(c).cast("double"), self.used(c), self.modal.get(c, [])
            df = df.withColumn("_m", draw_mode(x, self.modes[c], uniform(f"mode.{c}", *ids, seed=seed)))
            means, sds = (F.array(*[F.lit(v) for v in vs]) for vs in ([m.mean for m in used], [m.sd for m in used]))
            scalar = (x - F.element_at(means, F.col("_m") + 1)) / (F.lit(SPREAD) * F.element_at(sds, F.col("_m") + 1))
            value, slot = clip_to_range(scalar, -EDGE, EDGE), F.col("_m") + len(modal)
            for i in range(len(modal) - 1, -1, -1):
                hit = x == F.lit(modal[i])
                if modal[i] == MISSING:
                    hit = hit | x.isNull()
                value = F.when(hit, F.lit(self.modal_scalar[c][i])).otherwise(value)
                slot = F.when(hit, F.lit(i)).otherwise(slot)
            df = df.withColumn(f"{c}_value", value).withColumn(f"{c}_slot", slot.cast("int")).drop("_m")
        if reorder:
            if not self.order:
                self.order = order_by_use(df, {c: f"{c}_slot" for c in self.modes}, {c: self.slots(c) for c in self.modes})
            df = df.withColumns({f"{c}_slot": F.element_at(F.array(*[F.lit(self.order[c].index(i)) for i in range(self.slots(c))]),
                                                           F.col(f"{c}_slot") + 1) for c in self.modes})
        return df

    def slot_one_hot(self, c: str) -> Column:
        """The 0/1 span of a column's slot."""
        return F.array(*[F.when(F.col(f"{c}_slot") == i, 1.0).otherwise(0.0) for i in range(self.slots(c))])

    def decode_value(self, c: str) -> Column:
        """u * 4 * sd + mean of the slot's mode, or the modal value itself."""
        modal, used = self.modal.get(c, []), self.used(c)
        order = self.order.get(c) or list(range(self.slots(c)))
        slot = F.element_at(F.array(*[F.lit(i) for i in order]), F.col(f"{c}_slot") + 1)
        mode = F.greatest(slot - len(modal), F.lit(0)) + 1
        means, sds = (F.array(*[F.lit(v) for v in vs]) for vs in ([m.mean for m in used], [m.sd for m in used]))
        u = clip_to_range(F.col(f"{c}_value"), -1.0, 1.0)
        out = u * F.lit(SPREAD) * F.element_at(sds, mode) + F.element_at(means, mode)
        if modal:
            out = F.when(slot < len(modal), F.element_at(F.array(*[F.lit(v) for v in modal]), F.least(slot + 1, F.lit(len(modal))))).otherwise(out)
        return out

    def decode(self, df: DataFrame, integer=()) -> DataFrame:
        """Replace value and slot columns by the decoded column; every row is kept."""
        out = {c: F.rint(self.decode_value(c)) if c in integer else self.decode_value(c) for c in self.modes}
        return df.withColumns(out).drop(*[f"{c}_{t}" for c in self.modes for t in ("value", "slot")])

    def decode_or_reject(self, df: DataFrame, integer=()) -> tuple[DataFrame, Column]:
        """Decoded rows, with a flag column that is false where any column left its fitted range."""
        decoded = df.withColumns({f"_raw_{c}": self.decode_value(c) for c in self.modes})
        inside = F.lit(True)
        for c in self.modes:
            raw = F.col(f"_raw_{c}")
            ok = (raw >= F.lit(self.low[c])) & (raw <= F.lit(self.high[c]))
            inside = inside & ok
        flagged = decoded.withColumn("accepted", inside)
        out = flagged.withColumns({c: F.rint(f"_raw_{c}") if c in integer else F.col(f"_raw_{c}") for c in self.modes})
        return out.drop(*[f"_raw_{c}" for c in self.modes],
                        *[f"{c}_{t}" for c in self.modes for t in ("value", "slot")]), F.col("accepted")


def modal_scalars(modal: list[float], modes: list[Mode]) -> list[float]:
    """Each modal value normalized by the mode whose mean is nearest; a missing marker gives 0."""
    out = []
    for v in modal:
        if v == MISSING:
            out.append(0.0)
            continue
        near = min(modes, key=lambda m: abs(m.mean - v))
        out.append(float(np.clip((v - near.mean) / (SPREAD * near.sd), -EDGE, EDGE)))
    return out


def mode_normalize(df: DataFrame, cols, mixed: dict[str, tuple] | None = None, max_modes: int = 10,
                   eps: float = 0.005) -> ModeModel:
    """Fit modes for continuous columns and, with their modal values set apart, for mixed ones."""
    mixed = {c: [float(v) for v in vs] for c, vs in (mixed or {}).items()}
    every = [*cols, *[c for c in mixed if c not in cols]]
    # the missing marker is not a number of the column: it must not stretch the fitted range
    where = {c: ~F.col(c).cast("double").isin(vs) for c, vs in mixed.items()}
    present = {c: F.col(c).cast("double") != F.lit(MISSING) for c in mixed}
    modes = active_modes(df, mixture_1d(df, every, max_modes, where=where), eps, where)
    whole = mixture_1d(df, list(mixed), max_modes, where=present) if mixed else {}
    num = lambda c: F.when(present[c], F.col(c).cast("double")) if c in present else F.col(c).cast("double")
    lim = df.agg(*[f(num(c)).alias(f"{t}{i}") for i, c in enumerate(every) for t, f in (("lo", F.min), ("hi", F.max))]).first()
    low = {c: lim[f"lo{i}"] for i, c in enumerate(every)}
    for c, vs in mixed.items():
        if MISSING in vs:
            low[c] = min(low[c], MISSING)
    return ModeModel(modes, mixed, {c: modal_scalars(vs, whole[c]) for c, vs in mixed.items()}, {},
                     low, {c: lim[f"hi{i}"] for i, c in enumerate(every)})
