"""Conditional sampling from fitted distributions.

Every synthetic row is a slot (class, copy); its values are functions of hash draws on that slot,
so rows are made where they are needed and the same seed gives the same table on any cluster.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ballast.functions.bounds import collect_bounded, join_model
from ballast.functions.draws import choose_by_weight, normal, pick, uniform
from ballast.functions.ranks import expand, ranked
from ballast.functions.store import written
from ballast.operators.cluster import choose_k_kmeans, class_subspaces, cluster_features, p_cluster_given_class
from ballast.operators.counts import CountPlan, balance_clusters, plan_counts
from ballast.operators.encode import array_to_vector, min_max, per_group_scale
from ballast.operators.prepare import class_counts, value_counts
from ballast.operators.resample import append_synthetic
from ballast.spec import TableSpec, refuse_stream, validate_columns

# Fixed value: added to every probability before an index is drawn.
SMOOTHING = 1e-6
QUANTILES = 401


def _slots(df: DataFrame, plan: CountPlan) -> DataFrame:
    return expand(plan.table(df).where("need > 0"), "need").drop("need", "n")


def _whole_columns(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.ShortType))]


# ---------------------------------------------------------------- conditions

def category_probs(df: DataFrame, cols, log: bool = True) -> DataFrame:
    """(column, value, n, p): p proportional to ln(n + 1), or to n without ``log``."""
    w = F.log(F.col("n") + 1.0) if log else F.col("n").cast("double")
    counts = value_counts(df, cols).withColumn("w", w)
    total = counts.groupBy("column").agg(F.sum("w").alias("_t"))
    return join_model(counts, total, "column").select("column", "value", "n", (F.col("w") / F.col("_t")).alias("p"))


def draw_conditions(spark: SparkSession, n: int, probs: DataFrame, cols, seed: int = 42) -> DataFrame:
    """n conditions (draw, column, value, mask): a random column, then a value by its probability.

    ``mask`` is the 0/1 vector over the columns as text.
    """
    model: dict[str, list] = {c: [] for c in cols}
    for r in sorted(collect_bounded(probs.select("column", "value", "p"), "categories"), key=lambda r: r["value"]):
        model[r["column"]].append(r)
    which = pick("cond.col", len(cols), "draw", seed=seed)
    value = F.lit(None).cast("string")
    mask, name = F.lit(""), F.lit("")
    for i, c in enumerate(cols):
        drawn = _weighted_value(uniform("cond.val", "draw", seed=seed), [r["value"] for r in model[c]], [r["p"] for r in model[c]])
        value = F.when(which == i + 1, drawn).otherwise(value)
        name = F.when(which == i + 1, F.lit(c)).otherwise(name)
        mask = F.when(which == i + 1, F.lit("".join("1" if j == i else "0" for j in range(len(cols))))).otherwise(mask)
    return spark.range(1, n + 1).withColumnRenamed("id", "draw") \
        .select("draw", name.alias("column"), value.alias("value"), mask.alias("mask"))


def _weighted_value(draw: Column, values: list[str], weights: list[float]) -> Column:
    """The value whose cumulative weight first exceeds the draw; a long list is searched, not walked."""
    if len(values) <= 64:
        return F.element_at(F.array(*[F.lit(v) for v in values]), choose_by_weight(draw, weights) + 1)
    upto, total, names = np.cumsum(weights)[:-1], math.fsum(weights), np.array(values, dtype=object)

    @F.pandas_udf("string")
    def at(draws: pd.Series) -> pd.Series:
        return pd.Series(names[np.searchsorted(upto, draws.to_numpy(float) * total, side="right")])

    return at(draw)


def sample_matching(df: DataFrame, conditions: DataFrame, cols, row_id: str, seed: int = 42) -> DataFrame:
    """One uniformly drawn real row per condition (draw, column, value) that has the requested value.

    Rows are numbered within each (column, value); a condition draws a number, so a frequent value is
    spread over as many keys as it has rows.
    """
    refuse_stream(df, "sample_matching")
    long = df.select(row_id, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([row_id], list(cols), "column", "value")
    numbered = ranked(long.where(F.col("value").isNotNull()), ["column", "value"], row_id)
    sizes = value_counts(df, cols)
    wanted = join_model(conditions, sizes, ["column", "value"]) \
        .withColumn("rank", pick("match", F.col("n"), "draw", seed=seed)).drop("n")
    found = wanted.join(numbered, ["column", "value", "rank"]).select("draw", F.col("column").alias("_column"), F.col("value").alias("_value"), row_id)
    return found.join(df, row_id).select("draw", F.col("_column").alias("column"), F.col("_value").alias("value"), *df.columns)


def categorical_draw(draw: Column, p: Column) -> Column:
    """Zero-based index drawn from a probability array, each entry raised by 1e-6."""
    return choose_by_weight(draw, F.transform(p, lambda v: v + F.lit(SMOOTHING)))


# ---------------------------------------------------------------- clusters of a class

def cluster_weights(p: DataFrame, cluster: str, label: str) -> DataFrame:
    """(label, clusters, weights): each class's clusters in order with their probabilities."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("p").alias("p"))))  # one entry per cluster
    return p.groupBy(label).agg(pairs.alias("_a")).select(
        label, F.transform("_a", lambda e: e["c"]).alias("clusters"), F.transform("_a", lambda e: e["p"]).alias("weights"))


def draw_cluster(slots: DataFrame, p: DataFrame, cluster: str, label: str, seed: int = 42, fixed=None,
                 keys: tuple[str, ...] = ("copy",)) -> DataFrame:
    """Add a cluster to every slot: drawn by P(cluster | class), or ``fixed``.

    Slots without a class column first get one of the classes, each equally likely.
    """
    if label not in slots.columns:
        classes = sorted(r[label] for r in collect_bounded(p.select(label).distinct(), "classes", 10_000))
        at = pick("cluster.class", len(classes), *keys, seed=seed).cast("int")
        slots = slots.withColumn(label, F.element_at(F.array(*[F.lit(c) for c in classes]), at).cast(p.schema[label].dataType))
    if fixed is not None:
        return slots.withColumn(cluster, F.lit(fixed).cast(p.schema[cluster].dataType))
    joined = join_model(slots, cluster_weights(p, cluster, label), label)
    at = choose_by_weight(uniform("cluster", label, *keys, seed=seed), F.col("weights"))
    return joined.withColumn(cluster, F.element_at("clusters", at + 1)).drop("clusters", "weights")


# ---------------------------------------------------------------- Gaussian copula

@dataclass
class CopulaModel:
    """Marginal tables, category limits and the correlation of the normal scores."""

    spec: TableSpec
    grid: np.ndarray                       # normal scores of the quantile points
    quantiles: dict[str, np.ndarray]       # continuous columns
    categories: dict[str, list]            # discrete columns: [(value, upper cumulative share, score)]
    corr: np.ndarray
    whole: list[str]

    @property
    def order(self) -> list[str]:
        return [*self.spec.features, self.spec.label]


def _scores(df: DataFrame, model_cols: list[str], quantiles: dict[str, np.ndarray], grid: np.ndarray, categories: dict[str, list]) -> Column:
    parts = []
    for c in model_cols:
        if c in quantiles:
            xs, zs = _increasing(quantiles[c], grid)
            parts.append(_interpolate(F.col(c).cast("double"), xs, zs))
        else:
            parts.append(_category_score(F.col(c), categories[c]))
    return F.array(*parts)


def _category_score(value: Column, known: list) -> Column:
    """The score of a category, 0 for one that was not seen."""
    of = {v: z for v, _, z in known}

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return values.map(of).fillna(0.0).astype(float)

    return score(value.cast("string"))


def _category_at(z: Column, known: list) -> Column:
    """The category whose range of scores holds ``z``, by binary search."""
    cuts = np.array([NormalDist().inv_cdf(min(max(upper, 1e-9), 1 - 1e-9)) for _, upper, _ in known[:-1]])
    names = np.array([v for v, _, _ in known], dtype=object)

    @F.pandas_udf("string")
    def category(scores: pd.Series) -> pd.Series:
        return pd.Series(names[np.searchsorted(cuts, scores.to_numpy(float), side="right")])

    return category(z)


def _interpolate(x: Column, at: np.ndarray, to: np.ndarray) -> Column:
    """Piecewise linear map through the points (at, to), flat outside."""

    @F.pandas_udf("double")
    def curve(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v.to_numpy(float), at, to))

    return curve(x)


def _increasing(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One point per distinct quantile, at the mean score of its repeats."""
    values, where = np.unique(x, return_inverse=True)
    return values, np.bincount(where, z) / np.bincount(where)


def fit_copula(df: DataFrame, spec: TableSpec) -> CopulaModel:
    """Marginals from quantile tables and category shares, dependence from the scores' correlation."""
    refuse_stream(df, "fit_copula")
    cont = [c for c in spec.features if c not in spec.categorical]
    disc = [*[c for c in spec.features if c in spec.categorical], spec.label]
    probs = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"q{i}") for i, c in enumerate(cont)]).first() if cont else {}
    grid = np.array([NormalDist().inv_cdf(min(max(p, 0.5 / QUANTILES), 1 - 0.5 / QUANTILES)) for p in probs])
    quantiles = {c: np.array(row[f"q{i}"], dtype=float) for i, c in enumerate(cont)}
    categories: dict[str, list] = {c: [] for c in disc}
    counts = sorted(collect_bounded(value_counts(df, disc), "categories", 10_000), key=lambda r: (r["column"], -r["n"], r["value"]))
    for c in disc:
        mine = [r for r in counts if r["column"] == c]
        total, run = sum(r["n"] for r in mine), 0
        for r in mine:
            middle = (run + r["n"] / 2) / total
            run += r["n"]
            categories[c].append((r["value"], run / total, NormalDist().inv_cdf(min(max(middle, 1e-9), 1 - 1e-9))))
    model_cols = [*spec.features, spec.label]
    z = df.select(array_to_vector(_scores(df, model_cols, quantiles, grid, categories)).alias("z"))
    corr = np.nan_to_num(np.array(Correlation.corr(z, "z").first()[0].toArray()))
    np.fill_diagonal(corr, 1.0)
    return CopulaModel(spec, grid, quantiles, categories, corr, _whole_columns(df, cont))


def _root(cov: np.ndarray) -> np.ndarray:
    """A matrix square root that tolerates a singular matrix."""
    value, vector_ = np.linalg.eigh((cov + cov.T) / 2)
    return vector_ * np.sqrt(np.maximum(value, 0.0))


def sample_copula(model: CopulaModel, slots: DataFrame, given: bool = True, seed: int = 42) -> DataFrame:
    """Feature values for every slot; with ``given`` the slot's label is a condition on them."""
    spec, d = model.spec, len(model.spec.features)
    label = spec.label
    if given:
        rho = model.corr[:d, d]
        root = _root(model.corr[:d, :d] - np.outer(rho, rho))
        score = _category_score(F.col(label), model.categories[label])
        centre = [score * float(r) for r in rho]
        keys = [label, "copy"]
    else:
        root, centre, keys = _root(model.corr), [F.lit(0.0)] * (d + 1), ["copy"]
    size = root.shape[0]
    drawn = slots.withColumns({f"_e{j}": normal(f"copula.{j}", *keys, seed=seed) for j in range(size)})
    z = {f"_z{i}": sum((F.col(f"_e{j}") * float(root[i, j]) for j in range(size)), centre[i]) for i in range(size)}
    out = drawn.withColumns(z).drop(*[f"_e{j}" for j in range(size)])
    names = list(spec.features) if given else model.order
    values = {}
    for i, c in enumerate(names):
        if c in model.quantiles:
            x = _interpolate(F.col(f"_z{i}"), model.grid, model.quantiles[c])
            values[c] = F.rint(x) if c in model.whole else x
        else:
            values[c] = _category_at(F.col(f"_z{i}"), model.categories[c])
    return out.withColumns(values).drop(*z)


def gaussian_copula(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42) -> DataFrame:
    """Resampler: new rows of each class from a Gaussian copula conditioned on the class."""
    validate_columns(df, [*spec.features, spec.label])
    plan = plan_counts(df, spec.label, strategy)
    made = sample_copula(fit_copula(df, spec), _slots(df, plan), seed=seed).drop("copy")
    return append_synthetic(df, made, plan.keep_real)


# ---------------------------------------------------------------- class subspaces

def sample_subspace(slots: DataFrame, model: DataFrame, label: str, dims: int, seed: int = 42, out: str = "features") -> DataFrame:
    """For every slot (label, copy) a draw from a Gaussian of one of its class's components."""
    params: dict[int, tuple] = {}
    choices: dict = {}
    for r in collect_bounded(model, "components", 10_000):
        cov = np.array(r["cov"]).reshape(dims, dims)
        params[r["cluster"]] = (np.array(r["mean"]), _root(cov))
        choices.setdefault(r[label], []).append(r["cluster"])
    schema = T.StructType([model.schema[label], T.StructField("_list", T.ArrayType(T.IntegerType()))])
    lists = slots.sparkSession.createDataFrame([(c, sorted(v)) for c, v in choices.items()], schema)
    drawn = slots.join(F.broadcast(lists), label) \
        .withColumn("cluster", F.element_at("_list", pick("subspace", F.size("_list"), label, "copy", seed=seed).cast("int"))).drop("_list") \
        .withColumn("_e", F.array(*[normal(f"subspace.{j}", label, "copy", seed=seed) for j in range(dims)]))

    def place(batches):
        for pdf in batches:
            e = np.vstack(pdf["_e"].to_numpy()) if len(pdf) else np.zeros((0, dims))
            x = np.zeros_like(e)
            for c in pdf["cluster"].unique():
                at = (pdf["cluster"] == c).to_numpy()
                mean, root = params[int(c)]
                x[at] = mean + e[at] @ root.T
            yield pdf.drop(columns="_e").assign(**{out: list(x)})

    fields = [f for f in drawn.schema.fields if f.name != "_e"]
    return drawn.mapInPandas(place, T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def subspace_resample(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, max_components: int = 5, rounds: int = 30) -> DataFrame:
    """Resampler: fit :func:`class_subspaces` on scaled features and sample the classes to raise."""
    cont = [c for c in spec.features if c not in spec.categorical]
    if len(cont) != len(spec.features):
        raise ValueError("categorical features: wrap the operator in resample_encoded")
    plan = plan_counts(df, spec.label, strategy)
    scaler = min_max(df, cont)
    scaled = cluster_features(df, spec)
    _, model = class_subspaces(scaled, "features", spec.label, max_components, seed, rounds)
    made = sample_subspace(_slots(df, plan), model, spec.label, len(cont), seed)
    made = scaler.inverse(made.withColumns({c: F.col("features")[i] for i, c in enumerate(cont)}))
    made = made.withColumns({c: F.rint(c) for c in _whole_columns(df, cont)})
    return append_synthetic(df, made.select(spec.label, *cont), plan.keep_real)


# ---------------------------------------------------------------- clustered sampling

def sample_clustered(df: DataFrame, spec: TableSpec, slots: DataFrame, cluster: str = "cluster", seed: int = 42,
                     given_cluster: bool = False) -> DataFrame:
    """Values for slots (label, copy): cluster by P(cluster | class), then normal draws with the mean
    and deviation of the (class, cluster) on scaled columns, categories by their counts there; scaled
    back per cluster and clipped to the cluster's range.  ``df`` carries cluster labels."""
    label = spec.label
    cont = [c for c in spec.features if c not in spec.categorical]
    cats = [c for c in spec.features if c in spec.categorical]
    if not given_cluster:
        slots = draw_cluster(slots, p_cluster_given_class(df, cluster, label).where("n > 0"), cluster, label, seed)
    keys, draw_keys = [label, cluster], [label, cluster, "copy"]
    if cont:
        scaler = per_group_scale(df, cont, cluster, "mms11")
        scaled = scaler.transform(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cont]))
        moments = scaled.groupBy(*keys).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_g_{c}") for c in cont])
        slots = join_model(slots, moments, keys)
        slots = slots.withColumns({c: F.col(f"_g_{c}")["m"] + F.col(f"_g_{c}")["s"] * normal(f"clustered.{c}", *draw_keys, seed=seed)
                                   for c in cont}).drop(*[f"_g_{c}" for c in cont])
        slots = scaler.inverse(slots, clip=True)
        slots = slots.withColumns({c: F.rint(c) for c in _whole_columns(df, cont)})
    for c in cats:
        counts = df.groupBy(*keys, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        lists = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_v", "_n"))).alias("_a"))  # bounded by the categories
        slots = join_model(slots, lists, keys)
        at = choose_by_weight(uniform(f"clustered.{c}", *draw_keys, seed=seed), F.transform("_a", lambda e: e["_n"].cast("double")))
        slots = slots.withColumn(c, F.element_at("_a", at + 1)["_v"]).drop("_a")
    return slots


def clustered_resample(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, max_clusters: int = 10) -> DataFrame:
    """Resampler: cluster the rows (k-means, k chosen), then :func:`sample_clustered`.

    The strategy ``balance-clusters`` raises the minority classes of each cluster to its majority.
    """
    scaled = cluster_features(df, spec)
    labelled = choose_k_kmeans(scaled, max_clusters=max_clusters, seed=seed).labelled
    rows = written(labelled.select(spec.label, *spec.features, "cluster"), "clusters")
    if strategy == "balance-clusters":
        need = balance_clusters(rows, "cluster", spec.label).where("need > 0").select("cluster", spec.label, "need")
        made = sample_clustered(rows, spec, expand(need, "need").drop("need"), seed=seed, given_cluster=True)
        return append_synthetic(df, made.select(spec.label, *spec.features))
    plan = plan_counts(df, spec.label, strategy)
    made = sample_clustered(rows, spec, _slots(df, plan), seed=seed)
    return append_synthetic(df, made.select(spec.label, *spec.features), plan.keep_real)


# ---------------------------------------------------------------- acceptance

def accept_matching(df: DataFrame, need: dict, key: str, generate: Callable[[DataFrame], DataFrame], matches: Column,
                    max_tries: int = 100, excess: float = 1.5) -> DataFrame:
    """Generate rows per requested key value and keep those that match, until enough or out of tries.

    ``generate(slots)`` turns slots (key, copy, attempt) into candidate rows that keep these columns.
    Only counts reach the driver; accepted rows of each try are written.  May return fewer rows.
    """
    kind = df.schema[key].dataType
    left, kept, rate = {c: n for c, n in need.items() if n > 0}, None, dict.fromkeys(need, 1.0)
    schema = T.StructType([T.StructField(key, kind), T.StructField("ask", T.LongType()), T.StructField("_left", T.LongType())])
    for attempt in range(1, max_tries + 1):
        if not left:
            break
        ask = [(c, int(n * excess / max(rate[c], 0.01)) + 1, n) for c, n in left.items()]
        asked = {c: a for c, a, _ in ask}
        wanted = df.sparkSession.createDataFrame(ask, schema)
        slots = expand(wanted, "ask").drop("ask", "_left").withColumn("attempt", F.lit(attempt))
        hits = written(generate(slots).where(matches), "accepted")
        got = {r[key]: r["n"] for r in collect_bounded(class_counts(hits, key), "classes", 10_000)}
        if got:
            numbered = ranked(hits, key, "copy", "_place")
            part = written(join_model(numbered, wanted.drop("ask"), key).where(F.col("_place") <= F.col("_left")).drop("_place", "_left"), "accepted")
            kept = part if kept is None else kept.unionByName(part)
        for c in list(left):
            rate[c] = max(got.get(c, 0) / asked[c], 0.01)
            left[c] -= min(left[c], got.get(c, 0))
            if not left[c]:
                del left[c]
    if kept is None:
        empty = df.sparkSession.createDataFrame([], T.StructType([T.StructField(key, kind), T.StructField("copy", T.LongType()), T.StructField("attempt", T.IntegerType())]))
        return generate(empty).where(matches)
    return kept


# ---------------------------------------------------------------- divergence

def kl_by_class(real: DataFrame, synth: DataFrame, cols, label: str, bins: int = 20) -> DataFrame:
    """(label, column, kl): KL divergence of real from synthetic values per class, on shared bins.

    Each side's bin share is (n + 1) / (N + bins), so empty bins stay finite.  Averaging over
    classes and columns gives the overall divergence.
    """
    both = real.select(label, *cols).withColumn("_real", F.lit(1)).unionByName(synth.select(label, *cols).withColumn("_real", F.lit(0)))
    lim = both.agg(*[f(F.col(c).cast("double")).alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("a", F.min), ("b", F.max))]).first()
    parts = []
    for i, c in enumerate(cols):
        lo, width = lim[f"a{i}"], ((lim[f"b{i}"] - lim[f"a{i}"]) or 1.0) / bins
        at = F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        parts.append(F.struct(F.lit(c).alias("column"), at.alias("bin")))
    counts = both.select(label, "_real", F.explode(F.array(*parts)).alias("s")).where(F.col("s.bin").isNotNull()) \
        .groupBy(label, "s.column", "s.bin").agg(F.sum("_real").alias("r"), F.sum(1 - F.col("_real")).alias("g"))
    # bins empty on both sides add p * ln(p / q) with r = g = 0; their number is bins - seen
    sums = counts.groupBy(label, "column").agg(F.sum("r").alias("R"), F.sum("g").alias("G"), F.count(F.lit(1)).alias("seen"),
                                               F.collect_list(F.struct("r", "g")).alias("cells"))  # at most `bins` entries
    p = lambda e: (e["r"] + 1.0) / (F.col("R") + float(bins))
    q = lambda e: (e["g"] + 1.0) / (F.col("G") + float(bins))
    seen = F.aggregate("cells", F.lit(0.0), lambda s, e: s + p(e) * F.log(p(e) / q(e)))
    p0, q0 = 1.0 / (F.col("R") + float(bins)), 1.0 / (F.col("G") + float(bins))
    return sums.select(label, "column", (seen + (F.lit(bins) - F.col("seen")) * p0 * F.log(p0 / q0)).alias("kl"))
