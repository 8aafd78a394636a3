"""Clustering and class-by-cluster statistics."""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.bounds import BoundExceeded, collect_bounded, join_model
from ballast.functions.draws import pick, uniform
from ballast.functions.ranks import expand, ranked
from ballast.functions.store import written
from ballast.functions.sums import array_sums
from ballast.operators.encode import feature_array, fit_one_hot, min_max
from ballast.operators.kmeans import fit_all, matrices, nearest, packed, seeds_of, weighted_points
from ballast.operators.neighbors import vector
from ballast.operators.prepare import class_counts
from ballast.operators.ward import distinct_points, merge_below, merge_rounds, roots
from ballast.spec import TableSpec, refuse_stream

# Fixed values of the published procedure.
CLUSTER_PENALTY = 0.02   # added per cluster when choosing their number
PUBLISHED_CLUSTERS, PUBLISHED_ROUNDS = 20, 100  # limits of the reference's experiments: clusters or components, and rounds of EM
MAX_MOMENTS = 5_000_000  # sums that one round of EM brings to the driver
SCORED = 4096            # rows that go down the isolation trees together
COVARIANCES = ("spherical", "tied", "diag", "full")


def cluster_features(df: DataFrame, spec: TableSpec, out: str = "features") -> DataFrame:
    """Min-max scaled continuous features and one-hot categories as one array column."""
    cont = [c for c in spec.features if c not in spec.categorical]
    cats = [c for c in spec.features if c in spec.categorical]
    hot = fit_one_hot(df, cats)
    keep = df.select("*", *[F.col(c).alias(f"_f_{c}") for c in spec.features])
    names = {f"_f_{c}": c for c in spec.features}
    coded = keep
    if cont:
        m = min_max(df, cont)
        coded = coded.withColumns({f"_f_{c}": (F.col(c).cast("double") - m.shift[c]) / m.scale[c] for c in cont})
    if cats:
        coded = coded.withColumns({f"_f_{c}": F.array(*[F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for v in hot.vocabulary[c]]) for c in cats})
    parts = [F.col(n) if c in cats else F.array(F.col(n)) for n, c in names.items()]
    return coded.withColumn(out, F.concat(*parts)).drop(*names)


def total_squares(df: DataFrame, features: str) -> float:
    """Sum of squared distances from the overall mean, from one aggregation."""
    dims = len(df.select(features).first()[0])
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.col(features)[i]).alias(f"v{i}") for i in range(dims)]).first()
    return float(row["n"] * sum(row[f"v{i}"] for i in range(dims)))


# ---------------------------------------------------------------- k-means

@dataclass
class Choice:
    """The chosen number of clusters, every candidate's score, and the fitted labels."""

    k: int
    scores: dict[int, float]
    labelled: DataFrame
    detail: dict = field(default_factory=dict)


def choose_k_kmeans(df: DataFrame, features: str = "features", max_clusters: int = 10, seed: int = 42) -> Choice:
    """k in [2, max) of least within-squares / total-squares + 0.02 k; adds ``cluster``.

    All k are fitted together: equal vectors are one weighted row, and a round of every model is
    one pass and one sum of arrays.  ``detail["centres"]`` holds the centres of every k.
    Labels follow from the centres and are not written: a caller that reads them often writes the columns it needs.
    """
    refuse_stream(df, "choose_k_kmeans")
    points = weighted_points(df, features)
    packs = packed(points)
    seeds = seeds_of(points, max_clusters - 1, seed, packs)["all"]
    total = float(seeds.n * seeds.var.sum()) or 1.0
    fitted = fit_all(points, seeds, range(2, max_clusters), seed, packs=packs)
    scores = {k: within / total + CLUSTER_PENALTY * k for k, (_, within) in fitted.items()}
    best = min(scores, key=lambda k: (scores[k], k))
    labelled = df.withColumn("cluster", nearest(features, fitted[best][0]))
    return Choice(best, scores, labelled, {"centres": {k: c for k, (c, _) in fitted.items()}})


def inertia_score(df: DataFrame, cluster: str, features: str) -> DataFrame:
    """(k, score) of a given labelling: within-squares / total-squares + 0.02 k, from moments."""
    dims = len(df.select(features).first()[0])
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.col(features)[i]).alias(f"v{i}") for i in range(dims)])
    within = per.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * sum((F.col(f"v{i}") for i in range(dims)), F.lit(0.0))).alias("w"))
    return within.select("k", (F.col("w") / F.lit(total_squares(df, features)) + F.lit(CLUSTER_PENALTY) * F.col("k")).alias("score"))


# ---------------------------------------------------------------- Gaussian mixtures

@dataclass
class Mixture:
    """One fitted Gaussian mixture; ``cov`` is k x d x d whatever the covariance type."""

    kind: str
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    loglik: float = -math.inf
    rows: float = 0.0

    @property
    def k(self) -> int:
        return len(self.weight)

    @property
    def bic(self) -> float:
        d = self.mean.shape[1]
        shape = {"full": self.k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": self.k * d, "spherical": self.k}[self.kind]
        return -2.0 * self.loglik + (self.k * d + self.k - 1 + shape) * math.log(max(self.rows, 1.0))

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, rows by components; the largest array has rows * k * d numbers."""
        d = x.shape[1]
        apart = x[None, :, :] - self.mean[:, None, :]
        if self.kind in ("diag", "spherical"):
            var = np.diagonal(self.cov, axis1=1, axis2=2)
            away, size = np.einsum("kbd,kd->kb", apart * apart, 1.0 / var), 0.5 * np.log(var).sum(1)
        else:
            low = np.linalg.cholesky(self.cov)
            z = apart @ np.linalg.inv(low).transpose(0, 2, 1)
            away, size = (z * z).sum(2), np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
        return (np.log(np.maximum(self.weight, 1e-300)) - size - 0.5 * d * math.log(2 * math.pi)) - 0.5 * away.T


def fit_mixtures(df: DataFrame, features: str, ks, kinds=COVARIANCES, group: str | None = None, rounds: int = 40,
                 tol: float = 1e-3, ridge: float = 1e-6, seed: int = 42) -> dict:
    """EM for every (group, covariance type, k) at once: {group: [Mixture, ...]}.

    Equal vectors of a group are one weighted row.  Each round reads them once: a task adds up one
    array of weighted moments for every model still moving, and arrays are added in a tree of
    tasks, so the driver receives a few arrays of the models' own size.  Means begin at
    centres that are spread over all rows, see :func:`~ballast.operators.kmeans.seeds_of`.
    """
    refuse_stream(df, "fit_mixtures")
    points = weighted_points(df, features, group)
    dims, ks = len(points.first()["x"]), list(ks)
    seeds = seeds_of(points, max(ks), seed)
    cells = sum(len(kinds) * k * (1 + dims + (dims * dims if {"full", "tied"} & set(kinds) else dims)) for k in ks) * len(seeds)
    if cells > MAX_MOMENTS:
        raise BoundExceeded(f"{cells} moments per round; use fewer features or only diag and spherical covariances")
    models: dict[tuple, Mixture] = {}
    for name, s in seeds.items():
        var = s.var + ridge
        for k in [k for k in ks if k <= s.n]:
            mean = s.centres(k, seed)
            for kind in kinds:
                start = np.diag(var) if kind != "spherical" else np.eye(dims) * var.mean()
                models[(name, kind, k)] = Mixture(kind, np.full(k, 1 / k), mean.copy(), np.repeat(start[None], k, 0))
    middle = {name: s.mean for name, s in seeds.items()}
    moving = set(models)
    for _ in range(rounds):
        if not moving:
            break
        keys = sorted(moving)
        active = [(i, key, models[key]) for i, key in enumerate(keys)]

        def moments(batches):
            sums: dict[int, np.ndarray] = {}
            for name, x, w, _ in matrices(batches, dims * max(dims, *ks)):
                y = x - middle[name]  # moments about the group's middle keep the digits that moments about zero lose
                outer = None
                for i, key, model in active:
                    if key[0] != name:
                        continue
                    joint = model.log_joint(x)
                    top = joint.max(1, keepdims=True)
                    p = np.exp(joint - top)
                    norm = p.sum(1, keepdims=True)
                    loglik = float((w[:, None] * (top + np.log(norm))).sum())
                    p *= w[:, None] / norm
                    if key[1] in ("full", "tied") and outer is None:
                        outer = (y[:, :, None] * y[:, None, :]).reshape(len(y), -1)
                    second = p.T @ (outer if key[1] in ("full", "tied") else y * y)
                    part = np.concatenate([[loglik], np.hstack([p.sum(0)[:, None], p.T @ y, second]).ravel()])
                    sums[i] = sums[i] + part if i in sums else part
            return sums

        total = array_sums(points, moments)
        for i, key, m in active:
            n = seeds[key[0]].n
            loglik, table = float(total[i][0]), total[i][1:].reshape(m.k, -1)
            size = table[:, 0] + 1e-10
            mean = table[:, 1:1 + dims] / size[:, None]
            if m.kind in ("full", "tied"):
                second = table[:, 1 + dims:].reshape(m.k, dims, dims)
                cov = second / size[:, None, None] - mean[:, :, None] * mean[:, None, :]
                if m.kind == "tied":
                    cov = np.repeat(((second.sum(0) - np.einsum("k,ki,kj->ij", size, mean, mean)) / n)[None], m.k, 0)
            else:
                var = np.maximum(table[:, 1 + dims:] / size[:, None] - mean ** 2, 0.0)
                if m.kind == "spherical":
                    var = np.repeat(var.mean(1, keepdims=True), dims, 1)
                cov = np.array([np.diag(v) for v in var])
            cov = (cov + cov.transpose(0, 2, 1)) / 2 + ridge * np.eye(dims)
            change = (loglik - m.loglik) / n
            models[key] = Mixture(m.kind, size / size.sum(), mean + middle[key[0]], cov, loglik, n)
            if abs(change) < tol:
                moving.discard(key)
    out: dict[str, list[Mixture]] = {}
    for (name, _, _), m in models.items():
        out.setdefault(name, []).append(m)
    return out


def best_mixture(models: list[Mixture]) -> Mixture:
    """Least Bayes information criterion; fewer components win ties."""
    return min(models, key=lambda m: (m.bic, m.k, COVARIANCES.index(m.kind)))


def mixture_label(features: str, model: Mixture) -> Column:
    """Most probable component of each row."""

    @F.pandas_udf("int")
    def label(x: pd.Series) -> pd.Series:
        return pd.Series(model.log_joint(np.vstack(x.to_numpy()).astype(float)).argmax(1).astype(np.int32)) if len(x) else pd.Series([], dtype="int32")

    return label(F.col(features))


def choose_k_mixture(df: DataFrame, features: str = "features", max_clusters: int = 10, seed: int = 42, rounds: int = 40) -> Choice:
    """Components and covariance type of least BIC; adds ``cluster``."""
    models = fit_mixtures(df, features, range(2, max_clusters), rounds=rounds, seed=seed)["all"]
    best = best_mixture(models)
    scores = {k: min(m.bic for m in models if m.k == k) for k in {m.k for m in models}}
    return Choice(best.k, scores, df.withColumn("cluster", mixture_label(features, best)),
                  {"kind": best.kind, "model": best, "all": {(m.kind, m.k): m.bic for m in models}})


def class_subspaces(df: DataFrame, features: str, label: str, max_components: int = 5, seed: int = 42, rounds: int = 40):
    """Per class a mixture of least BIC, components numbered on from class to class.

    Returns the labelled rows (``cluster``) and a model table (class, cluster, probability, mean,
    cov).  All clusters of a class are equally likely; a class with one row is one point without spread.
    """
    fitted = fit_mixtures(df, features, range(1, max_components + 1), group=label, rounds=rounds, seed=seed)
    kind = df.schema[label].dataType
    names = {str(r[label]): r for r in collect_bounded(class_counts(df, label), "classes", 1000)}
    rows, start, pieces = [], 0, F.lit(None).cast("int")
    for name in sorted(fitted, key=lambda s: names[s][label]):
        m = best_mixture(fitted[name])
        if names[name]["n"] < 2:
            m = Mixture(m.kind, m.weight, m.mean, np.zeros_like(m.cov), m.loglik, m.rows)
        value = names[name][label]
        own = mixture_label(features, m) if m.k > 1 else F.lit(0)
        pieces = F.when(F.col(label) == F.lit(value), (own + start).cast("int")).otherwise(pieces)
        rows += [(value, start + j, 1.0 / m.k, m.kind, [float(v) for v in m.mean[j]], [float(v) for v in m.cov[j].ravel()]) for j in range(m.k)]
        start += m.k
    schema = T.StructType([T.StructField(label, kind), T.StructField("cluster", T.IntegerType()), T.StructField("p", T.DoubleType()),
                           T.StructField("kind", T.StringType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
                           T.StructField("cov", T.ArrayType(T.DoubleType()))])
    return df.withColumn("cluster", pieces), df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------- Ward agglomeration

def _rooted(points: DataFrame, low: DataFrame, cut=()) -> DataFrame:
    """(vec, _root): the smallest point of each point's cluster in the forest of ``low``, see :func:`~ballast.operators.ward.roots`."""
    named = points.join(roots(low, cut).withColumnRenamed("node", "id"), "id", "left")
    return written(named.select("vec", F.coalesce("root", "id").alias("_root")), "ward-named")


def _by_point(df: DataFrame, features: str, named: DataFrame) -> DataFrame:
    """``df`` with what ``named`` has of each row's vector.  Rows are joined as they are read, so a caller pays for the columns it uses alone."""
    hashed = lambda rows: rows.withColumn("_h", F.xxhash64("vec"))  # numbers are sorted faster than vectors
    return hashed(df.withColumn("vec", F.col(features).cast("array<double>"))).join(hashed(named), ["_h", "vec"]).drop("_h", "vec")


def hierarchical(df: DataFrame, features: str = "features", k: int | None = None, max_clusters: int = 10, seed: int = 42) -> Choice:
    """Ward clusters over all distinct points, k given or chosen as for k-means; adds ``cluster``, numbered by their smallest vectors.

    The squares within the clusters of a cut are half the costs of the merges below it, so all k are scored from the tree.
    Of merges of equal cost the later one counts as higher.  The result needs no draw; ``seed`` is there for the callers' sake.
    """
    refuse_stream(df, "hierarchical")
    points = distinct_points(df, features)
    edges = merge_rounds(points)
    most = k or max(max_clusters - 1, 1)
    facts = edges.agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).first()
    order = ["cost", "turn", "step", "node"]
    top = [r.asDict() for r in edges.orderBy(*[F.desc(c) for c in order]).limit(most - 1).collect()]  # at most one less than the clusters
    low = edges if not top else edges.where(F.struct(*order) < F.struct(*[F.lit(top[-1][c]).cast(edges.schema[c].dataType).alias(c) for c in order]))
    total = float(facts["cost"] or 0.0) or 1.0
    tries = [k] if k else [j for j in range(2, max_clusters) if j <= facts["n"] + 1] or [1]
    scores = {j: (total - sum(m["cost"] for m in top[:j - 1])) / total + CLUSTER_PENALTY * j for j in tries}
    best = min(scores, key=lambda j: (scores[j], j))
    named = _rooted(points, low, {m["turn"] for m in top})
    base = sorted(r["_root"] for r in collect_bounded(named.select("_root").distinct(), "clusters"))
    into = {m["node"]: m["into"] for m in top[best - 1:]}

    def root(b: int) -> int:
        while b in into:
            b = into[b]
        return b

    number = {r: i for i, r in enumerate(sorted({root(b) for b in base}))}
    names = df.sparkSession.createDataFrame([(b, number[root(b)]) for b in base], "_root BIGINT, cluster INT")
    return Choice(best, scores, _by_point(df, features, join_model(named, names, "_root").drop("_root")), {"merges": [(m["node"], m["into"], math.sqrt(m["cost"])) for m in top]})


def ward(df: DataFrame, features: str, distance_threshold: float, seed: int = 42) -> DataFrame:
    """Ward clusters of all distinct points, merged while the distance (root of the cost) stays below the threshold; adds ``cluster``, numbered by their smallest vectors."""
    refuse_stream(df, "ward")
    points = distinct_points(df, features)
    named = _rooted(points, merge_below(points, distance_threshold))
    numbers = ranked(written(named.select("_root").distinct(), "ward-names"), [], "_root").select("_root", (F.col("rank") - 1).cast("int").alias("cluster"))
    return _by_point(df, features, named.join(numbers, "_root").drop("_root"))


# ---------------------------------------------------------------- class-by-cluster statistics

def cluster_profile(df: DataFrame, cluster: str, cols, label: str | None = None) -> DataFrame:
    """Per cluster: rows, min and max of each column and, given a label, its class counts as a map."""
    wide = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{t}_{c}")
                                                                   for c in cols for t, f in (("min", F.min), ("max", F.max))])
    if not label:
        return wide
    per = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    maps = per.groupBy(cluster).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).cast("string"), "_n")))).alias("classes"))
    return wide.join(maps, cluster)


def p_cluster_given_class(df: DataFrame, cluster: str, label: str, absent: bool = True) -> DataFrame:
    """(label, cluster, n, p) for every class and cluster; pairs that do not occur have 0, or no row without ``absent``."""
    counts = written(df.groupBy(label, cluster).agg(F.count(F.lit(1)).alias("n")), "class-clusters")
    totals = counts.groupBy(label).agg(F.sum("n").alias("_all"))
    pairs = counts.select(label, cluster)
    if absent:  # the classes are few (checked), so every cluster carries the list of them
        classes = sorted(r[label] for r in collect_bounded(totals.select(label), "classes", 10_000))
        listed = F.array(*[F.lit(c) for c in classes]).cast(T.ArrayType(df.schema[label].dataType))
        pairs = counts.select(cluster).distinct().withColumn(label, F.explode(listed))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return join_model(pairs.join(counts, [label, cluster], "left"), totals, label) \
        .select(label, cluster, n.alias("n"), (n / F.col("_all")).alias("p"))


# ---------------------------------------------------------------- outliers and padding

def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """One isolation tree as rows (feature, cut, left, right, leaf size)."""
    nodes: list = []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(None)
        part = x[rows]
        span = part.max(0) - part.min(0) if len(part) else np.zeros(x.shape[1])
        if level >= depth or len(rows) <= 1 or not span.any():
            nodes[me] = (-1, 0.0, -1, -1, len(rows), level)
            return me
        f = int(rng.choice(np.nonzero(span)[0]))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        go = part[:, f] <= cut
        nodes[me] = (f, cut, build(rows[go], level + 1), build(rows[~go], level + 1), 0, level)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _path(n: np.ndarray | float):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1)))


def _stepped(tree: list[tuple]) -> tuple:
    """A tree for steps that all rows take together: a leaf leads to itself, so every row takes as many steps as the tree is deep."""
    feature, cut, left, right, size, level = (np.array(c) for c in zip(*tree))
    inner, me = feature >= 0, np.arange(len(feature))
    child = np.stack([np.where(inner, right, me), np.where(inner, left, me)], 1).ravel()
    return np.where(inner, feature, 0), cut.astype(float), child, level + _path(size), int(level.max())


def isolation_score(df: DataFrame, spec: TableSpec, trees: int = 100, rows: int = 256, seed: int = 42):
    """A column expression with the isolation score (0..1) of a row.

    The trees come from a hash-drawn sample of at most trees * rows rows; they are the model, and
    scoring of the table runs batch-wise in the executors.
    """
    total = df.count()
    rid = list(spec.row_id)
    draw = uniform("isolation", *rid, seed=seed)
    share = min(1.0, 1.5 * trees * rows / max(total, 1))
    picked = df.where(draw < share).select(draw.alias("u"), vector(spec.features).alias("x")).orderBy("u", "x").limit(3 * trees * rows).collect()
    picked = np.array([r["x"] for r in sorted(picked, key=lambda r: r["u"])], dtype=float)
    rng = np.random.default_rng(seed)
    per = min(rows, len(picked))
    depth = max(1, math.ceil(math.log2(max(per, 2))))
    forest = [_grow(picked[rng.choice(len(picked), per, replace=False)], rng, depth) for _ in range(trees)]
    norm = float(_path(per)) or 1.0
    trees_as_arrays = [_stepped(t) for t in forest]

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        for lo in range(0, len(v), SCORED):
            x = np.concatenate(v.iloc[lo:lo + SCORED].to_numpy()).astype(float).reshape(-1, len(spec.features)).T
            n, flat, length = x.shape[1], np.ascontiguousarray(x).ravel(), np.zeros(x.shape[1])
            row = np.arange(n)
            for feature, cut, child, leaf, steps in trees_as_arrays:
                node, begin = np.zeros(n, np.int64), feature * n
                for _ in range(steps):
                    node = child.take(2 * node + (flat.take(begin.take(node) + row) <= cut.take(node)))
                length += leaf.take(node)
            out[lo:lo + n] = 2.0 ** (-length / len(trees_as_arrays) / norm)
        return pd.Series(out)

    return score(vector(spec.features))


def drop_majority_outliers(df: DataFrame, spec: TableSpec, seed: int = 42, limit: float = 0.5, trees: int = 100) -> DataFrame:
    """Remove majority-class rows whose isolation score exceeds the limit; other classes stay whole."""
    refuse_stream(df, "drop_majority_outliers")
    counts = collect_bounded(class_counts(df, spec.label), "classes", 10_000)
    top = min(counts, key=lambda r: (-r["n"], r[spec.label]))[spec.label]
    major = df.where(F.col(spec.label) == F.lit(top))
    kept = major.withColumn("_s", isolation_score(major, spec, trees=trees, seed=seed)).where(F.col("_s") <= limit).drop("_s")
    return kept.unionByName(df.where(F.col(spec.label) != F.lit(top)))


def pad_to_multiple(df: DataFrame, row_id: str, multiple: int, seed: int = 42) -> DataFrame:
    """Append rows drawn with replacement until the row count is a multiple of ``multiple``."""
    refuse_stream(df, "pad_to_multiple")
    n = df.count()
    need = -n % multiple
    if not need or not n:
        return df
    slots = expand(df.sparkSession.createDataFrame([(need,)], "need BIGINT"), "need") \
        .select(pick("pad", n, "copy", seed=seed).alias("rank"))
    rows = ranked(df, [], row_id)
    return df.unionByName(slots.join(rows, "rank").select(*df.columns))
