"""Experiments: folds, samplers and classifiers, and their scores as one result table.

Rows stay in Spark.  What an experiment loops over on the driver is its own grid (data sets, folds,
samplers, classifiers); each step is a Spark job and returns a confusion table of classes x classes.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.bounds import collect_bounded
from ballast.functions.ranks import ranked, running_total
from ballast.functions.store import written
from ballast.operators import resample as G
from ballast.operators import synth as H
from ballast.operators.density import dbscan, median_pair_distance
from ballast.operators.cluster import cluster_features, ward
from ballast.operators.discretize import fit_discretizer
from ballast.operators.encode import array_to_vector, fit_one_hot, standardize
from ballast.operators.neighbors import vector
from ballast.operators.prepare import label_encode
from ballast.plans.metrics import confusion, scores, summarize_results
from ballast.plans.split import real_vs_synthetic, stratified_folds
from ballast.sources.results import RESULT_SCHEMA, error_rows
from ballast.spec import TableSpec

FAILURES = (ValueError, RuntimeError, ArithmeticError, PySparkException)


# ---------------------------------------------------------------- classifiers

# Names and parameters of the classifiers of the published experiments.
PENALTY = 1.0        # C: weight of the sum of losses against half the squared weights
MAX_ITERATIONS = 300
BOOSTING_ROUNDS = 100
BOOSTING_DEPTH = 10
FOREST_TREES = 50
HIDDEN_LAYERS = (128, 128)
DEEPEST = 30         # Spark's ceiling for trees that the experiments do not limit


def classifiers(seed: int = 0) -> dict[str, Callable[[int, int, int], object]]:
    """The six classifiers by name; each maps (features, classes, rows) to an estimator.

    Linear SVM and boosted trees know two classes only, so more classes go one against the rest.  Spark
    weighs the mean loss, the published C the sum of losses, so the penalty is 1 / (C * rows).  Trees without a
    limit of depth stop at Spark's own of 30.
    """
    binary = lambda est: lambda d, c, n: est(n) if c <= 2 else OneVsRest(classifier=est(n))
    weak = lambda n: 1.0 / (PENALTY * max(n, 1))
    return {
        "Logistic Regression": lambda d, c, n: LogisticRegression(maxIter=MAX_ITERATIONS, regParam=weak(n)),
        "Support Vector Machine": binary(lambda n: LinearSVC(maxIter=100, regParam=weak(n))),
        "Decision Tree": lambda d, c, n: DecisionTreeClassifier(impurity="gini", maxDepth=DEEPEST, seed=seed),
        "XGBoost": binary(lambda n: GBTClassifier(maxDepth=BOOSTING_DEPTH, maxIter=BOOSTING_ROUNDS, stepSize=0.3, seed=seed)),
        "Random Forest": lambda d, c, n: RandomForestClassifier(numTrees=FOREST_TREES, impurity="gini", maxDepth=DEEPEST, featureSubsetStrategy="sqrt", seed=seed),
        "Multilayer Perceptron": lambda d, c, n: MultilayerPerceptronClassifier(layers=[d, *HIDDEN_LAYERS, c], maxIter=MAX_ITERATIONS, seed=seed),
    }


def fit_predict(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """Train on (features, y) and add ``prediction`` to the test rows."""
    return estimator.fit(train).transform(test)


# ---------------------------------------------------------------- samplers

def cluster_resampler(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, factor: float = 0.01,
                      sample: int | None = None, estimator: str = "hac", inner: str = "cs", k: int = 1) -> DataFrame:
    """Clusters at the distance (median pair distance / factor), then resampling inside each of them.

    ``estimator``: ``hac`` cuts a Ward tree there, ``dbscan`` takes it as radius (3 rows make a core; noise is one
    cluster).  ``inner``: ``cs`` or ``smote`` with ``k`` neighbours.  The median looks at all pairs of distinct rows; on very
    large tables a caller may have it measured on a hash-drawn ``sample`` of rows.
    """
    if estimator not in ("hac", "dbscan"):
        raise ValueError(f"unknown cluster estimator {estimator!r}")
    vec = vector(spec.features)
    cut = median_pair_distance(df, vec, spec.row_id[0], factor, sample=sample, seed=seed)
    if estimator == "hac":
        rows = ward(df.withColumn("_vec", vec), "_vec", cut, seed).drop("_vec")
    else:
        rows = dbscan(df, vec, spec.row_id[0], cut, 3)
    return G.cluster_based_resample(written(rows, "clusters"), spec, "cluster", inner, seed, k, strategy).drop("cluster")


def sampler_suite(seed: int = 42) -> dict[str, Callable[..., DataFrame]]:
    """All resamplers under test by name: the built-in ones and those registered by the caller."""
    wrap = G.resample_encoded
    return {
        "ROS": G.random_oversample, "SMOTE": wrap(G.smote), "BorderSMOTE": wrap(G.borderline_smote),
        "SVM-SMOTE": wrap(G.svm_smote), "KMeans SMOTE": wrap(G.kmeans_smote), "ADASYN": wrap(G.adasyn),
        "Cluster-Based": wrap(cluster_resampler), "GCOP": H.gaussian_copula, "SUBSPACE": wrap(H.subspace_resample),
        "CLUSTERED": H.clustered_resample, **G.RESAMPLERS,
    }


@dataclass
class Timed:
    """Rows of a stage, written, with the seconds it took to make them."""

    rows: DataFrame
    seconds: float


def timed(make: Callable[[], DataFrame], name: str = "timed") -> Timed:
    start = time.time()
    rows = written(make(), name)
    return Timed(rows, time.time() - start)


def run_single(name: str, df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42) -> DataFrame:
    """(sampler, rows, synthetic, seconds) of one resampler on one table."""
    fn = sampler_suite(seed).get(name)
    if fn is None:
        raise KeyError(f"no resampler named {name!r}")
    done = timed(lambda: fn(df, spec, strategy, seed))
    n = done.rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_synthetic"), 1)).alias("synthetic"))
    return n.select(F.lit(name).alias("sampler"), "rows", "synthetic", F.lit(done.seconds).alias("seconds"))


# ---------------------------------------------------------------- shared steps

@dataclass
class Prepared:
    """A table with coded categories and label, and the number of classes."""

    rows: DataFrame
    spec: TableSpec
    classes: int


def prepare(df: DataFrame, spec: TableSpec) -> Prepared:
    """Drop rows with nulls, code categories and label by sorted value, keep only known columns."""
    kept = df.select(*spec.row_id, *spec.features, spec.label).na.drop("any")
    coded = label_encode(kept, [*spec.categorical, spec.label]).transform(kept)
    rows = written(coded, "prepared")
    n = len(collect_bounded(rows.select(spec.label).distinct(), "classes", 10_000))
    return Prepared(rows, spec, n)


def _xy(df: DataFrame, features, label: str) -> DataFrame:
    """(features, label); ``features`` is a list of number columns or the name of one array column."""
    x = F.col(features) if isinstance(features, str) else vector(features)
    return df.select(array_to_vector(x).alias("features"), F.col(label).cast("double").alias("label"))


@dataclass
class Runs:
    """Confusion tables, timings and failures gathered by an experiment."""

    spark: SparkSession
    cells: list[tuple] = field(default_factory=list)
    times: list[tuple] = field(default_factory=list)
    errors: list[tuple] = field(default_factory=list)

    def evaluate(self, dataset: str, fold: int, sampler: str, train: DataFrame, test: DataFrame, features, label: str,
                 classes: int, chosen: dict, seconds: float | None, seed: int) -> None:
        """Fit every classifier on the train rows and keep its confusion table on the test rows."""
        x, y = written(_xy(train, features, label), "train"), written(_xy(test, features, label), "test")
        first, size = x.first(), x.count()
        width = len(first["features"]) if first else 0
        for name, build in chosen.items():
            try:
                table = confusion(fit_predict(build(width, classes, size), x, y), [], "label", "prediction")
                self.cells += [(dataset, fold, sampler, name, r["y"], r["pred"], r["n"]) for r in collect_bounded(table, "confusion table")]
                if seconds is not None:
                    self.times.append((dataset, fold, sampler, name, "Fit Time", seconds))
            except FAILURES as e:
                self.failed(sampler, dataset, fold, seed, f"{name}: {e}")

    def failed(self, sampler: str, dataset: str, fold: int, seed: int, message: str) -> None:
        self.errors.append((sampler, dataset, fold, seed, str(message)[:2000]))

    def results(self, average: str) -> DataFrame:
        keys = ["Dataset", "Fold", "Sampler", "Classifier"]
        table = self.spark.createDataFrame(self.cells, "Dataset STRING, Fold INT, Sampler STRING, Classifier STRING, y DOUBLE, pred DOUBLE, n BIGINT")
        out = scores(table, keys, average).select(*keys, F.col("scorer").alias("Scorer"), F.col("value").alias("Val"))
        return out.unionByName(self.spark.createDataFrame(self.times, RESULT_SCHEMA))

    def error_table(self) -> DataFrame:
        return error_rows(self.spark, self.errors)


def _average(classes: int) -> str:
    return "binary" if classes < 3 else "micro"


def _choose(all_of: dict, names) -> dict:
    return all_of if names is None else {n: all_of[n] for n in names}


# ---------------------------------------------------------------- experiments

def eval_resampling(dataset: str, df: DataFrame, spec: TableSpec, samplers=None, models=None, folds: int = 5,
                    standardized: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Does resampling the train folds help?  Returns (results, errors).

    Per fold and sampler: balance the train rows, optionally standardize (fitted on the balanced
    train rows only), fit the classifiers, score them on the untouched test fold.  A failing sampler
    is recorded and skipped.
    """
    p = prepare(df, spec)
    rows = written(stratified_folds(p.rows, spec.label, spec.row_id, folds), "folds")
    runs, suite, chosen = Runs(df.sparkSession), _choose(sampler_suite(seed), samplers), _choose(classifiers(seed), models)
    for fold in range(1, folds + 1):
        train, test = rows.where(F.col("fold") != fold).drop("fold"), rows.where(F.col("fold") == fold).drop("fold")
        for name, fn in suite.items():
            try:
                done = timed(lambda: fn(train, spec, "auto", seed), "balanced")
            except FAILURES as e:
                runs.failed(name, dataset, fold, seed, e)
                continue
            balanced, held = done.rows, test
            if standardized:
                scaler = standardize(balanced, spec.features)
                balanced, held = scaler.transform(balanced), scaler.transform(held)
            runs.evaluate(dataset, fold, name, balanced, held, spec.features, spec.label, p.classes, chosen, done.seconds, seed)
    return runs.results(_average(p.classes)), runs.error_table()


def _cross_validate(runs: Runs, dataset: str, sampler: str, rows: DataFrame, features, label: str, row_id, classes: int,
                    chosen: dict, folds: int, seed: int) -> None:
    cut = written(stratified_folds(rows, label, row_id, folds), "folds")
    for fold in range(1, folds + 1):
        runs.evaluate(dataset, fold, sampler, cut.where(F.col("fold") != fold), cut.where(F.col("fold") == fold),
                      features, label, classes, chosen, None, seed)


def with_row_id(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A row id 1..n for synthetic rows, ordered by content.

    Equal rows are interchangeable, so the ids say the same under every partitioning.  Distinct
    contents are placed by their running row counts; rows of one content are numbered in balanced
    buckets, however many there are.
    """
    content = F.xxhash64(*[F.col(c) for c in (*spec.features, spec.label)])
    tagged = written(df.drop(*spec.row_id).withColumn("_h", content).withColumn("_n", F.monotonically_increasing_id()), "tagged")
    numbered = ranked(tagged, "_h", "_n", "_k")
    sizes = tagged.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    before = running_total(sizes, [], "_h", F.col("_c"), "_upto").select("_h", (F.col("_upto") - F.col("_c")).alias("_before"))
    return numbered.join(before, "_h").withColumn(spec.row_id[0], F.col("_before") + F.col("_k")).drop("_h", "_n", "_k", "_before")


def eval_detectability(dataset: str, df: DataFrame, spec: TableSpec, samplers=None, models=None, folds: int = 5,
                       seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Can a classifier tell synthetic rows from real ones?  Low scores mean good synthetic rows.

    Each sampler makes a table of the original class distribution; real (1) and synthetic (0) rows
    are mixed and cross-validated on that tag.
    """
    p = prepare(df, spec)
    runs, suite, chosen = Runs(df.sparkSession), _choose(sampler_suite(seed), samplers), _choose(classifiers(seed), models)
    cols = [*spec.features, spec.label]
    for name, fn in suite.items():
        try:
            made = timed(lambda: fn(p.rows, spec, "create-new", seed), "made").rows.where("is_synthetic")
        except FAILURES as e:
            runs.failed(name, dataset, 0, seed, e)
            continue
        both = real_vs_synthetic(p.rows, made, cols)
        tagged = TableSpec(features=tuple(cols), label="is_real", row_id=("_row",))
        _cross_validate(runs, dataset, name, with_row_id(both, tagged), cols, "is_real", ["_row"], 2, chosen, folds, seed)
    return runs.results("binary"), runs.error_table()


def eval_fidelity(dataset: str, df: DataFrame, spec: TableSpec, samplers=None, models=None, folds: int = 5,
                  seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Do classifiers score alike on real and on synthetic-only tables?

    Returns (Dataset, Fold, Sampler, Classifier, Scorer, Real, Synthetic, Difference) and errors.
    """
    p = prepare(df, spec)
    runs, suite, chosen = Runs(df.sparkSession), _choose(sampler_suite(seed), samplers), _choose(classifiers(seed), models)
    _cross_validate(runs, dataset, "real", p.rows, spec.features, spec.label, spec.row_id, p.classes, chosen, folds, seed)
    for name, fn in suite.items():
        try:
            made = timed(lambda: fn(p.rows, spec, "create-new", seed), "made").rows.where("is_synthetic").drop("is_synthetic")
        except FAILURES as e:
            runs.failed(name, dataset, 0, seed, e)
            continue
        _cross_validate(runs, dataset, name, with_row_id(made, spec), spec.features, spec.label, spec.row_id, p.classes, chosen, folds, seed)
    return fidelity_difference(runs.results(_average(p.classes))), runs.error_table()


def fidelity_difference(results: DataFrame, baseline: str = "real") -> DataFrame:
    """Every sampler's score next to the baseline's on the same fold, classifier and scorer."""
    keys = ["Dataset", "Fold", "Classifier", "Scorer"]
    real = results.where(F.col("Sampler") == baseline).select(*keys, F.col("Val").alias("Real"))
    return results.where(F.col("Sampler") != baseline).join(real, keys) \
        .select("Dataset", "Fold", "Sampler", "Classifier", "Scorer", "Real", F.col("Val").alias("Synthetic"),
                F.abs(F.col("Real") - F.col("Val")).alias("Difference"))


def eval_pipeline_cv(dataset: str, df: DataFrame, spec: TableSpec, sampler: str, models=None, folds: int = 5,
                     seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-validate resampler -> classifier; only train folds are resampled, scores are weighted.

    Returns per-fold results, their mean and deviation, and errors.
    """
    p = prepare(df, spec)
    rows = written(stratified_folds(p.rows, spec.label, spec.row_id, folds), "folds")
    runs, fn, chosen = Runs(df.sparkSession), sampler_suite(seed)[sampler], _choose(classifiers(seed), models)
    for fold in range(1, folds + 1):
        train = rows.where(F.col("fold") != fold).drop("fold")
        try:
            done = timed(lambda: fn(train, spec, "auto", seed), "balanced")
        except FAILURES as e:
            runs.failed(sampler, dataset, fold, seed, e)
            continue
        runs.evaluate(dataset, fold, sampler, done.rows, rows.where(F.col("fold") == fold), spec.features, spec.label,
                      p.classes, chosen, done.seconds, seed)
    results = runs.results("weighted")
    return results, summarize_results(results), runs.error_table()


# The grid of discretizers the published experiment compares (method, bins, weights).
DISCRETIZER_GRID = (
    (None, None, None),
    ("chi-merge", "auto-bgm", None),
    ("bins-uni", "auto-bgm", None),
    ("bins-q", "auto-bgm", None),
    ("bins-k", "auto-bgm", None),
    ("bins-bgm", "auto-bgm", None),
    ("chi-merge", 5, None),
    ("bins-uni", 5, None),
    ("bins-q", 5, None),
    ("bins-k", 5, None),
    ("bins-bgm", 5, None),
    ("caim", None, None),
)


def eval_discretization(dataset: str, df: DataFrame, spec: TableSpec, grid=DISCRETIZER_GRID, models=None, folds: int = 5,
                        fit_scope: str = "train", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cross-validated scores after discretizing and one-hot coding all columns.

    ``fit_scope``: ``train`` fits the discretizer on the train fold (no leak of test labels), ``all``
    on the whole table before splitting.
    """
    if fit_scope not in ("train", "all"):
        raise ValueError("fit_scope is 'train' or 'all'")
    p = prepare(df, spec)
    rows = written(stratified_folds(p.rows, spec.label, spec.row_id, folds), "folds")
    cont = [c for c in spec.features if c not in spec.categorical]
    runs, chosen = Runs(df.sparkSession), _choose(classifiers(seed), models)
    for method, bins, weights in grid:
        name = f"{method}/{bins}/{weights}"
        shared = None
        for fold in range(1, folds + 1):
            train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            try:
                if fit_scope == "all":
                    shared = shared or fit_discretizer(rows, cont, method, bins, spec.label, weights)
                model = shared or fit_discretizer(train, cont, method, bins, spec.label, weights)
                a, b = model.transform(train), model.transform(test)
                # without a method the continuous columns stay numbers
                coded = [c for c in spec.features if method is not None or c in spec.categorical]
                hot = fit_one_hot(a, coded)
                a, b = hot.transform(a), hot.transform(b)
                joined = F.concat(*[F.col(c) if c in coded else F.array(F.col(c).cast("double")) for c in spec.features])
                a, b = a.withColumn("_hot", joined), b.withColumn("_hot", joined)
                runs.evaluate(dataset, fold, name, a, b, "_hot", spec.label, p.classes, chosen, None, seed)
            except FAILURES as e:
                runs.failed(name, dataset, fold, seed, e)
    return runs.results(_average(p.classes)), runs.error_table()

