"""Rebalancing operators: ``fn(df, spec, strategy, seed) -> real + synthetic rows``.

Every result has the columns of the input plus ``is_synthetic``; synthetic rows have no row id.
New rows are numbered by (class, copy); the row they start from is found by joining that number's
draw to the ranks of the class, so no class is ever gathered in one place.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ballast.functions.bounds import collect_bounded, join_model
from ballast.functions.draws import pick, uniform
from ballast.functions.ranks import expand, ranked, running_total
from ballast.functions.store import written
from ballast.operators.counts import CountPlan, plan_counts
from ballast.operators.encode import array_to_vector, fit_one_hot, one_hot, one_hot_inverse, vector_to_array
from ballast.operators.neighbors import knn, vector
from ballast.spec import TableSpec, refuse_stream, validate_columns


def _id(spec: TableSpec) -> str:
    if len(spec.row_id) != 1:
        raise ValueError("resampling needs one unique row id column")
    return spec.row_id[0]


def _checked(df: DataFrame, spec: TableSpec, numeric: bool = True) -> None:
    refuse_stream(df, "resampling")
    validate_columns(df, [*spec.features, spec.label, *spec.row_id])
    if numeric and spec.categorical:
        raise ValueError("categorical features: wrap the operator in resample_encoded")


def _as_type(df: DataFrame, c: str, kind: T.DataType) -> Column:
    """The column in another type; whole-number columns are rounded, not cut."""
    fraction = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) and isinstance(kind, T.IntegralType)
    return (F.rint(c) if fraction else F.col(c)).cast(kind).alias(c)


def append_synthetic(df: DataFrame, synthetic: DataFrame, keep_real: bool = True) -> DataFrame:
    """Real rows followed by synthetic ones, told apart by ``is_synthetic``."""
    made = synthetic.withColumn("is_synthetic", F.lit(True))
    missing = [c for c in df.columns if c not in made.columns]
    made = made.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in missing}) if missing else made
    made = made.select(*[_as_type(made, c, df.schema[c].dataType) for c in df.columns], "is_synthetic")
    return df.withColumn("is_synthetic", F.lit(False)).unionByName(made) if keep_real else made


def _slots(df: DataFrame, plan: CountPlan) -> DataFrame:
    """(label, n, copy): one row per row to create."""
    return expand(plan.table(df).where("need > 0"), "need").drop("need")


def _targets(df: DataFrame, plan: CountPlan) -> DataFrame:
    return df.where(F.col(plan.label).isin(plan.targets))


def _put(df: DataFrame, vec: str, features) -> DataFrame:
    """Feature columns back from the array column."""
    return df.withColumns({c: F.col(vec)[i] for i, c in enumerate(features)})


def _between(x: Column, y: Column, step: Column) -> Column:
    """x + step * (y - x), element by element."""
    return F.zip_with(x, y, lambda a, b: a + step * (b - a))


# ---------------------------------------------------------------- copies

def random_oversample(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42) -> DataFrame:
    """Duplicate rows of the classes to raise, drawn with replacement."""
    _checked(df, spec, numeric=False)
    plan, label, rid = plan_counts(df, spec.label, strategy), spec.label, _id(spec)
    rows = ranked(_targets(df, plan), label, rid).drop(rid)
    slots = _slots(df, plan).select(label, pick("ros", F.col("n"), label, "copy", seed=seed).alias("rank"))
    return append_synthetic(df, slots.join(rows, [label, "rank"]).drop("rank"), plan.keep_real)


# ---------------------------------------------------------------- interpolation

def _need_neighbours(plan: CountPlan) -> None:
    lone = [c for c in plan.targets if plan.counts[c] < 2]
    if lone:
        raise ValueError(f"classes with a single row cannot be interpolated: {lone}")


def _class_neighbors(df: DataFrame, spec: TableSpec, k: int, within) -> DataFrame:
    """Rows with their vector ``x`` and the vectors ``near`` of their k nearest rows of the same group."""
    vec = vector(spec.features)
    found = knn(df, df, vec, _id(spec), k, within=within, include_self=False, with_vector=True)
    return found.select(*within, _id(spec), vec.alias("x"), F.transform("neighbors", lambda e: e["vec"]).alias("near"))


def _interpolate(slots: DataFrame, seeds: DataFrame, keys: list[str], rid: str, purpose: str, seed: int,
                 step: Column | None = None) -> DataFrame:
    """For each slot (keys, copy): a seed row by draw, one of its neighbours by draw, a point between."""
    seeds = written(seeds, "seeds")  # ranked below in several passes
    rows = ranked(seeds, keys, rid, size="seeds").drop(rid)
    sizes = seeds.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seeds"))
    chosen = join_model(slots, sizes, keys).withColumn("rank", pick(f"{purpose}.row", F.col("_seeds"), *keys, "copy", seed=seed))
    joined = chosen.hint("merge").join(rows.drop("seeds"), [*keys, "rank"])  # the slots' own hint ends at the join above
    to = F.element_at("near", pick(f"{purpose}.near", F.size("near"), *keys, "copy", seed=seed).cast("int"))
    gap = uniform(f"{purpose}.gap", *keys, "copy", seed=seed)
    return joined.withColumn("_to", to).withColumn("_gap", gap if step is None else gap * step) \
                 .withColumn("_new", _between(F.col("x"), F.col("_to"), F.col("_gap")))


def smote(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, k: int = 5) -> DataFrame:
    """SMOTE (2002): a random row of the class, one of its k nearest rows of the class, and a random
    point on the line between them.  Classes with fewer than k + 1 rows use the neighbours they have."""
    _checked(df, spec)
    plan, label = plan_counts(df, spec.label, strategy), spec.label
    _need_neighbours(plan)
    seeds = _class_neighbors(_targets(df, plan), spec, k, [label])
    made = _interpolate(_slots(df, plan), seeds, [label], _id(spec), "smote", seed)
    return append_synthetic(df, _put(made, "_new", spec.features).select(label, *spec.features), plan.keep_real)


def other_class_share(df: DataFrame, right: DataFrame, spec: TableSpec, k: int) -> DataFrame:
    """``df`` with ``others`` (neighbours of another class) and ``found`` among the k nearest rows of ``right``."""
    near = knn(df, right, vector(spec.features), _id(spec), k, carry=[spec.label], include_self=False)
    others = F.size(F.filter("neighbors", lambda e: e[spec.label] != F.col(spec.label)))
    return near.withColumn("others", others).withColumn("found", F.size("neighbors")).drop("neighbors")


def danger_rows(df: DataFrame, spec: TableSpec, plan: CountPlan, m: int = 10) -> DataFrame:
    """Rows of the classes to raise with at least half, but not all, neighbours of other classes."""
    seen = other_class_share(_targets(df, plan), df, spec, m)
    return seen.where((F.col("others") * 2 >= F.col("found")) & (F.col("others") < F.col("found"))).drop("others", "found")


def borderline_smote(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, k: int = 5, m: int = 10) -> DataFrame:
    """Borderline-SMOTE (2005), first variant: SMOTE started only from danger rows; the neighbours may
    be any rows of the class.  A class without danger rows gets nothing."""
    _checked(df, spec)
    plan, label, rid = plan_counts(df, spec.label, strategy), spec.label, _id(spec)
    _need_neighbours(plan)
    danger = written(danger_rows(df, spec, plan, m).select(rid), "danger")
    seeds = _class_neighbors(_targets(df, plan), spec, k, [label]).join(danger, rid, "left_semi")
    made = _interpolate(_slots(df, plan), seeds, [label], rid, "border", seed)
    return append_synthetic(df, _put(made, "_new", spec.features).select(label, *spec.features), plan.keep_real)


def svm_margin(df: DataFrame, spec: TableSpec, target, max_iter: int = 20) -> DataFrame:
    """``df`` with ``margin``: signed distance of each row from a linear one-against-rest border."""
    train = df.withColumn("_x", array_to_vector(vector(spec.features))) \
              .withColumn("_y", F.when(F.col(spec.label) == F.lit(target), 1.0).otherwise(0.0))
    fitted = LinearSVC(featuresCol="_x", labelCol="_y", rawPredictionCol="_raw", predictionCol="_p", maxIter=max_iter).fit(train)
    return fitted.transform(train).withColumn("margin", vector_to_array("_raw")[1]).drop("_x", "_y", "_raw", "_p")


def svm_smote(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, k: int = 5, m: int = 10,
              out_step: float = 0.5) -> DataFrame:
    """SVM-SMOTE (2011) with a linear border: seeds are rows of the class with margin at most 1.

    Seeds whose m neighbours are all of other classes are noise and dropped.  Seeds with half or
    more such neighbours interpolate towards a row of the class, the others extrapolate away from it.
    """
    _checked(df, spec)
    plan, label, rid = plan_counts(df, spec.label, strategy), spec.label, _id(spec)
    _need_neighbours(plan)
    near = [svm_margin(df, spec, c).where((F.col(label) == F.lit(c)) & (F.col("margin") <= 1.0)) for c in plan.targets]
    if not near:
        return append_synthetic(df, df.where(F.lit(False)).select(label, *spec.features), plan.keep_real)
    support = reduce(DataFrame.unionByName, near).drop("margin")
    seen = other_class_share(support, df, spec, m).where(F.col("others") < F.col("found"))
    kinds = written(seen.select(rid, F.when(F.col("others") * 2 >= F.col("found"), 1.0).otherwise(-out_step).alias("way")), "support")
    seeds = _class_neighbors(_targets(df, plan), spec, k, [label]).join(kinds, rid)
    made = _interpolate(_slots(df, plan), seeds, [label], rid, "svm", seed, step=F.col("way"))
    return append_synthetic(df, _put(made, "_new", spec.features).select(label, *spec.features), plan.keep_real)


def adasyn_need(df: DataFrame, spec: TableSpec, plan: CountPlan, k: int = 5) -> DataFrame:
    """(label, row id, need): each class's need shared out by the rows' other-class neighbours.

    A row's part is rounded half to even, so a class may get slightly more or fewer rows than planned.
    """
    label, rid = spec.label, _id(spec)
    seen = written(other_class_share(_targets(df, plan), df, spec, k).select(label, rid, "others", "found"), "shares")
    share = F.col("others") / F.greatest(F.col("found"), F.lit(1))
    totals = seen.groupBy(label).agg(F.sum(share).alias("_total"))
    parts = join_model(join_model(seen, totals, label), plan.table(df).select(label, F.col("need").alias("_need")), label)
    return parts.select(label, rid, F.when(F.col("_total") > 0, F.rint(share * F.col("_need") / F.col("_total")))
                        .otherwise(0).cast("long").alias("need"))


def adasyn(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, k: int = 5) -> DataFrame:
    """ADASYN (2008): more new rows where a row has more neighbours of other classes."""
    _checked(df, spec)
    plan, label, rid = plan_counts(df, spec.label, strategy), spec.label, _id(spec)
    _need_neighbours(plan)
    need = written(adasyn_need(df, spec, plan, k).where("need > 0"), "adasyn-need")
    if plan.targets and need.isEmpty():
        raise ValueError("no row of the classes to raise has neighbours of other classes enough for a new row")
    rows = _class_neighbors(_targets(df, plan), spec, k, [label])
    slots = expand(need, "need").drop("need")
    to = F.element_at("near", pick("adasyn.near", F.size("near"), rid, "copy", seed=seed).cast("int"))
    made = slots.join(rows, [label, rid]).withColumn("_to", to) \
        .withColumn("_gap", uniform("adasyn.gap", rid, "copy", seed=seed)) \
        .withColumn("_new", _between(F.col("x"), F.col("_to"), F.col("_gap")))
    return append_synthetic(df, _put(made, "_new", spec.features).select(label, *spec.features), plan.keep_real)


def kmeans_smote(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, k: int = 5, clusters: int = 8,
                 threshold: float | str = "auto") -> DataFrame:
    """k-means SMOTE (2018): SMOTE inside the clusters where the class is well represented.

    A cluster counts for a class when the class's share there reaches the threshold (``auto``: half
    of the class's part of all rows to create) and it has more than k of its rows.  The class's need
    is shared out by sparsity = d ** e / n, with d the root mean square distance between the rows
    (one aggregation) and e = 0.16 * log_1.6(n) ** 1.8; each part is rounded up.
    """
    _checked(df, spec)
    plan, label, rid = plan_counts(df, spec.label, strategy), spec.label, _id(spec)
    x = array_to_vector(vector(spec.features))
    data = df.withColumn("_x", x)
    fitted = KMeans(k=clusters, seed=seed, featuresCol="_x", predictionCol="cluster").fit(data)
    # the label of each row is fixed by the centres; written once so that later steps agree
    data = written(fitted.transform(data).drop("_x"), "clusters")
    sizes = data.groupBy("cluster", label).agg(
        F.count(F.lit(1)).alias("n"), *[F.var_pop(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(spec.features)])
    every = W.partitionBy("cluster")  # at most one row per class
    spread = sum((F.col(f"_v{i}") for i in range(len(spec.features))), F.lit(0.0))
    distance = F.sqrt(2.0 * spread * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1)))
    all_need = max(1, sum(plan.need.values()))
    goal = join_model(sizes.withColumn("share", F.col("n") / F.sum("n").over(every)),
                      plan.table(df).select(label, F.col("need").alias("_need")), label).where("_need > 0")
    limit = F.col("_need") / (2.0 * all_need) if threshold == "auto" else F.lit(float(threshold))
    exponent = F.lit(0.16) * F.pow(F.log(F.col("n").cast("double")) / F.log(F.lit(1.6)), F.lit(1.8))
    valid = goal.where((F.col("share") >= limit) & (F.col("n") > k)) \
        .withColumn("sparsity", F.pow(distance, exponent) / F.col("n"))
    total = F.sum("sparsity").over(W.partitionBy(label))  # at most one row per cluster
    part = F.when(total > 0, F.col("sparsity") / total).otherwise(1.0 / F.count(F.lit(1)).over(W.partitionBy(label)))
    need = [r.asDict() for r in collect_bounded(valid.select("cluster", label, F.ceil(part * F.col("_need")).cast("long").alias("need")), "clusters")]
    if {r[label] for r in need} != set(plan.targets):
        lost = sorted(set(plan.targets) - {r[label] for r in need})
        raise ValueError(f"no cluster holds enough rows of classes {lost}; lower the threshold or use more clusters")
    need_df = df.sparkSession.createDataFrame([(r["cluster"], r[label], r["need"]) for r in need],
                                              f"cluster INT, {label} {df.schema[label].dataType.simpleString()}, need BIGINT")
    inside = data.join(F.broadcast(need_df.drop("need")), ["cluster", label], "left_semi")
    seeds = _class_neighbors(inside, spec, k, ["cluster", label])
    made = _interpolate(expand(need_df, "need").drop("need"), seeds, ["cluster", label], rid, "kmeans", seed)
    return append_synthetic(df, _put(made, "_new", spec.features).select(label, *spec.features), plan.keep_real)


# ---------------------------------------------------------------- centroids and clusters

def _centroid_rows(df: DataFrame, spec: TableSpec, need: DataFrame, keys: list[str], seed: int, toward: bool) -> DataFrame:
    """Row number ((copy - 1) mod n) + 1 of the group, moved by u * (row - centroid)."""
    rid = _id(spec)
    some = need.where("need > 0")
    centre = df.groupBy(*keys).agg(F.array(*[F.avg(F.col(c).cast("double")) for c in spec.features]).alias("_centre"))
    slots = expand(some.join(centre, keys), "need").withColumn("rank", ((F.col("copy") - 1) % F.col("n") + 1).cast("long"))
    rows = ranked(df.select(*keys, rid, vector(spec.features).alias("x")), keys, rid)
    u = uniform("centroid", *keys, "copy", seed=seed)
    made = slots.join(rows, [*keys, "rank"]).withColumn("_u", u)
    sign = -1.0 if toward else 1.0
    new = F.zip_with("x", "_centre", lambda a, c: a + F.col("_u") * F.lit(sign) * (a - c))
    return _put(made.withColumn("_new", new), "_new", spec.features).select(*keys, *spec.features)


def centroid_sample(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, toward: bool = False) -> DataFrame:
    """New rows beyond the rows of a class, away from its centroid (or ``toward`` it).

    The rows of the class are used in id order, again and again.  Classes with one row are skipped.
    """
    _checked(df, spec)
    plan, label = plan_counts(df, spec.label, strategy), spec.label
    need = plan.table(df).where("n > 1")
    made = _centroid_rows(_targets(df, plan), spec, need, [label], seed, toward)
    return append_synthetic(df, made, plan.keep_real)


def cluster_plan(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, n, included, dropped, need) for each class present in a cluster.

    ``dropped``: the cluster is a single row of the global majority class.  ``included``: the global
    majority class where it is (one of) the largest in the cluster, other classes with two or more
    rows.  Included classes are raised to the largest included one when there are at least two.
    """
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    totals = collect_bounded(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "classes", 10_000)
    top = min(totals, key=lambda r: (-r["n"], r[label]))[label]
    here = W.partitionBy(cluster)  # at most one row per class
    is_top = F.col(label) == F.lit(top)
    flagged = counts.withColumn("_max", F.max("n").over(here)).withColumn("_rows", F.sum("n").over(here)) \
        .withColumn("included", F.when(is_top, F.col("n") == F.col("_max")).otherwise(F.col("n") > 1)) \
        .withColumn("dropped", is_top & (F.col("_rows") == 1))
    best = F.max(F.when(F.col("included"), F.col("n"))).over(here)
    groups = F.sum(F.col("included").cast("int")).over(here)
    need = F.when(F.col("included") & (groups > 1) & (F.col("n") > 1), best - F.col("n")).otherwise(0)
    return flagged.withColumn("need", need.cast("long")).select(cluster, label, "n", "included", "dropped", "need")


def _spread_need(plan: DataFrame, wanted: CountPlan, cluster: str) -> DataFrame:
    """(cluster, label, n, need): what a class is to get, dealt to the clusters with two or more of its rows by their size."""
    label = wanted.label
    base = plan.where("n > 1").select(cluster, label, "n")
    held = {r[label] for r in collect_bounded(base.select(label).distinct(), "classes", 10_000)}
    lone = [c for c in wanted.targets if c not in held]
    if lone:
        raise ValueError(f"no cluster holds two rows of the classes {lone}")
    upto = running_total(written(base, "cluster-need"), label, cluster, F.col("n"), "_upto", size="_all")
    goal = F.create_map(*[v for c, k in wanted.need.items() for v in (F.lit(c), F.lit(k).cast("long"))])[F.col(label)]
    part = lambda rows: F.floor(goal * rows / F.col("_all"))
    return upto.withColumn("need", (part(F.col("_upto")) - part(F.col("_upto") - F.col("n"))).cast("long")).select(cluster, label, "n", "need")


def cluster_based_resample(df: DataFrame, spec: TableSpec, cluster: str, inner: str = "cs", seed: int = 42, k: int = 1,
                           strategy="auto") -> DataFrame:
    """Resample inside every cluster at once, given cluster labels (noise counts as one cluster).

    ``inner``: ``cs`` for :func:`centroid_sample`, ``smote`` for :func:`smote` with ``k`` neighbours.  With ``auto`` each
    cluster is balanced for itself; any other strategy says what each class gets in all (see
    :func:`plan_counts`), which its clusters share by size.  Rows of dropped clusters leave the table; all other rows stay.
    """
    _checked(df, spec)
    if inner not in ("cs", "smote"):
        raise ValueError(f"unknown inner resampler {inner!r}")
    label, keys = spec.label, [cluster, spec.label]
    plan = written(cluster_plan(df, cluster, label), "cluster-plan")
    gone = plan.where("dropped").select(*keys)
    kept = join_model(df, gone, keys, "left_anti")
    wanted = None if strategy == "auto" else plan_counts(df, label, strategy)
    need = (plan if wanted is None else written(_spread_need(plan, wanted, cluster), "cluster-need")).where("need > 0").select(*keys, "n", "need")
    inside = join_model(df, need.select(*keys), keys, "left_semi")
    if inner == "cs":
        made = _centroid_rows(inside, spec, need, keys, seed, toward=False)
    else:
        seeds = _class_neighbors(inside, spec, k, keys)
        made = _put(_interpolate(expand(need, "need").drop("need", "n"), seeds, keys, _id(spec), "cluster", seed), "_new", spec.features) \
            .select(*keys, *spec.features)
    return append_synthetic(kept, made, wanted is None or wanted.keep_real)


# ---------------------------------------------------------------- wrappers and registry

def resample_encoded(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same resampler for tables with categorical features: one-hot before, argmax after."""

    def run(df: DataFrame, spec: TableSpec, strategy="auto", seed: int = 42, **options) -> DataFrame:
        cats = [c for c in spec.features if c in spec.categorical]
        if not cats:
            return fn(df, spec, strategy, seed, **options)
        model = fit_one_hot(df, cats)
        names = {c: [f"_oh{i}_{j}" for j in range(len(model.vocabulary[c]))] for i, c in enumerate(cats)}
        wide = df.withColumns({n: F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0)
                               for c in cats for n, v in zip(names[c], model.vocabulary[c])}).drop(*cats)
        # real-valued columns, so that interpolated values are not cut to whole numbers
        wide = wide.withColumns({c: F.col(c).cast("double") for c in spec.features if c not in cats})
        flat = tuple(n for c in spec.features for n in (names[c] if c in names else [c]))
        inner = TableSpec(features=flat, label=spec.label, row_id=spec.row_id)
        out = fn(wide, inner, strategy, seed, **options)
        back = out.withColumns({c: one_hot_inverse(F.array(*names[c]), model.vocabulary[c]).cast(df.schema[c].dataType) for c in cats})
        return back.select(*[_as_type(back, c, df.schema[c].dataType) for c in df.columns], "is_synthetic")

    return run


RESAMPLERS: dict[str, Callable[..., DataFrame]] = {}


def register_resampler(name: str, fn: Callable[..., DataFrame]) -> None:
    """Let a resampler (df, spec, strategy, seed) -> DataFrame take part in comparisons."""
    if not callable(fn):
        raise TypeError(f"resampler {name!r} must be callable as fn(df, spec, strategy, seed)")
    RESAMPLERS[name] = fn
