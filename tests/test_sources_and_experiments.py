"""Readers, result tables, metrics by hand, experiments and fitted transforms on a stream."""
import gzip
import json

import pytest
from pyspark.sql import functions as F

from ballast.functions.store import scratch_path
from ballast.operators import discretize as D
from ballast.operators import encode as E
from ballast.operators import prepare as P
from ballast.operators import resample as G
from ballast.plans import evaluate as V
from ballast.plans import fixtures as X
from ballast.plans import metrics as M
from ballast.plans.split import stratified_folds
from ballast.sources import results as R
from ballast.sources.tables import DatasetRegistry, read_table
from ballast.streaming.apply import apply_models, read_parquet_stream, write_available


def test_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('a, b, c,d\n1, 2.5, x,<null>\n2, NA, "y, z",7\n3, 4, n/a,8\n')
    t = read_table(spark, str(f))
    assert t.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "bigint")]
    assert [tuple(r) for r in t.orderBy("a").collect()] == [(1, 2.5, "x", None), (2, None, "y, z", 7), (3, 4.0, None, 8)]
    given = read_table(spark, str(f), schema="a INT, b DOUBLE, c STRING, d INT")
    assert given.dtypes[0] == ("a", "int") and given.na.drop("any").count() == 0


def test_json_lines(spark, tmp_path):
    f = tmp_path / "t.json.gz"
    with gzip.open(f, "wt") as g:
        for i in range(20):
            g.write(json.dumps({"id": i, "v": i / 2}) + "\n")
    assert read_table(spark, str(f)).agg(F.sum("v")).first()[0] == 95.0
    with pytest.raises(ValueError):
        read_table(spark, str(f), "xlsx")


def test_registry(spark, tmp_path):
    for name, n in (("one", 6), ("two", 4)):
        (tmp_path / f"{name}.csv").write_text("id,x,k,y\n" + "".join(f"{i},{i * 2},c{i % 2},{'p' if i else 'q'}\n" for i in range(n)) + "99,,c0,p\n")
    reg = DatasetRegistry()
    for name in ("one", "two"):
        reg.add(name, str(tmp_path / f"{name}.csv"), label="y", row_id="id")
    df, spec = reg.load(spark, "one")
    assert df.count() == 6 and spec.continuous == ("x",) and spec.categorical == ("k",)
    out = reg.each(spark, lambda d, s: P.class_counts(d, s.label)).collect()
    assert {(r["dataset"], r["y"]): r["n"] for r in out} == {("one", "q"): 1, ("one", "p"): 5, ("two", "q"): 1, ("two", "p"): 3}
    with pytest.raises(KeyError):
        reg.load(spark, "three")


def test_results_are_written_in_order(spark):
    rows = [("d", f, s, "c", "x", 0.5) for s in ("b", "a") for f in (2, 1)]
    path = scratch_path(spark, "ordered")
    R.write_results(spark.createDataFrame(rows, R.RESULT_SCHEMA), path)
    lines = [ln for f in sorted(spark.read.text(path).select("value", "_metadata.file_path").collect(), key=lambda r: r["file_path"]) for ln in [f["value"]] if not ln.startswith("Dataset")]
    assert [ln.split(",")[1:3] for ln in lines] == [["1", "a"], ["2", "a"], ["1", "b"], ["2", "b"]]


def metric(spark, pairs, average):
    t = spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "y DOUBLE, p DOUBLE")
    return {r["scorer"]: r["value"] for r in M.scores(M.confusion(t, [], "y", "p"), [], average).collect()}


def test_metrics_by_hand(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 1)] * 2 + [(1, 0)] * 2
    b = metric(spark, pairs, "binary")
    assert b["accuracy"] == 0.7 and b["precision"] == pytest.approx(2 / 3) and b["recall"] == b["sensitivity"] == 0.5
    assert b["specificity"] == pytest.approx(5 / 6) and b["f1"] == pytest.approx(4 / 7) and b["balanced_accuracy"] == pytest.approx((5 / 6 + 0.5) / 2)
    w = metric(spark, pairs, "weighted")
    assert w["precision"] == pytest.approx(0.6 * 5 / 7 + 0.4 * 2 / 3) and w["specificity"] == pytest.approx(0.6 * 0.5 + 0.4 * 5 / 6)
    m = metric(spark, pairs, "micro")
    assert m["precision"] == m["recall"] == m["f1"] == m["specificity"] == 0.7


def test_metrics_zero_division(spark):
    out = metric(spark, [(0, 0), (1, 0), (2, 0)], "weighted")
    assert out["precision"] == pytest.approx(1 / 9) and out["f1"] == pytest.approx(1 / 6) and out["balanced_accuracy"] == pytest.approx(1 / 3)
    assert metric(spark, [(1, 0), (0, 0)], "binary")["precision"] == 0.0
    with pytest.raises(ValueError):
        metric(spark, [(1, 1)], "macro")


def test_a_key_without_positives_scores_zero(spark):
    t = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("b", 1, 1), ("b", 0, 1)], "k STRING, y INT, p INT")
    got = {(r["k"], r["scorer"]): r["value"] for r in M.scores(M.confusion(t, ["k"], "y", "p"), ["k"], "binary").collect()}
    assert got["a", "precision"] == got["a", "recall"] == got["a", "f1"] == 0.0 and got["b", "recall"] == 1.0


def test_folds_are_even(spark, sf):
    t = stratified_folds(X.toxic_docs(spark, sf), "toxic", "doc_id", 5)
    for r in t.groupBy("toxic", "fold").count().groupBy("toxic").agg(F.max("count").alias("a"), F.min("count").alias("b")).collect():
        assert r["a"] - r["b"] <= 1


def test_all_classifiers(spark, sf):
    p = V.prepare(X.toxic_docs(spark, sf), X.TOXIC)
    xy = V._xy(p.rows, X.TOXIC.features, "toxic").cache()
    for name, build in V.classifiers(0).items():
        est = build(3, 2, 80)
        if est.hasParam("maxIter"):
            est.setMaxIter(3)
        assert V.fit_predict(est, xy, xy).count() == xy.count(), name


def test_classifiers_for_more_classes(spark, sf):
    t = X.lang_docs(spark, sf)
    p = V.prepare(t, X.LANG)
    xy = V._xy(p.rows, X.LANG.features, "lang").cache()
    for name in ("Support Vector Machine", "XGBoost"):
        est = V.classifiers(0)[name](2, 4, 80)
        est.setClassifier(est.getClassifier().setMaxIter(2))
        assert V.fit_predict(est, xy, xy).select("prediction").distinct().count() >= 1


def test_failing_sampler_is_recorded(spark, sf):
    def broken(df, spec, strategy, seed):
        raise ValueError("no luck")

    G.register_resampler("broken", broken)
    try:
        results, errors = V.eval_resampling("d", X.toxic_docs(spark, sf), X.TOXIC, ["broken", "ROS"], ["Decision Tree"], folds=2, standardized=True)
        assert {r["Sampler"] for r in results.collect()} == {"ROS"}
        assert [(r["Sampler"], r["Fold"], r["Message"]) for r in errors.orderBy("Fold").collect()] == [("broken", 1, "no luck"), ("broken", 2, "no luck")]
        assert {r["Scorer"] for r in results.collect()} == {*M.SCORERS, "Fit Time"}
    finally:
        del G.RESAMPLERS["broken"]


def test_discretization_scopes(spark, sf):
    for scope in ("train", "all"):
        out, errors = V.eval_discretization("d", X.toxic_docs(spark, sf), X.TOXIC, [("bins-q", 5, None), (None, None, None)], ["Decision Tree"], 2, scope)
        assert out.count() == 2 * 2 * 7 and errors.count() == 0


def test_single_run(spark, sf):
    r = V.run_single("ROS", X.toxic_docs(spark, sf), X.TOXIC).first()
    assert r["synthetic"] > 0 and r["seconds"] > 0
    with pytest.raises(KeyError):
        V.run_single("nobody", X.toxic_docs(spark, sf), X.TOXIC)


def test_fitted_transforms_on_a_stream(spark, sf):
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path).select("event_id", "event_type", "value", "user_id")
    models = [E.min_max(batch, ["value"], -1.0, 1.0), D.fit_discretizer(batch, ["user_id"], "bins-uni", 4), P.label_encode(batch, ["event_type"])]
    source = scratch_path(spark, "stream-in")
    spark.read.parquet(path).write.parquet(source)
    stream = apply_models(read_parquet_stream(spark, source).select(*batch.columns), *models)
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    q = write_available(stream, out, ckpt)
    q.awaitTermination(60)
    want = apply_models(batch, *models)
    got = spark.read.parquet(out)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    with pytest.raises(TypeError):
        stratified_folds(read_parquet_stream(spark, source), "event_type", "event_id")
    with pytest.raises(TypeError):
        G.random_oversample(read_parquet_stream(spark, source), X.EVENTS)


def test_entry_runs_from_another_folder(tmp_path):
    """Workers find the package even if the session was started elsewhere."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('ROWS', len(e.entry(s).collect()), len(e.queries()['c14_draw_mode'](s, '/root/testdata/sf0.001').collect()) > 0)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2 True" in done.stdout, done.stderr[-2000:]
