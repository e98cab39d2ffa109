"""Linear and logistic methods for all resamples at once, and refits with their preprocessing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import estimators, preprocess, refit
from foldwise.sources import store, tables


@pytest.fixture(scope="module")
def dealt(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b", "c"):
        x = rng.normal(size=(90, 4)) * [1, 20, 0.1, 3] + [0, 50, 0, 1]
        y = x @ [1.0, 0.2, -3.0, 0.0] + rng.normal(size=90) * 0.5
        z = (y > np.median(y) + rng.normal(size=90)).astype(int)
        rows += [(g, ("train", "valid", "test")[i % 3], i, *map(float, x[i]), float(y[i]), int(z[i])) for i in range(90)]
    return rows, spark.createDataFrame(rows, "resample_id string, role string, k long, x0 double, x1 double, x2 double, x3 double, y double, z int").repartition(4)


FOUR = ["x0", "x1", "x2", "x3"]


@pytest.mark.parametrize("alpha", [0.0, 7.0])
def test_planes_of_all_resamples(dealt, alpha):
    rows, frame = dealt
    got = {r["resample_id"]: r for r in estimators.linear_fits(frame, FOUR, "y", alpha).collect()}
    for g in ("a", "b", "c"):
        train = np.array([r[3:8] for r in rows if r[0] == g and r[1] != "test"])
        x, y = train[:, :4] - train[:, :4].mean(0), train[:, 4] - train[:, 4].mean()
        want = np.linalg.solve(x.T @ x + alpha * np.eye(4), x.T @ y)
        assert np.allclose(got[g]["coefficients"], want, rtol=1e-9) and got[g]["intercept"] == pytest.approx(train[:, 4].mean() - want @ train[:, :4].mean(0))
    out = estimators.linear(frame, FOUR, "y", alpha)
    assert out.count() == 90 and out.filter("abs(value - y) > 3").count() == 0


def test_planes_of_dependent_features(spark):
    frame = spark.createDataFrame([("a", "train", float(i), 2.0 * i, 5.0, 3.0 * i + 1) for i in range(8)] + [("a", "test", 9.0, 18.0, 5.0, 0.0)], "resample_id string, role string, p double, q double, c double, y double")
    assert estimators.linear(frame, ["p", "q", "c"], "y").first()["value"] == pytest.approx(28.0)
    with pytest.raises(Exception, match="missing in a row"):
        estimators.linear(frame.withColumn("p", F.when(F.col("p") > 3, F.col("p"))), ["p"], "y").collect()
    with pytest.raises(ValueError):
        estimators.linear_fits(frame, [f"x{i}" for i in range(40)], "y")


@pytest.mark.parametrize("c", [1.0, 50.0])
def test_logistic_of_all_resamples(spark, dealt, c):
    rows, frame = dealt
    got = {r["resample_id"]: r for r in estimators.logistic_fits(frame, FOUR, "z", c).collect()}
    for g in ("a", "b", "c"):
        train = np.array([(*r[3:7], r[8]) for r in rows if r[0] == g and r[1] != "test"])
        x, y, w = np.column_stack([np.ones(60), train[:, :4]]), train[:, 4], np.zeros(5)
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ w))
            slope = c * x.T @ (p - y) + np.r_[0, w[1:]]
            w = w - 0.5 * np.linalg.solve(c * (x * (p * (1 - p))[:, None]).T @ x + np.diag([0, 1, 1, 1, 1.0]), slope)
        assert np.allclose([got[g]["intercept"], *got[g]["coefficients"]], w, atol=1e-6)
        assert got[g]["steps"] < 20
    task = tables.Task("binary", FOUR, "z")
    one = frame.filter("resample_id = 'a'")
    single = estimators.fit(estimators.with_features(one.filter("role <> 'test'"), FOUR), task, "logistic_regression", {"C": c, "max_iter": 1000})
    want = {r["sample_id"]: r["probabilities"][1] for r in estimators.predict(single, estimators.with_features(one.filter("role = 'test'"), FOUR), task, "k").collect()}
    mine = {r["k"]: r["probabilities"][1] for r in estimators.logistic(frame, FOUR, "z", c).filter("resample_id = 'a'").collect()}
    assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-3 for k in want)


def test_logistic_of_separable_rows_ends(spark):
    frame = spark.createDataFrame([(None, "train", float(i), int(i > 4)) for i in range(10)], "resample_id string, role string, x double, y int")
    got = estimators.logistic_fits(frame, ["x"], "y", 1000.0).first()
    assert math.isfinite(got["intercept"]) and got["coefficients"][0] > 1


RAW = [preprocess.Feature("size", "numeric", {"skewed", "missing_values"}), preprocess.Feature("zeros", "numeric", {"zero_inflated"}), preprocess.Feature("color", "categorical", {"missing_values"}),
       preprocess.Feature("shop", "categorical", {"high_cardinality"})]


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        size = float(np.exp(rng.normal()))
        rows.append((i, None if i % 11 == 0 else size, 0.0 if i % 3 else size, None if i % 13 == 0 else ["red", "blue", "a.b"][i % 3], f"shop {int(rng.integers(0, 40))}", int(size + (i % 3 == 0) > 1.2)))
    return spark.createDataFrame(rows, "k long, size double, zeros double, color string, shop string, y int")


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest"])
def test_refit_keeps_its_preprocessing(spark, raw, tmp_path, kind):
    task, path = tables.Task("binary", [f.name for f in RAW], "y"), f"file://{tmp_path}/refit"
    refit.refit(raw, task, kind, path, features=RAW, options={"high_cardinality_max_categories": 6})
    model, again = refit.load_refit(spark, path)
    assert again == task and model.lineage["policy"] == ("tree_default" if kind == "random_forest" else "linear_default") and model.lineage["training_size"] == 160
    new = raw.filter("k < 40").withColumn("shop", F.when(F.col("k") % 2 == 0, "never seen").otherwise(F.col("shop")))
    got = {r["sample_id"]: tuple(r["probabilities"]) for r in refit.predict_refit(model, again, new.drop("y"), "k").collect()}
    # as fitted in memory, without storing
    fitted = preprocess.POLICIES[model.lineage["policy"]](raw, RAW, {"high_cardinality_max_categories": 6})
    trained = estimators.fit(estimators.with_features(fitted(raw), fitted.outputs()), task, kind)
    want = {r["sample_id"]: tuple(r["probabilities"]) for r in estimators.predict(trained, estimators.with_features(fitted(new), fitted.outputs()), task, "k").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    with pytest.raises(FileExistsError):
        refit.refit(raw, task, kind, path, features=RAW)


def test_refit_refuses_and_leaves_nothing_behind(spark, raw, tmp_path):
    task, path = tables.Task("binary", [f.name for f in RAW], "y"), f"file://{tmp_path}/refit"
    with pytest.raises(ValueError, match="target"):
        refit.refit(raw.withColumn("y", F.when(F.col("k") != 5, F.col("y"))), task, "logistic_regression", path, features=RAW)
    with pytest.raises(ValueError, match="missing_values"):
        refit.refit(raw, task, "logistic_regression", path, features=[preprocess.Feature(f.name, f.kind) for f in RAW])
    with pytest.raises(ValueError, match="can't be stored"):
        preprocess.POLICIES["as_it_is"] = lambda train, features, options=None, path=None: lambda frame: frame
        try:
            refit.refit(raw, task, "logistic_regression", path, features=RAW, policy="as_it_is")
        finally:
            del preprocess.POLICIES["as_it_is"]
    assert list(tmp_path.iterdir()) == []


def test_manifests_tell_equal_names_apart(spark, tmp_path):
    for folder, text in (("a", "one"), ("b", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.txt").write_text(text)
    root = f"file://{tmp_path}"
    wanted = store.manifest(spark, root)
    assert {r["file"] for r in wanted.collect()} == {"a/part.txt", "b/part.txt"}
    kept = [tuple(r) for r in wanted.collect()]
    (tmp_path / "b" / "part.txt").write_text("owt")
    got = {r["file"]: r["problem"] for r in store.verified(spark, root, spark.createDataFrame(kept, wanted.schema)).collect()}
    assert got == {"a/part.txt": None, "b/part.txt": "sha256"}


def test_a_policy_is_frozen_when_it_is_fitted(spark, raw, tmp_path):
    """Training rows that change later change nothing, and a stored copy transforms alike."""
    path = f"file://{tmp_path}/rows"
    raw.write.parquet(path)
    fitted = preprocess.linear_policy(spark.read.parquet(path), RAW)
    before = sorted(map(str, fitted(raw).collect()))
    raw.withColumn("size", F.col("size") * 9).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    fitted.save(f"file://{tmp_path}/policy")
    assert sorted(map(str, fitted(raw).collect())) == before == sorted(map(str, preprocess.Fitted(spark, f"file://{tmp_path}/policy")(raw).collect()))


def test_impute_options(spark):
    frame = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (4.0, None), (None, "b"), (9.0, "c")], "x double, c string")
    features = [preprocess.Feature("x", "numeric", {"missing_values"}), preprocess.Feature("c", "categorical", {"missing_values"})]
    for how, want in (("median", 2.5), ("mean", 3.75), ("most_frequent", 1.0), ("constant", 0.0)):
        got = preprocess.tree_policy(frame, features, {"numeric_impute": how})(frame).filter("x = 1.0 or true").select("x").collect()
        assert sorted(r["x"] for r in got) == sorted([1.0, 1.0, 4.0, 9.0, want])
    wide = preprocess.linear_policy(frame, features, {"categorical_impute": "constant"})
    assert wide.outputs() == ["x", "c_a", "c_b", "c_c", "c_missing_value"] and wide(frame).agg(F.sum("c_missing_value")).first()[0] == 1
    with pytest.raises(ValueError):
        preprocess.tree_policy(frame, features, {"numeric_impute": "no_such"})


def test_study_goes_on_after_a_failure(spark, raw, tmp_path):
    """A failed run is a row with its error; the next call does it and no other again; names of any signs are kept."""
    from foldwise.operators import study

    path = f"file://{tmp_path}/study"
    folds = raw.select("k", F.explode(F.array(*[F.struct(F.lit(f"fold/{i}").alias("resample_id"), F.when(F.col("k") % 2 == i, "test").otherwise("train").alias("role")) for i in range(2)])).alias("f")).select("f.*", "k")
    task = tables.Task("binary", [f.name for f in RAW], "y")

    def run(methods):
        return study.run_study("a case: 1", raw, task, folds, "k", methods, ["accuracy"], path, features=RAW)

    calls = []

    def fails_once(train, task, params):
        calls.append(1)
        if len(calls) <= 2:
            raise RuntimeError("not now")
        return estimators.logistic_regression(train, task, params)

    estimators.ESTIMATORS["fails_once"] = fails_once
    try:
        methods = {"most": study.Method("dummy_classifier", metadata={"team": "x"}), "late": study.Method("fails_once")}
        first = {r["run_key"]: r for r in run(methods).collect()}
        assert {r["method"]: r["status"] for r in first.values()} == {"most": "success", "late": "failed"} and len(first) == 4
        again = {r["run_key"]: r for r in run(methods).collect()}
    finally:
        del estimators.ESTIMATORS["fails_once"]
    assert set(again) == set(first) and all(r["status"] == "success" and 0 <= r["metrics"]["accuracy"] <= 1 for r in again.values()) and len(calls) == 4
    assert all(first[k]["fit_time"] == again[k]["fit_time"] for k in first if "most" in k) and again["a case: 1:most:fold/0:seed-0"]["metadata"]["team"] == "x"
    assert study.stored_predictions(run(methods), path).count() == 2 * 160
