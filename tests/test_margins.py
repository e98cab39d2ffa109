"""Support vector machines in the primal against plain numpy, and studies of bags."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import estimators, margins, resample, study
from foldwise.sources import tables


def plain_objective(w, x, y, penalty, half):
    total = 0.5 * float(w[1:] @ w[1:])
    for row, label in zip(x, y, strict=True):
        m = label * (w[0] + float(row @ w[1:]))
        total += penalty * (0.0 if m > 1 + half else 1 - m if m < 1 - half else (1 + half - m) ** 2 / (4 * half))
    return total


@pytest.mark.parametrize("penalty", [0.05, 1.0, 100.0])
def test_fits_have_the_least_loss(spark, penalty):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.3]
    y = np.where(x @ [1.0, 0.3, 2.0] + rng.normal(size=80) > 0.4, 1, -1)
    rows = spark.createDataFrame([(list(map(float, r)), int(v > 0)) for r, v in zip(x, y, strict=True)], "_x array<double>, _y int").repartition(7)
    w = margins.fit_margin(rows, margins.Waves(), 3, penalty)
    least = plain_objective(w, x, y, penalty, margins.CORNERS[-1])
    for _ in range(400):
        assert plain_objective(w + rng.normal(size=4) * 10 ** rng.uniform(-5, 0), x, y, penalty, margins.CORNERS[-1]) >= least * (1 - 1e-9)
    # a fit from other weights ends at the same place
    again = margins.fit_margin(rows, margins.Waves(), 3, penalty, start=w + 0.5)
    assert np.allclose(again, w, atol=1e-5 * max(1, np.abs(w).max()))


def test_equal_rows_are_counted_once_a_fit(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(30, 2)).round(1), rng.integers(0, 2, 30)
    single = [(list(map(float, r)), int(v)) for r, v in zip(x, y, strict=True)]
    frame = spark.createDataFrame(single, "_x array<double>, _y int")
    seen, step = [], margins.step_sums
    monkeypatch.setattr(margins, "step_sums", lambda rows, *more: (seen.append((rows.count(), more[0])), step(rows, *more))[1])
    copied = margins.fit_margin(frame.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("_c").repartition(16), margins.Waves(), 2, 0.3)
    assert set(seen) == {(len({(tuple(a), b) for a, b in single}), 1)}
    weighted = margins.fit_margin(frame.withColumn("_w", F.lit(40.0)), margins.Waves(), 2, 0.3)
    assert np.allclose(copied, weighted, atol=1e-6)
    # many partitions give what one does
    monkeypatch.setattr(margins, "ROWS", 1)
    assert np.allclose(margins.fit_margin(frame, margins.Waves(), 2, 12.0), copied, atol=1e-6) and max(n for _, n in seen) > 1


def test_a_fit_of_one_partition_is_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = spark.createDataFrame([(list(map(float, r)), int(r[0] + 0.3 * e > 0)) for r, e in zip(x, rng.normal(size=200), strict=True)], "_x array<double>, _y int").repartition(4)
    waves, context = margins.Waves.drawn(2, 0.5, 8, 0), spark.sparkContext

    def jobs_and_weights(name):
        context.setJobGroup(name, name)
        try:
            return len(context.statusTracker().getJobIdsForGroup(name)), margins.fit_margin(rows, waves, 2, 10.0), len(context.statusTracker().getJobIdsForGroup(name))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    none, alone, few = jobs_and_weights("alone")
    assert none == 0 and 0 < few <= 12
    # in several partitions each step is a job, whose sums come straight to the driver or are added up by tasks first
    monkeypatch.setattr(margins, "ROWS", 60)
    _, straight, many = jobs_and_weights("straight")
    monkeypatch.setattr(margins, "SENT", 0)
    _, added, _ = jobs_and_weights("added")
    assert many > 20 and np.allclose(straight, alone, atol=1e-6) and np.allclose(added, alone, atol=1e-6)


def test_waves_stand_in_for_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    made = margins.Waves.drawn(4, 0.2, 4_000, 0).of(x)
    apart = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    assert np.abs(made @ made.T - np.exp(-0.2 * apart)).max() < 0.08


def rings(spark, bags=60, each=4, seed=2):
    """Positive bags have one instance near the middle, all others lie on a ring."""
    rng, rows = np.random.default_rng(seed), []
    for b in range(bags):
        for i in range(each):
            angle, radius = rng.uniform(0, 2 * math.pi), 0.3 * rng.uniform() if b % 2 and i == 1 else 2 + 0.3 * rng.uniform()
            rows.append((b, i, radius * math.cos(angle), radius * math.sin(angle), b % 2))
    return spark.createDataFrame(rows, "bag long, k long, x double, y double, label int").repartition(5)


def test_a_kernel_separates_rings(spark):
    train, test = rings(spark), rings(spark, seed=9)

    def right(model):
        return model.bags(test, "bag").filter(F.col("label") == F.col("bag") % 2).count()

    curved, _, ended = margins.mi_svm(train, "bag", "k", ["x", "y"], "label", params={"kernel": "rbf", "C": 10.0})
    straight, _, _ = margins.mi_svm(train, "bag", "k", ["x", "y"], "label", params={"C": 10.0})
    assert ended in ("fixed point", "cycle") and right(curved) >= 58 and right(straight) <= 45
    kept = margins.MarginModel.from_json(curved.to_json())
    assert kept.bags(test, "bag").exceptAll(curved.bags(test, "bag")).count() == 0


def test_rounds_follow_a_plain_version(spark):
    train = rings(spark, bags=24)
    model, rounds, ended = margins.mi_svm(train, "bag", "k", ["x", "y"], "label", params={"kernel": "rbf", "C": 10.0, "projections": 20})
    rows = [tuple(r) for r in train.collect()]
    positive = sorted({r[0] for r in rows if r[4]})
    x_of = lambda r: model.waves.of(np.array([r[2:4]]))[0]
    score = lambda r: model.weights[0] + float(x_of(r) @ model.weights[1:])
    witnesses = [max((r for r in rows if r[0] == b), key=lambda r: (round(score(r), 9), -r[1])) for b in positive]
    # at a fixed point the model is the fit of all negative instances and its own witnesses
    assert ended == "fixed point"
    chosen = [r for r in rows if not r[4]] + witnesses
    x, y = np.array([x_of(r) for r in chosen]), [1 if r[4] else -1 for r in chosen]
    least, rng = plain_objective(model.weights, x, y, 10.0, margins.CORNERS[-1]), np.random.default_rng(0)
    for _ in range(200):
        assert plain_objective(model.weights + rng.normal(size=41) * 10 ** rng.uniform(-5, -1), x, y, 10.0, margins.CORNERS[-1]) >= least * (1 - 1e-9)


def test_what_is_refused(spark):
    one = spark.createDataFrame([(1, 1, 0.5, 1), (2, 1, 0.7, 1)], "bag long, k long, x double, label int")
    with pytest.raises(ValueError, match="positive and negative"):
        margins.mi_svm(one, "bag", "k", ["x"], "label")
    both = spark.createDataFrame([(1, 1, 0.5, 1), (2, 1, None, 0)], "bag long, k long, x double, label int")
    with pytest.raises(Exception, match="missing"):
        margins.mi_svm(both, "bag", "k", ["x"], "label")
    for params in ({"kernel": "poly"}, {"reg": 1.0}):
        with pytest.raises(ValueError):
            margins.mi_svm(both.fillna(0.0), "bag", "k", ["x"], "label", params=params)


def test_a_study_of_bags(spark, tmp_path):
    rows = estimators.with_features(rings(spark), ["x", "y"])
    folds = resample.fold_roles(resample.kfold(rows.select("bag").distinct(), "bag", 2, seed=1), "bag", 2)
    task = tables.Task("binary", ["x", "y"], "label")
    methods = {"svm": study.Method("mi_svm", {"C": 10.0}), "pool": study.Method("instance_pooling"), "rows": study.Method("logistic_regression")}
    found = study.run_study("rings", rows, task, folds, "bag", methods, ["accuracy"], f"file://{tmp_path}/study", instance="k")
    got = {r["run_key"].split(":")[1]: r for r in found.orderBy("run_key").collect()}
    assert got["rows"]["status"] == "failed" and "instances of bags" in got["rows"]["error"]
    assert got["svm"]["status"] == "success" and got["svm"]["metrics"]["accuracy"] > 0.9 > got["pool"]["metrics"]["accuracy"]
    made = study.stored_predictions(found, f"file://{tmp_path}/study")
    assert made.groupBy("method", "sample_id").count().filter("count <> 1").count() == 0 and made.filter("method = 'svm'").count() == 60
