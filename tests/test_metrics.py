"""ROC areas by ranges, of several classes, with weights and options."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from foldwise.functions import columns
from foldwise.operators import metrics


def area(rows, good, weight=None):
    """Share of pairs that the score puts right, ties half; rows: (truth, score, weight)."""
    won = total = 0.0
    for (t1, s1, w1), (t2, s2, w2) in itertools.product(rows, rows):
        if good(t1) and not good(t2):
            w = (w1 * w2) if weight else 1.0
            total += w
            won += w * (1.0 if s1 > s2 else 0.5 if s1 == s2 else 0.0)
    return won / total if total else None


@pytest.fixture(scope="module")
def three(spark):
    rng = random.Random(4)
    rows = []
    for run in ("a", None):
        for _ in range(60):
            p = [rng.randint(1, 5) for _ in range(3)]
            rows.append((run, rng.randrange(3), [x / sum(p) for x in p], float(rng.randint(1, 4)), rng.random()))
    return rows, spark.createDataFrame(rows, "run string, y_true int, probabilities array<double>, w double, score double")


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("average", ["macro", "weighted"])
def test_several_classes(three, weight, average):
    rows, frame = three
    got = {r["run"]: r["roc_auc"] for r in metrics.metrics_of(frame, ["run"], ["roc_auc"], weight, {"roc_auc": {"average": average}}).collect()}
    for run in ("a", None):
        mine = [r for r in rows if r[0] == run]
        areas = [area([(t, p[c], w) for _, t, p, w, _ in mine], lambda t, c=c: t == c, weight) for c in range(3)]
        sizes = [sum((r[3] if weight else 1.0) for r in mine if r[1] == c) if average == "weighted" else 1.0 for c in range(3)]
        assert got[run] == pytest.approx(sum(a * s for a, s in zip(areas, sizes, strict=True)) / sum(sizes))


def test_probabilities_come_before_scores_and_weights_count(spark):
    rows = [(0, 0, [0.9, 0.1], 0.9, 1.0), (0, 1, [0.2, 0.8], 0.1, 5.0), (0, 1, [0.6, 0.4], 0.2, 2.0), (0, 0, [0.3, 0.7], 0.8, 3.0)]
    frame = spark.createDataFrame(rows, "run int, y_true int, probabilities array<double>, score double, w double")
    for weight in (None, "w"):
        got = metrics.metrics_of(frame, ["run"], ["roc_auc"], weight).first()["roc_auc"]
        assert got == pytest.approx(area([(t, p[1], w) for _, t, p, _, w in rows], lambda t: t == 1, weight))


def test_unknown_options_are_refused(three):
    _, frame = three
    for options in ({"roc_auc": {"multi_class": "ovo"}}, {"roc_auc": {"no_such": 1}}, {"accuracy": {"normalize": False}}):
        with pytest.raises(ValueError):
            metrics.metrics_of(frame, ["run"], ["roc_auc"], options=options)


def test_windows_stay_inside_ranges(spark):
    """Many distinct scores: right, and no range with much more than its share."""
    n = 20_000
    frame = spark.range(n).select(F.lit("a").alias("run"), (F.xxhash64("id") / 1e19).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("y_true"))
    rows = frame.orderBy("score").collect()
    ranks = sum(i + 1 for i, r in enumerate(rows) if r["y_true"])
    p = sum(r["y_true"] for r in rows)
    got = metrics.roc_auc(frame, ["run"]).first()["roc_auc"]
    assert got == pytest.approx((ranks - p * (p + 1) / 2) / (p * (n - p)))
    cuts = sorted(set(frame.agg(F.percentile_approx("score", [i / metrics.RANGES for i in range(1, metrics.RANGES)], 10 * metrics.RANGES).alias("c")).first()["c"]))
    sizes = frame.withColumn("c", F.array(*map(F.lit, cuts))).groupBy(metrics.place(F.col("score"), F.col("c"), metrics.RANGES).alias("r")).count().collect()
    assert len(sizes) > metrics.RANGES * 0.9 and max(r["count"] for r in sizes) < 3 * n / metrics.RANGES


def test_place(spark):
    frame = spark.createDataFrame([(float(v),) for v in (-5, 0, 1, 1.5, 2, 99)], "v double").withColumn("c", F.array(*[F.lit(float(x)) for x in (0, 1, 2)]))
    assert [r[0] for r in frame.select(metrics.place(F.col("v"), F.col("c"), 4)).collect()] == [0, 0, 1, 2, 2, 3]


@pytest.mark.parametrize("by", [["run"], ["run", "y_true"]])
def test_scores_are_computed_once(spark, by):
    rows = spark.createDataFrame([(f"r{i % 3}", i % 2, (i * 7 % 50) / 50) for i in range(200)], "run string, y_true int, x double").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    found = metrics.roc_auc(rows.withColumn("score", counted.asNondeterministic()("x")), by)
    assert found.count() == rows.select(*by).distinct().count() and calls.value == 200


def test_weighted_areas_of_many_scores(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), [a / (a + b + c) for v in [(a, b, c)] for a in v], float(rng.randint(1, 3))) for a, b, c in ((rng.random() + 0.1, rng.random() + 0.1, rng.random() + 0.1) for _ in range(400))]
    frame = spark.createDataFrame([("all", *r) for r in rows], "run string, y_true int, probabilities array<double>, w double")
    got = metrics.metrics_of(frame, ["run"], ["roc_auc"], "w", {"roc_auc": {"average": "weighted"}}).first()["roc_auc"]
    sizes = [sum(w for t, _, w in rows if t == c) for c in range(3)]
    areas = [area([(t, p[c], w) for t, p, w in rows], lambda t, c=c: t == c, True) for c in range(3)]
    assert got == pytest.approx(sum(a * s for a, s in zip(areas, sizes, strict=True)) / sum(sizes), abs=1e-12)
    # an array's size goes with its entries, not the array
    assert "probabilities" not in metrics.roc_auc_ovr(frame, ["run"])._jdf.queryExecution().optimizedPlan().toString()


def test_softmax_raises_each_logit_once(spark):
    made = spark.createDataFrame([([1.0, 3.0, 2.0],), ([],), (None,)], "x array<double>").select(columns.multiclass_decision(F.col("x")).alias("d"))
    assert made._jdf.queryExecution().analyzed().toString().lower().count("exp(") == 1
    first = made.first()["d"]
    whole = sum(math.exp(v - 3) for v in (1, 3, 2))
    assert first["label"] == 1 and first["probabilities"] == pytest.approx([math.exp(v - 3) / whole for v in (1, 3, 2)])
