"""Literal expectations and invariants of the library."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import bags, estimators, metrics, preprocess, refit, reports, resample
from foldwise.sources import relational_text, store, tables


def test_roles_and_selection(spark):
    toy = spark.createDataFrame([("a", 1.0, "x", 1, 0.5), ("b", 2.0, "y", 0, 1.0)], "row_id string, age double, segment string, income long, weight double")
    roles = tables.with_roles(toy, {"row_id": "id", "income": "binary", "weight": "weight"}, {"age": ["skewed", "missing_values"]})
    assert tables.columns_of(roles, kinds=["numeric"]) == ["age"]
    assert tables.columns_of(roles, include=["skewed", "bounded"]) == []
    assert tables.columns_of(roles, include=["skewed", "bounded"], match_all=False) == ["age"]
    assert tables.columns_of(roles, kinds=["numeric", "categorical"], exclude=["skewed"]) == ["segment"]
    with pytest.raises(ValueError):
        tables.with_roles(toy, {"nothing": "id"})
    with pytest.raises(ValueError):
        tables.Task("regression", ["age", "nothing"], "income").sources(toy)


def test_datasets_that_their_schema_doesnt_fit(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), (None, 4.0)], "k string, x double")
    got = {tuple(r) for r in tables.dataset_violations(frame.select("k", "x", "x"), {"k": "numeric", "y": "numeric"}, "k").collect()}
    assert got == {("duplicate_column", "x", 2), ("missing_from_schema", "x", 1), ("extra_in_schema", "y", 1), ("row_id_kind", "k", 1), ("row_id_repeated", "k", 3)}
    assert tables.columns_of(tables.checked_dataset(frame.limit(2), {"k": "id", "x": "numeric"}, "k"), kinds=["id"]) == ["k"]
    with pytest.raises(ValueError, match="row_id_absent"):
        tables.checked_dataset(frame, {"k": "id", "x": "numeric"}, "z")


def test_case_records_that_differ_are_refused(spark, tmp_path):
    frame = spark.createDataFrame([(i, float(i)) for i in range(6)], "k long, y double")
    task, path = tables.Task("regression", [], "y"), f"file://{tmp_path}/case"
    records = [store.case_record("c", frame, task, resample.fold_roles(resample.kfold(frame, "k", 2, seed), "k", 2), "k") for seed in (1, 1, 2)]
    store.save_case(records[0], path)
    store.save_case(records[1], path)
    with pytest.raises(ValueError, match="another record"):
        store.save_case(records[2], path)


def test_splits_keep_null_keys_and_take_any_type(spark):
    rows = [("b",), ("a",), (None,), ("ü",), ("d",), ("c",)]
    for seed in (None, 4):
        folds = resample.kfold(spark.createDataFrame(rows, "k string"), "k", 2, seed).collect()
        assert sorted(r["fold"] for r in folds) == [0, 0, 0, 1, 1, 1] and {r["k"] for r in folds} == {r[0] for r in rows}
    days = spark.sql("select date_add(date'2024-01-01', cast(id as int)) as k from range(50)")
    ordered = [r["position"] for r in resample.ranked(days, "k", rows=7).orderBy("k").collect()]
    assert ordered == list(range(50))
    with pytest.raises(ValueError):
        resample.kfold(days, "k", 1)
    with pytest.raises(ValueError):
        resample.holdout(days, "k", 1.5)


def test_missing_guard(spark):
    frame = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="missing"):
        tables.refuse_missing(frame).collect()
    assert tables.columns_of(tables.with_missing_tags(tables.with_roles(frame)), include=["missing_values"]) == ["x"]


def test_holdout_takes_last_rows(spark):
    frame = spark.range(10).withColumnRenamed("id", "k")
    got = {r["k"]: r["role"] for r in resample.holdout(frame, "k", 0.25).collect()}
    assert [k for k, role in got.items() if role == "test"] and sorted(k for k, r in got.items() if r == "test") == [7, 8, 9]


@pytest.mark.parametrize("seed", [None, 3])
@pytest.mark.parametrize("partitions", [1, 37])
def test_kfold_blocks(spark, seed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        folds = resample.kfold(spark.range(103).withColumnRenamed("id", "k"), "k", 5, seed).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    sizes = [sum(r["fold"] == i for r in folds) for i in range(5)]
    assert sizes == [21, 21, 21, 20, 20]
    if seed is None:
        assert [r["fold"] for r in folds] == sorted(r["fold"] for r in folds)


def test_group_kfold_is_greedy(spark):
    sizes = [9, 7, 7, 5, 5, 5, 4, 2, 2, 1, 1, 1, 1]
    rows = [(100 * g + i, g) for g, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "k long, g long")
    folds = resample.group_kfold(frame, "k", ["g"], 3).join(frame, "k").groupBy("g").agg(F.count_distinct("fold").alias("n"), F.first("fold").alias("fold"), F.count("*").alias("size")).collect()
    assert all(r["n"] == 1 for r in folds)
    loads = [0, 0, 0]
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    assert sorted(sum(r["size"] for r in folds if r["fold"] == i) for i in range(3)) == sorted(loads)


def test_bootstrap_keeps_repeats(spark):
    drawn = resample.bootstrap(spark.range(40).withColumnRenamed("id", "k"), "k", 2, 1)
    for r in drawn.groupBy("resample_id").agg(F.sum(F.when(F.col("role") == "train", F.col("multiplicity"))).alias("n"), F.count_if(F.col("role") == "test").alias("oob"), F.count("*").alias("all")).collect():
        assert r["n"] == 40 and r["oob"] > 0 and r["all"] == 40


def test_leakage(spark):
    """Statistics come from training rows: other test rows change nothing for training rows."""
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    fitted = preprocess.linear_policy(train, [preprocess.Feature("x", "numeric")])
    assert [r["x"] for r in fitted(spark.createDataFrame([(1.0,), (3.0,), (1000.0,)], "x double")).collect()] == [-1.0, 1.0, 998.0]


def test_unseen_categories_are_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    every = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [tuple(r) for r in preprocess.one_hot(every, train, "c").select("c_a", "c_b").collect()] == [(1, 0), (0, 0), (0, 0)]
    assert [r[0] for r in preprocess.ordinal(every, train, "c").orderBy("c").select("c__index").collect()] == [-1, 0, -1]


def test_policy_refuses(spark):
    frame = spark.createDataFrame([(1.0, "t"), (None, "u")], "x double, t string")
    with pytest.raises(ValueError, match="tagged"):
        preprocess.linear_policy(frame, [preprocess.Feature("x", "numeric")])
    with pytest.raises(ValueError, match="kinds"):
        preprocess.linear_policy(frame, [preprocess.Feature("t", "text")])
    with pytest.raises(ValueError, match="options"):
        preprocess.tree_policy(frame, [], {"no_such": 1})


def test_infrequent(spark):
    frame = spark.createDataFrame([(c,) for c in "aaaabbbccd"], "c string")
    wide = preprocess.one_hot(frame, frame, "c", most=3)
    assert [c for c in wide.columns if c != "c"] == ["c_a", "c_b", "c_infrequent"]
    assert wide.agg(F.sum("c_infrequent")).first()[0] == 3


def test_metrics(spark):
    binary = spark.createDataFrame([(0, 0, 0, [0.9, 0.1]), (0, 1, 1, [0.2, 0.8]), (0, 1, 0, [0.6, 0.4]), (0, 0, 0, [0.7, 0.3])], "run int, y_true int, label int, probabilities array<double>")
    got = metrics.metrics_of(binary, ["run"], ["accuracy", "roc_auc", "log_loss"]).first()
    assert got["accuracy"] == 0.75 and got["roc_auc"] == 1.0
    assert got["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(0.4) + math.log(0.7)) / 4)
    margins = spark.createDataFrame([(0, 0, -2.0), (0, 1, 1.0), (0, 1, 2.0), (0, 0, -1.0)], "run int, y_true int, score double")
    assert metrics.metrics_of(margins, ["run"], ["roc_auc"]).first()["roc_auc"] == 1.0
    values = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 4.0), (0, 4.0, 7.0)], "run int, y_true double, value double")
    got = metrics.metrics_of(values, ["run"], ["mse", "rmse", "mae"]).first()
    assert got["mse"] == pytest.approx(13 / 3) and got["rmse"] == pytest.approx(math.sqrt(13 / 3)) and got["mae"] == pytest.approx(5 / 3)
    with pytest.raises(KeyError):
        metrics.metrics_of(values, ["run"], ["no_such"])
    with pytest.raises(ValueError):
        metrics.metrics_of(values, ["run"], ["accuracy"])


def runs(spark, rows):
    return spark.createDataFrame(rows, "study_name string, case_name string, dataset_name string, task_name string, method string, status string, primary_metric string, primary_metric_greater_is_better string, `metric.accuracy` double, `metadata.model` string")


def test_report(spark):
    rows = [("s", "c", d, "t", m, "success", "accuracy", "True", v, m) for d, m, v in (("d1", "a", 0.8), ("d1", "a", 0.9), ("d1", "b", 0.7), ("d2", "a", 0.6), ("d2", "b", 0.65), ("d1", "x", 0.99))]
    report = reports.with_ranks(reports.aggregate_runs(runs(spark, rows)))
    got = {(r["dataset_name"], r["method"]): r for r in report.collect()}
    one = got["d1", "a"]
    assert one["metric.accuracy.mean"] == pytest.approx(0.85) and one["metric.accuracy.iqr"] == pytest.approx(0.05) and one["n_runs"] == 2
    assert one["primary_metric_rank_by_dataset"] == 2 and got["d1", "x"]["primary_metric_rank_by_dataset"] == 1
    assert got["d1", "x"]["primary_metric_overall_rank"] is None and got["d1", "x"]["primary_metric_rank_coverage"] == 0.5
    assert got["d1", "a"]["primary_metric_overall_rank"] is not None


def test_failed_runs_count_their_metrics(spark):
    rows = [("s", "c", "d", "t", "a", "success", "accuracy", "true", 0.7, "m"), ("s", "c", "d", "t", "a", "failed", "accuracy", "true", 0.9, "n"), ("s", "c", "d", "t", "b", "success", "accuracy", "true", float("nan"), "")]
    got = {r["method"]: r for r in reports.with_ranks(reports.aggregate_runs(runs(spark, rows))).collect()}
    assert got["a"]["metric.accuracy.mean"] == pytest.approx(0.8) and got["a"]["n_failed"] == 1 and got["a"]["primary_metric_rank_by_dataset"] is None
    assert got["a"]["metadata.model"] is None and got["b"]["metric.accuracy.count"] == 0 and got["b"]["primary_metric_rank_by_dataset"] is None


def test_null_keys_match(spark):
    rows = [(None, "c", "d", "t", "a", "success", "accuracy", "true", 0.7, "m"), (None, "c", "d", "t", "b", "success", "accuracy", "true", 0.8, "m")]
    assert {r["method"]: r["primary_metric_overall_rank"] for r in reports.with_ranks(reports.aggregate_runs(runs(spark, rows))).collect()} == {"a": 2.0, "b": 1.0}


def test_relational_text(spark, tmp_path):
    text = "@relation r\n@attribute bag_id {a,b}\n@attribute bag relational\n@attribute x numeric\n@attribute y real\n@end bag\n@attribute class {0,1}\n@data\na,\"1,2\\n3,?\",0\nb,\"5,6\n\",1\n"
    (tmp_path / "bags.arff").write_text(text)
    bags_, instances = relational_text.read_relational_text(spark, f"file://{tmp_path}/bags.arff")
    assert [tuple(r) for r in bags_.orderBy("bag_id").collect()] == [("a", "0"), ("b", "1")]
    assert [tuple(r) for r in instances.orderBy("bag_id", "position").collect()] == [("a", 0, 1.0, 2.0), ("a", 1, 3.0, None), ("b", 0, 5.0, 6.0)]


def test_relational_files_are_read_in_ranges(spark, tmp_path):
    """Files cut into ranges of a few hundred bytes, inside quoted fields too, give the same bags."""
    head = "@relation r\n@attribute bag_id string\n@attribute bag relational\n@attribute x numeric\n@attribute y string\n@end bag\n@attribute class {0,1}\n@DATA\n"
    want = {}
    (tmp_path / "files").mkdir()
    for f in range(2):
        records = []
        for b in range(40):
            lines = [f"{b + i / 8},a{i}" for i in range(b % 7)]
            want[f"f{f}b{b}"] = [float(x.split(",")[0]) for x in lines]
            records.append(f"f{f}b{b}," + '"' + "\n".join(lines) + '"' + f",{b % 2}")
        (tmp_path / "files" / f"{f}.arff").write_text(head + "\n".join(records) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = f"file://{tmp_path}/files"
        assert relational_text.numbered_lines(spark, path).select("_file", "_block").distinct().count() > 8
        bags_, instances = relational_text.read_relational_text(spark, path)
        got = {r["bag_id"]: [] for r in bags_.collect()}
        for r in instances.orderBy("bag_id", "position").collect():
            got[r["bag_id"]].append(r["x"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_long_relational_records(spark):
    """Time grows with a record's length."""
    import time

    header = relational_text.Header([("id", "string"), ("bag", "relational"), ("class", "string")], [("x", "numeric")], "bag")
    body = "\n".join(f"{i}" for i in range(100_000))
    began = time.time()
    frame = spark.createDataFrame([(f'a,"{body}",1',), ("b,,",)], "value string")
    bags_, instances = relational_text.parse_records(frame, header)
    assert instances.count() == 100_000 and {tuple(r) for r in bags_.collect()} == {("a", "1"), ("b", "")} and time.time() - began < 60


def test_empty_bags_and_clash(spark):
    bag = spark.createDataFrame([(1,), (2,)], "b long")
    instances = spark.createDataFrame([(1, 2.0), (1, float("nan"))], "i long, x double")
    got = {r["b"]: r for r in bags.bag_summary(bag, instances, "b", "i", ["x"]).collect()}
    assert got[2]["bag_size"] == 0 and got[2]["x__mean"] is None and got[1]["x__mean"] == 2.0 and got[1]["bag_size"] == 2
    with pytest.raises(ValueError):
        bags.bag_summary(bag.withColumn("x__mean", F.lit(1)), instances, "b", "i", ["x"])


def test_summary_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("a|b", 0.123456789, ""), ("c", None, "n")], "name string, value double, note string")
    store.save_summary(frame, csv=f"file://{tmp_path}/c", json=f"file://{tmp_path}/j", markdown=f"file://{tmp_path}/m")
    back = {r["name"]: r for r in store.load_summary(spark, f"file://{tmp_path}/c").collect()}
    assert back["a|b"]["note"] == "" and back["c"]["value"] == ""
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/m").collect()]
    assert "| a\\|b | 0.123457 |  |" in lines


def test_refit_checks_files(spark, tmp_path):
    frame = spark.createDataFrame([(float(i), int(i > 5), i) for i in range(12)], "x double, y int, k long")
    task = tables.Task("binary", ["x"], "y")
    path = f"{tmp_path}/refit"
    refit.refit(frame, task, "logistic_regression", f"file://{path}")
    model, again = refit.load_refit(spark, f"file://{path}")
    assert refit.predict_refit(model, again, frame, "k").filter("label = y_true").count() >= 10
    with pytest.raises(ValueError):
        refit.predict_refit(model, again, frame.drop("x"), "k")
    spark.createDataFrame([("gone.parquet", 1, "0")], "file string, length long, sha256 string").write.mode("append").json(f"file://{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        refit.load_refit(spark, f"file://{path}")


def test_failed_run_record():
    got = estimators.run_record("r", lambda: 1 / 0)
    assert got["status"] == "failed" and got["error_type"] == "ZeroDivisionError"


def test_bootstrap_leaves_rows_out(spark):
    """Of few rows a sample is drawn again until one is left out; of one row none can be."""
    for n in (2, 3, 5):
        drawn = resample.bootstrap(spark.createDataFrame([(i,) for i in range(n)], "k long"), "k", 40, seed=3).collect()
        for s in {r["resample_id"] for r in drawn}:
            mine = [r for r in drawn if r["resample_id"] == s]
            assert any(r["role"] == "test" for r in mine) and sum(r["multiplicity"] for r in mine if r["role"] == "train") == n
    with pytest.raises(ValueError):
        resample.bootstrap(spark.createDataFrame([(1,)], "k long"), "k", 2, seed=3)


def test_metric_options(spark):
    frame = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 0, 1, 3.0)], "run string, label int, y_true int, w double")
    assert metrics.metrics_of(frame, ["run"], ["accuracy"], options={"accuracy": {"normalize": False}}).first()["accuracy"] == 1.0
    assert metrics.metrics_of(frame, ["run"], ["accuracy"], weight="w", options={"accuracy": {"normalize": False}}).first()["accuracy"] == 2.0


def test_total_correlation_of_four_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    frame = spark.createDataFrame([(1, *map(float, r)) for r in x], "bag int, a double, b double, c double, d double")
    got = bags.total_correlation(frame, "bag", ["a", "b", "c", "d"]).first()["total_correlation"]
    cov = np.cov(x.T, bias=True)
    assert got == pytest.approx(0.5 * (np.log(np.diag(cov)).sum() - np.linalg.slogdet(cov)[1]))


def test_policy_by_resample(spark):
    rows = [("a", "train", 1.0, None), ("a", "train", 3.0, 2.0), ("a", "test", 5.0, 4.0), ("b", "train", 10.0, 1.0), ("b", "valid", 30.0, 3.0), ("b", "test", None, None)]
    frame = spark.createDataFrame(rows, "resample_id string, role string, x double, y double")
    features = [preprocess.Feature("x", "numeric"), preprocess.Feature("y", "numeric", {"missing_values"})]
    got = {(r["resample_id"], r["role"], r["x"]): r["y"] for r in preprocess.resample_policy(frame, features).collect()}
    assert got == {("a", "train", -1.0): 0.0, ("a", "train", 1.0): 0.0, ("a", "test", 3.0): 2.0, ("b", "train", -1.0): -1.0, ("b", "valid", 1.0): 1.0, ("b", "test", None): 0.0}
    with pytest.raises(ValueError):
        preprocess.resample_policy(frame, [preprocess.Feature("y", "numeric")])


def test_weights_are_not_dropped(spark):
    rows = spark.createDataFrame([(float(i), i % 3, 1.0) for i in range(9)], "x double, y int, w double")
    made = estimators.with_features(rows, ["x"])
    for kind in ("gradient_boosting", "simple_mlp"):
        with pytest.raises(ValueError):
            estimators.fit(made, tables.Task("multiclass", ["x"], "y", weight="w"), kind)


def test_conflicting_evidence(spark):
    frame = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "name string, record string")
    assert [r[0] for r in store.conflicts(frame, "name", F.col("record")).collect()] == ["b"]


def test_ranks_of_reports_that_lack_columns(spark):
    plain = spark.createDataFrame([("m", 1)], "method string, n_runs int")
    assert reports.with_ranks(plain).columns == plain.columns
    frame = spark.createDataFrame([("a", 1, 1, 1, 0.5, "True"), ("b", 1, 1, 1, 0.7, "True")], "method string, n_runs long, n_success long, primary_metric_count long, primary_metric_mean double, primary_metric_greater_is_better string")
    got = {r["method"]: (r["primary_metric_overall_rank"], r["dataset_name"]) for r in reports.with_ranks(frame).collect()}
    assert got == {"a": (2.0, ""), "b": (1.0, "")}


def test_mi_svm_says_how_it_ended(spark):
    # one instance of each positive bag lies at 4 and the others at 0, as all instances of negative bags do
    bags_ = spark.createDataFrame([(b, i, 4.0 if i == 0 and b % 2 else 0.1 * i, b % 2) for b in range(12) for i in range(4)], "bag long, k long, x double, label int")
    model, rounds, ended = estimators.mi_svm(bags_, "bag", "k", ["x"], "label")
    assert ended == "fixed point" and rounds >= 2 and 0 < -model.intercept / model.coefficients[0] < 4
    once = estimators.mi_svm(bags_, "bag", "k", ["x"], "label", max_iterations=1)
    # a single round is fitted on means; the last witnesses are fitted once more
    assert once[1:] == (1, "limit") and np.allclose(once[0].coefficients.toArray(), model.coefficients.toArray(), atol=1e-3)


def test_pooled_labels_of_equal_means_are_the_first(spark):
    # the mean is 100 / 3, where q / 100 and 1 - q / 50 are both 1/3, whatever the order of the sum
    rows = [(b, float(q)) for b, bag in enumerate(itertools.permutations((50, 49, 1, 48, 2, 50))) for q in bag]
    lines = spark.createDataFrame(rows, "bag long, q double").coalesce(1).select("bag", (F.col("q") / 50 * 0.5).alias("p0"), (1 - F.col("q") / 50).alias("p1"), (F.col("q") / 50 * 0.5).alias("p2"))
    labels = bags.pooled_probabilities(lines, "bag", ["p0", "p1", "p2"], "mean").groupBy("label").count().collect()
    assert [tuple(r) for r in labels] == [(0, 720)]


def test_folds_keep_other_columns(spark):
    rows = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    kept = resample.kfold(rows, "key", 5, 1, "x")
    assert kept.columns == ["key", "x", "fold"] and kept.filter("x <> 2 * key").count() == 0
    assert kept.drop("x").exceptAll(resample.kfold(rows, "key", 5, 1)).count() == 0


def test_sort_keys_are_made_where_rows_have_arrived(spark):
    plan = resample.ranked(spark.range(50).toDF("key"), "key", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("AS _order") < plan.find("RepartitionByExpression")


def test_draws_read_stored_places(spark):
    plan = resample.bootstrap(spark.range(50).toDF("key"), "key", 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
