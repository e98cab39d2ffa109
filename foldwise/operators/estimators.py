"""Fit and predict: closed-form methods for all resamples in one job, and Spark ML estimators by kind.

Rows have resample_id and role; methods without a validation phase train on the roles train and valid.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.columns import binary_decision, same, sigmoid
from foldwise.operators import bags as bg
from foldwise.operators.margins import mi_svm  # noqa: F401  one of the estimators
from foldwise.operators.statistics import quantiles
from foldwise.sources.tables import Task


def trained(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("role").isin("train", "valid"))


def dummy_classifier(rows: DataFrame, target: str, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """The test rows with the most frequent class of the training rows (the smallest on ties) and its share."""
    counts = trained(rows).groupBy(*by, target).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*by).agg(F.min_by(target, F.struct(-F.col("_n"), F.col(target))).alias("label"), (F.max("_n") / F.sum("_n")).alias("prior"))
    return rows.filter("role = 'test'").join(top, list(by))


def dummy_regressor(rows: DataFrame, target: str, strategy: str = "mean", quantile: float = 0.5, constant: float = 0.0, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """The test rows with one value of the training rows; medians and quantiles are exact and come by rank."""
    by = list(by)
    if strategy in ("median", "quantile"):
        values = quantiles(trained(rows), {target: 0.5 if strategy == "median" else quantile}, by).drop("_column")
    else:
        values = trained(rows).groupBy(*by).agg({"mean": F.avg(target), "constant": F.max(F.lit(constant))}[strategy].alias("value"))
    return rows.filter("role = 'test'").join(values, by)


def line(rows: DataFrame, feature: str, target: str, alpha: float = 0.0, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """The test rows with the value of a line fitted to the training rows; alpha: an L2 penalty of the slope."""
    sums = trained(rows).groupBy(*by).agg(F.avg(feature).alias("_x"), F.avg(target).alias("_y"), F.covar_pop(feature, target).alias("_c"), F.var_pop(feature).alias("_v"), F.count("*").alias("_n"))
    spread = F.col("_v") + F.lit(alpha) / F.col("_n")
    fits = sums.select(*by, F.when(spread > 0, F.col("_c") / spread).otherwise(0.0).alias("_slope"), "_x", "_y")
    return rows.filter("role = 'test'").join(fits, list(by)).withColumn("value", F.col("_y") + F.col("_slope") * (F.col(feature) - F.col("_x"))).drop("_x", "_y", "_slope")


#: Features of the methods that fit all resamples at once: their sums are columns of one aggregation.
MOST_FEATURES = 32


def features_within(features: Sequence[str]) -> list[str]:
    if not 0 < len(features) <= MOST_FEATURES:
        raise ValueError(f"1 to {MOST_FEATURES} features can be fitted for all resamples at once, not {len(features)}")
    return list(features)


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with these columns as doubles; a null or NaN in one is an error."""
    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"{c} is missing in a row")).cast("double")).otherwise(x)

    return rows.withColumns({c: value(c) for c in columns})


def linear_fits(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """by, coefficients (an array) and intercept of the least squares of each group's training rows; alpha: an L2 penalty.

    One aggregation gives the means and covariances of all groups, of which (features + 1)^2 / 2 numbers a group come to the
    driver and are solved there. A feature that depends on others (as a constant one does) shares their coefficients' least size.
    """
    features, by, spark = features_within(features), list(by), rows.sparkSession
    k, names = len(features), [*features, target]
    base = complete(trained(rows), names)
    sums = base.groupBy(*by).agg(
        F.count("*").alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_means"),
        F.array(*[F.covar_pop(names[i], names[j]) for i in range(k + 1) for j in range(i + 1)]).alias("_covariances"))
    fits = []
    for r in sums.collect():
        both = np.zeros((k + 1, k + 1))
        both[np.tril_indices(k + 1)] = r["_covariances"]
        means, penalised = np.array(r["_means"]), both[:k, :k] + np.tril(both[:k, :k], -1).T + np.eye(k) * alpha / r["_n"]
        # by deviations, so that features of any size weigh alike in what counts as dependent
        scale = np.sqrt(np.diag(penalised))
        scale[scale == 0] = 1.0
        found = np.linalg.lstsq(penalised / np.outer(scale, scale), both[k, :k] / scale, rcond=1e-12)[0] / scale
        fits.append((*[r[c] for c in by], found.tolist(), float(means[k] - found @ means[:k])))
    kinds = dict(base.dtypes)
    return spark.createDataFrame(fits, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "coefficients array<double>, intercept double"]))


def decision(features: Sequence[str]) -> Column:
    """intercept and coefficients at a row's features."""
    return sum((F.col("coefficients")[i] * F.col(c).cast("double") for i, c in enumerate(features)), F.col("intercept"))


def linear(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """The test rows with the value of the plane fitted to their group's training rows."""
    fits = linear_fits(rows, features, target, alpha, by)
    # one row for each group
    return rows.filter("role = 'test'").join(F.broadcast(fits), list(by)).withColumn("value", decision(features)).drop("coefficients", "intercept")


def logistic_fits(rows: DataFrame, features: Sequence[str], target: str, inverse_penalty: float = 1.0, by: Sequence[str] = ("resample_id",), steps: int = 60, close: float = 1e-9) -> DataFrame:
    """by, coefficients, intercept and steps of the logistic regressions (targets 0 and 1) of all groups' training rows.

    Minimises half the squared coefficients plus ``inverse_penalty`` times the summed log loss, the intercept free of penalty,
    by Newton's steps: one aggregation a step gives all open groups' losses, slopes and second derivatives, and a step that
    would raise the loss is halved. Groups that have ended leave the join. The driver holds (features + 1)^2 numbers a group.
    """
    features, by, spark = features_within(features), list(by), rows.sparkSession
    k = len(features) + 1
    base = complete(trained(rows), [*features, target]).select(*by, *features, target)
    kinds = dict(base.dtypes)
    groups = [tuple(r) for r in base.select(*by).distinct().collect()]
    state = {g: {"at": np.zeros(k), "from": np.zeros(k), "loss": math.inf, "size": 1.0, "steps": 0, "done": False} for g in groups}
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    schema = ", ".join([*[f"`_k{c}` {kinds[c]}" for c in by], "_w array<double>"])
    for _ in range(steps):
        table = [(*g, s["at"].tolist()) for g, s in state.items() if not s["done"]]
        if not table:
            break
        # one row for each open group
        joined = base.join(F.broadcast(spark.createDataFrame(table, schema)), same(by, "_k"))
        z = sum((F.col("_w")[i] * x[i] for i in range(1, k)), F.col("_w")[0])
        joined = joined.withColumn("_z", z).withColumn("_p", sigmoid(F.col("_z")))
        # log(1 + exp(z)) - y z without overflow
        loss = F.sum(F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col(target) * F.col("_z"))
        slopes = [F.sum((F.col("_p") - F.col(target)) * x[i]) for i in range(k)]
        bends = [F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i in range(k) for j in range(i + 1)]
        for r in joined.groupBy(*[f"_k{c}" for c in by]).agg(loss.alias("loss"), F.array(*slopes).alias("slopes"), F.array(*bends).alias("bends")).collect():
            newton(state[tuple(r[f"_k{c}"] for c in by)], r, inverse_penalty, close)
    fits = [(*g, s["at"][1:].tolist(), float(s["at"][0]), s["steps"]) for g, s in state.items()]
    return spark.createDataFrame(fits, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "coefficients array<double>, intercept double, steps int"]))


def newton(s: dict, sums, inverse_penalty: float, close: float) -> None:
    """One step of a group: on from the point where the sums were taken, or half the way back to the one before."""
    at, k = s["at"], len(s["at"])
    loss = inverse_penalty * sums["loss"] + 0.5 * float(at[1:] @ at[1:])
    s["steps"] += 1
    if loss > s["loss"] + 1e-12 * abs(s["loss"]) and np.abs(at - s["from"]).max() > close:
        s["at"] = (at + s["from"]) / 2
        return
    bend = np.zeros((k, k))
    bend[np.tril_indices(k)] = sums["bends"]
    bend = inverse_penalty * (bend + np.tril(bend, -1).T) + np.diag([0.0] + [1.0] * (k - 1))
    slope = inverse_penalty * np.array(sums["slopes"]) + np.concatenate([[0.0], at[1:]])
    move = np.linalg.lstsq(bend, -slope, rcond=None)[0]
    s.update({"from": at, "loss": loss, "at": at + move})
    s["done"] = bool(np.abs(move).max() <= close * max(1.0, np.abs(at).max()))


def logistic(rows: DataFrame, features: Sequence[str], target: str, inverse_penalty: float = 1.0, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """The test rows with label and probabilities of their group's logistic regression."""
    fits = logistic_fits(rows, features, target, inverse_penalty, by).drop("steps")
    # one row for each group
    made = rows.filter("role = 'test'").join(F.broadcast(fits), list(by)).withColumn("_d", binary_decision(decision(features)))
    return made.withColumns({"label": F.col("_d.label"), "probabilities": F.col("_d.probabilities")}).drop("_d", "coefficients", "intercept")


def mean_and_line(rows: DataFrame, feature: str, target: str, by: Sequence[str] = ("resample_id",)) -> DataFrame:
    """The test rows twice, with method ``mean`` and ``line`` and the value of each; both come from one aggregation."""
    sums = trained(rows).groupBy(*by).agg(F.avg(feature).alias("_x"), F.avg(target).alias("_y"), F.covar_pop(feature, target).alias("_c"), F.var_pop(feature).alias("_v"))
    slope = F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(0.0)
    both = F.array(F.struct(F.lit("mean").alias("method"), F.col("_y").alias("value")), F.struct(F.lit("line").alias("method"), (F.col("_y") + slope * (F.col(feature) - F.col("_x"))).alias("value")))
    tested = rows.filter("role = 'test'").join(sums, list(by)).withColumn("_m", F.explode(both))
    return tested.withColumns({"method": F.col("_m.method"), "value": F.col("_m.value")}).drop("_m", "_x", "_y", "_c", "_v")


def _common(task: Task) -> dict:
    return {"featuresCol": "features", "labelCol": task.target} | ({"weightCol": task.weight} if task.weight else {})


def logistic_regression(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    if task.task_type == "regression":
        raise ValueError("logistic_regression needs classes")
    n = train.count()
    return LogisticRegression(**_common(task), regParam=1.0 / (params.get("C", 1.0) * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=params.get("max_iter", 100))


def ridge(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    """Spark scales the penalty by the label's deviation; so the parameter is turned into that scale."""
    row = train.agg(F.count("*").alias("n"), F.stddev_pop(task.target).alias("s")).first()
    return LinearRegression(**_common(task), solver="normal", elasticNetParam=0.0, standardization=False, regParam=params.get("alpha", 1.0) / max(1, row["n"]) * (row["s"] or 0.0))


def linear_regression(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    if task.task_type != "regression":
        raise ValueError("linear_regression needs values")
    return LinearRegression(**_common(task), solver="normal", regParam=0.0)


def random_forest(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    made = RandomForestRegressor if task.task_type == "regression" else RandomForestClassifier
    return made(**_common(task), numTrees=params.get("n_estimators", 20), maxDepth=params.get("max_depth", 5), seed=params.get("seed", 0))


def gradient_boosting(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    options = {"maxIter": params.get("n_estimators", 10), "maxDepth": params.get("max_depth", 3), "seed": params.get("seed", 0), "maxBins": params.get("max_bins", 32)}
    if task.task_type == "regression":
        return GBTRegressor(**_common(task), **options)
    if task.task_type == "binary":
        return GBTClassifier(**_common(task), **options)
    if task.weight:
        raise ValueError("boosting of several classes takes no weights")
    plain = {k: v for k, v in _common(task).items() if k != "weightCol"}
    return OneVsRest(classifier=GBTClassifier(**options), **plain)


def hist_boosting(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    return gradient_boosting(train, task, {"max_bins": 255, **params})


def mlp_classifier(train: DataFrame, task: Task, params: Mapping) -> Estimator:
    """A dense network with sigmoid layers; it has no regression form."""
    if task.task_type == "regression":
        raise ValueError("simple_mlp needs classes")
    if task.weight:
        raise ValueError("simple_mlp takes no weights")
    k = train.select(task.target).distinct().count()
    width = len(train.select("features").first()[0])
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=task.target, layers=[width, *params.get("hidden", [8]), max(2, k)], maxIter=params.get("max_iter", 60), seed=params.get("seed", 0))


#: Kind -> builder of (train, task, params); register further ones with register_estimator.
ESTIMATORS: dict[str, Callable[[DataFrame, Task, Mapping], Estimator]] = {
    "linear_regression": linear_regression, "ridge": ridge, "logistic_regression": logistic_regression, "random_forest": random_forest,
    "gradient_boosting": gradient_boosting, "boosted_trees": hist_boosting, "simple_mlp": mlp_classifier}


def register_estimator(kind: str, builder: Callable[[DataFrame, Task, Mapping], Estimator]) -> None:
    if kind in ESTIMATORS:
        raise ValueError(f"estimator {kind} exists already")
    ESTIMATORS[kind] = builder


def with_features(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(frame)


def fit(train: DataFrame, task: Task, kind: str, params: Mapping | None = None) -> Model:
    """A model of the train rows, which have a column features."""
    if kind not in ESTIMATORS:
        raise KeyError(f"unknown estimator {kind}; known: {sorted(ESTIMATORS)}")
    if train.filter(F.col(task.target).isNull()).limit(1).count():
        raise ValueError("the target is missing in training rows")
    return ESTIMATORS[kind](train, task, params or {}).fit(train)


def predict(model: Model, frame: DataFrame, task: Task, key: str) -> DataFrame:
    """Predictions by key: label and probabilities (or score), or value."""
    out = model.transform(frame)
    columns = [F.col(key).alias("sample_id")] + ([F.col(task.target).alias("y_true")] if task.target in frame.columns else [])
    if task.task_type == "regression":
        return out.select(*columns, F.col("prediction").alias("value"))
    columns.append(F.col("prediction").cast("int").alias("label"))
    if "probability" in out.columns:
        return out.select(*columns, vector_to_array("probability").alias("probabilities"))
    if "rawPrediction" in out.columns and task.task_type == "binary":
        return out.select(*columns, vector_to_array("rawPrediction")[1].alias("score"))
    return out.select(*columns)


def instance_pooling(train: DataFrame, test: DataFrame, task: Task, bag: str, how: str = "max", params: Mapping | None = None) -> DataFrame:
    """Instances get their bag's label; a logistic regression's probabilities are pooled for each test bag."""
    model = fit(train, task, "logistic_regression", params)
    scored = model.transform(test).select(bag, vector_to_array("probability").alias("_p"))
    k = model.numClasses
    return bg.pooled_probabilities(scored.select(bag, *[F.col("_p")[i].alias(f"p{i}") for i in range(k)]), bag, [f"p{i}" for i in range(k)], how)


def mi_svm_bags(train: DataFrame, test: DataFrame, task: Task, bag: str, key: str, params: Mapping) -> DataFrame:
    """The test bags with label and score of a multi-instance SVM, whose kernel is "rbf" unless given."""
    model, _, _ = mi_svm(train, bag, key, ["features"], task.target, int(params.get("max_iterations", 50)), {"kernel": "rbf", **{k: v for k, v in params.items() if k != "max_iterations"}})
    return model.bags(test, bag)


def pooled_bags(train: DataFrame, test: DataFrame, task: Task, bag: str, key: str, params: Mapping) -> DataFrame:
    """The test bags with label and probabilities, pooled from a logistic regression of instances."""
    return instance_pooling(train, test, task, bag, str(params.get("pool", "max")), {k: v for k, v in params.items() if k != "pool"})


#: Kind -> predictions of bags by (train, test, task, bag, key of instances, params), where rows are instances with their bag's target.
BAG_METHODS: dict[str, Callable[[DataFrame, DataFrame, Task, str, str, Mapping], DataFrame]] = {"mi_svm": mi_svm_bags, "instance_pooling": pooled_bags}


def of_bags(train: DataFrame, test: DataFrame, task: Task, kind: str, bag: str, key: str, params: Mapping | None = None) -> DataFrame:
    """Predictions of test bags: sample_id, y_true, label and score or probabilities. Instances of a bag that differ in target are an error."""
    found = BAG_METHODS[kind](train, test, task, bag, key, params or {})
    one = F.when(F.min(task.target) == F.max(task.target), F.min(task.target)).otherwise(F.raise_error(F.lit("a bag has several targets")).cast(dict(test.dtypes)[task.target]))
    truth = test.groupBy(bag).agg(one.alias("y_true"))
    return truth.join(found, bag).withColumnRenamed(bag, "sample_id")


def run_record(run_key: str, work: Callable[[], Mapping[str, float]], keep_going: bool = True) -> dict:
    """What a run gave: its metrics and time, or the error that ended it."""
    began = time.time()
    try:
        metrics = dict(work())
        return {"run_key": run_key, "status": "success", "metrics": metrics, "fit_time": time.time() - began, "error_type": None, "error": None}
    except Exception as error:  # noqa: BLE001  any failure of a run is its result
        if not keep_going:
            raise
        return {"run_key": run_key, "status": "failed", "metrics": {}, "fit_time": time.time() - began, "error_type": type(error).__name__, "error": str(error)[:500]}
