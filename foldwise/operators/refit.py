"""The chosen method, with its preprocessing, fitted on all rows, saved with a manifest, and loaded again after a check of its files.

Layout of a refit: ``artifacts/policy`` (tables of the fitted policy), ``artifacts/model`` (assembler and estimator), ``lineage`` (one
line of JSON) and ``manifest`` (path, length and SHA-256 of all artifacts). All is written to a folder beside the destination
and renamed when it is complete.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.estimators import ESTIMATORS, predict, with_features
from foldwise.operators.preprocess import DEFAULT_POLICIES, Feature, Fitted, policy_named
from foldwise.sources.store import manifest, staged, verified
from foldwise.sources.tables import Task


@dataclass
class Refitted:
    """A fitted method: its policy, if it has one, and its model."""

    policy: Fitted | None
    model: PipelineModel
    lineage: dict

    def prepared(self, frame: DataFrame) -> DataFrame:
        return self.policy.transform(frame) if self.policy else frame

    def transform(self, frame: DataFrame) -> DataFrame:
        return self.model.transform(self.prepared(frame))


def refit(frame: DataFrame, task: Task, kind: str, path: str, params: Mapping | None = None, features: Sequence[Feature] = (),
          policy: str | None = None, options: Mapping | None = None) -> None:
    """Fit on all rows. With ``features`` (kinds and tags of the source columns) raw columns go through a policy, by default that of the
    kind; without, the source columns are numbers as they are. A row without target is an error, and so is a destination
    that exists."""
    spark = frame.sparkSession
    rows = task.checked(frame)
    without = rows.filter(F.col(task.target).isNull()).limit(1).count()
    if without:
        raise ValueError("a refit needs a target in every row")
    if features and {f.name for f in features} != set(task.source):
        raise ValueError("features must name the task's source columns")
    name = policy or (DEFAULT_POLICIES.get(kind, "linear_default") if features else None)

    def write(place: str) -> None:
        fitted = None
        inputs, made = list(task.source), rows
        if name:
            fitted = policy_named(name)(rows, features, options, path=f"{place}/artifacts/policy")
            if not isinstance(fitted, Fitted):
                raise ValueError(f"policy {name} can't be stored")
            inputs, made = fitted.outputs(), fitted.transform(rows)
        estimator = ESTIMATORS[kind](with_features(made, inputs), task, params or {})
        Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), estimator]).fit(made).write().save(f"{place}/artifacts/model")
        lineage = {"kind": kind, "params": dict(params or {}), "source": list(task.source), "target": task.target, "task_type": task.task_type,
                   "weight": task.weight, "policy": name, "options": dict(options or {}), "features": [asdict(f) | {"tags": sorted(f.tags)} for f in features],
                   "inputs": inputs, "input_types": {c: dict(rows.dtypes)[c] for c in task.source}, "training_size": rows.count(), "spark": spark.version}
        spark.createDataFrame([(json.dumps(lineage, sort_keys=True),)], "value string").coalesce(1).write.text(f"{place}/lineage")
        manifest(spark, f"{place}/artifacts").filter("not file rlike '(^|/)[.]' and length > 0").coalesce(1).write.json(f"{place}/manifest")

    staged(spark, path, write)


def load_refit(spark: SparkSession, path: str) -> tuple[Refitted, Task]:
    """The method and its task; files that are missing or changed are an error."""
    wanted = spark.read.schema("file string, length long, sha256 string").json(f"{path}/manifest")
    bad = [r["file"] for r in verified(spark, f"{path}/artifacts", wanted).filter("problem is not null").limit(5).collect()]
    if bad:
        raise ValueError(f"files don't match the manifest: {bad}")
    lineage = json.loads(spark.read.text(f"{path}/lineage").first()[0])
    fitted = Fitted(spark, f"{path}/artifacts/policy") if lineage["policy"] else None
    task = Task(lineage["task_type"], lineage["source"], lineage["target"], lineage["weight"])
    return Refitted(fitted, PipelineModel.load(f"{path}/artifacts/model"), lineage), task


def predict_refit(model: Refitted, task: Task, frame: DataFrame, key: str) -> DataFrame:
    """Predictions for new rows; missing columns or no rows are an error."""
    missing = [c for c in task.source if c not in frame.columns]
    if missing or frame.isEmpty():
        raise ValueError(f"columns {missing} are missing" if missing else "there are no rows")
    return predict(model, frame, task, key)
