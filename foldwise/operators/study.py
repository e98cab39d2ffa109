"""Studies: every method, with its preprocessing, on every resample and seed; predictions are kept as a table and metrics computed from it.

Layout of a study's path: ``predictions`` in the folders that save_predictions makes (case, method, resample, seed), ``records``
with a line for each run that has ended, and ``rows`` with the prepared rows of each policy in folders by resample. A study that
was cut off goes on where it ended: runs with a record of success are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import estimators as es
from foldwise.operators import metrics as mt
from foldwise.operators.preprocess import DEFAULT_POLICIES, Feature, dense, policy_named
from foldwise.sources.store import PARTITIONS, file_system
from foldwise.sources.tables import Task

RECORD = ("run_key string, case_name string, method string, resample_id string, seed long, status string, fit_time double, error_type string, error string, "
          "policy string, metadata map<string,string>")
#: Kinds that are one job over all resamples and seeds.
AT_ONCE = ("dummy_classifier", "dummy_regressor", "linear_at_once", "ridge_at_once", "logistic_at_once")


@dataclass
class Method:
    """A kind of estimator with parameters, and the policy that its features go through (none: its kind's own, where features are given)."""

    kind: str
    params: Mapping[str, object] = field(default_factory=dict)
    policy: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)
    metadata: Mapping[str, str] = field(default_factory=dict)

    def prepared_by(self, raw: bool) -> tuple[str, str]:
        """Name and options (as JSON) of the policy; empty for rows that have features already."""
        if not raw:
            return "", "{}"
        return self.policy or DEFAULT_POLICIES.get(self.kind, "linear_default"), json.dumps(dict(self.options), sort_keys=True)


def prepared(
    rows: DataFrame, task: Task, assignment: DataFrame, key: str, features: Sequence[Feature], policy: tuple[str, str], path: str, instance: str | None = None,
) -> DataFrame:
    """Each resample's rows with role and features, fitted on its own train and valid rows; written once, in a folder for each resample."""
    spark = rows.sparkSession
    system, there = file_system(spark, f"{path}/_SUCCESS")
    if not system.exists(there):
        dealt = assignment.select("resample_id", key, "role").join(rows, key)
        if policy[0]:
            fitted = policy_named(policy[0])(dealt.filter("role <> 'test'"), features, json.loads(policy[1]), by=["resample_id"])
            dealt = fitted.transform(dealt).withColumn("features", array_to_vector(dense(fitted.vector())))
        kept = list(dict.fromkeys(["resample_id", key, *([instance] if instance else []), "role", task.target, *([task.weight] if task.weight else []), "features"]))
        dealt.select(*kept).write.mode("overwrite").partitionBy("resample_id").parquet(path)
    # names of resamples are text, whatever they look like
    read = spark.read.parquet(path)
    return read.withColumn("resample_id", F.col("resample_id").cast("string"))


def folder(*values: object) -> str:
    """The folder of a run, as Spark names folders by values."""
    escaped = [re.sub(r"[\x00-\x1f\"#%'*/:=?\\{\[\]^\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v)) for v in values]
    return "/".join(f"{c}={v}" for c, v in zip(PARTITIONS, escaped, strict=True))


def done_before(spark, path: str) -> list:
    """The records of runs that have succeeded, the last of each."""
    system, there = file_system(spark, f"{path}/records")
    if not system.exists(there):
        return []
    kept = {r["run_key"]: r for r in spark.read.schema(RECORD).option("recursiveFileLookup", True).json(f"{path}/records").filter("status = 'success'").collect()}
    return [tuple(r) for r in kept.values()]


def at_once(rows: DataFrame, task: Task, method: Method) -> DataFrame:
    """Test rows of all resamples with a method's predictions, from one job over all of them."""
    if method.kind == "dummy_classifier":
        return es.dummy_classifier(rows, task.target)
    if method.kind == "dummy_regressor":
        return es.dummy_regressor(rows, task.target, **method.params)
    spread = rows.withColumn("_x", vector_to_array("features"))
    width = spread.agg(F.max(F.size("_x"))).first()[0]
    names = es.features_within([f"_x{i}" for i in range(width)])
    # resamples with fewer categories have fewer features; what they lack is 0
    spread = spread.withColumns({c: F.coalesce(F.get("_x", F.lit(i)), F.lit(0.0)) for i, c in enumerate(names)})
    if method.kind == "logistic_at_once":
        return es.logistic(spread, names, task.target, float(method.params.get("C", 1.0)))
    return es.linear(spread, names, task.target, float(method.params.get("alpha", 1.0)) if method.kind == "ridge_at_once" else 0.0)


def run_study(
    case: str, rows: DataFrame, task: Task, assignment: DataFrame, key: str, methods: Mapping[str, Method | tuple[str, Mapping[str, object]]], metrics: Sequence[str], path: str,
    seeds: Sequence[int] = (0,), parallelism: int = 4, keep_going: bool = True, features: Sequence[Feature] = (), instance: str | None = None,
) -> DataFrame:
    """One row for each run with its status, time, error, policy, metadata and metrics (a map).

    ``rows`` have the column features, or, with ``features`` (kinds and tags of the source columns), raw columns that go
    through each method's policy: fitted for all resamples at once, and prepared rows are written once for all methods that share it.
    ``assignment`` has resample_id, key and role. Methods of the kinds AT_ONCE are one job each; other fits are Spark jobs of
    their own, several at a time. Where rows are instances of bags, ``key`` and ``assignment`` are of bags, ``instance`` is the instances'
    own key, and kinds of BAG_METHODS give a prediction for each bag. When all have ended, one aggregation over the stored predictions gives the metrics of all
    runs. A run that fails is a row with its error, or ends the study unless ``keep_going``. The driver holds one record a run.
    """
    spark = rows.sparkSession
    methods = {n: m if isinstance(m, Method) else Method(*m) for n, m in methods.items()}
    resamples = [r[0] for r in assignment.select("resample_id").distinct().orderBy("resample_id").collect()]
    before = done_before(spark, path)
    known = {r[0] for r in before}
    name_of = lambda m, r, s: f"{case}:{m}:{r}:seed-{s}"
    plan = [(m, r, s) for m in methods for r in resamples for s in seeds if name_of(m, r, s) not in known]
    tables: dict[tuple[str, str], DataFrame | Exception] = {}
    for policy in dict.fromkeys(methods[m].prepared_by(bool(features)) for m, _, _ in plan):
        place = f"{path}/rows/{policy[0] or 'as-they-are'}-{zlib.crc32(policy[1].encode())}"
        try:
            tables[policy] = prepared(rows, task, assignment, key, features, policy, place, instance)
        except Exception as error:  # noqa: BLE001  the runs that need it fail with it
            if not keep_going:
                raise
            tables[policy] = error

    def rows_of(method: Method) -> DataFrame:
        found = tables[method.prepared_by(bool(features))]
        if isinstance(found, Exception):
            raise found
        return found

    def save(found: DataFrame, method: str, seed: int, resample: str | None = None) -> None:
        """Into the folder of the run, or, for all resamples, into each one's; what an attempt before has left is replaced."""
        key_of = F.concat(F.lit(f"{case}:{method}:"), F.lit(resample) if resample is not None else F.col("resample_id"), F.lit(f":seed-{seed}"))
        named = found.withColumns({"sample_id": F.col("sample_id").cast("string"), "run_key": key_of})
        if resample is not None:
            named.write.mode("overwrite").parquet(f"{path}/predictions/{folder(case, method, resample, seed)}")
        else:
            fixed = {"case_name": F.lit(case), "method": F.lit(method), "seed": F.lit(seed)}
            named.withColumns(fixed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{path}/predictions")

    def record(name: str, cell: tuple[str, str, int], found: dict) -> tuple:
        method, resample, seed = cell
        m = methods[method]
        return (name, case, method, resample, seed, found["status"], found["fit_time"], found["error_type"], found["error"], m.prepared_by(bool(features))[0] or None,
                {**{k: str(v) for k, v in m.metadata.items()}, "method": json.dumps({k: v for k, v in asdict(m).items() if k != "metadata"}, sort_keys=True, default=str)})

    def one(cell: tuple[str, str, int]) -> list[tuple]:
        method, resample, seed = cell
        m = methods[method]

        def work() -> dict[str, float]:
            part = rows_of(m).filter(F.col("resample_id") == resample)
            if m.kind in es.BAG_METHODS:
                if instance is None:
                    raise ValueError(f"{m.kind} needs instances of bags")
                seeded = {"seed": seed, **m.params} if m.kind == "mi_svm" else m.params
                save(es.of_bags(part.filter("role <> 'test'"), part.filter("role = 'test'"), task, m.kind, key, instance, seeded), method, seed, resample)
                return {}
            if instance is not None:
                raise ValueError(f"{m.kind} takes rows, not instances of bags")
            model = es.fit(part.filter("role <> 'test'"), task, m.kind, {"seed": seed, **m.params})
            save(es.predict(model, part.filter("role = 'test'"), task, key), method, seed, resample)
            return {}

        return [record(name_of(*cell), cell, es.run_record(name_of(*cell), work, keep_going))]

    def whole(cells: list[tuple[str, str, int]]) -> list[tuple]:
        """All resamples of a method and seed."""
        method, _, seed = cells[0]

        def work() -> dict[str, float]:
            if instance is not None:
                raise ValueError(f"{methods[method].kind} takes rows, not instances of bags")
            mine = [r for _, r, _ in cells]
            found = at_once(rows_of(methods[method]).filter(F.col("resample_id").isin(mine)), task, methods[method])
            kept = [c for c in ("label", "probabilities", "value") if c in found.columns]
            save(found.select("resample_id", F.col(key).alias("sample_id"), F.col(task.target).alias("y_true"), *kept), method, seed)
            return {}

        ended = es.run_record(f"{case}:{method}:seed-{seed}", work, keep_going)
        return [record(name_of(*cell), cell, ended) for cell in cells]

    def finished(runs: list[tuple]) -> list[tuple]:
        # a folder for each run, as runs end at the same time
        method, resample, seed = runs[0][2:5]
        spark.createDataFrame(runs, RECORD).coalesce(1).write.mode("overwrite").json(f"{path}/records/{folder(case, method, resample if len(runs) == 1 else 'all', seed)}")
        return runs

    joint = {}
    for cell in plan:
        if methods[cell[0]].kind in AT_ONCE:
            joint.setdefault((cell[0], cell[2]), []).append(cell)
    done = [r for cells in joint.values() for r in finished(whole(cells))]
    with ThreadPoolExecutor(parallelism) as pool:
        done += [r for runs in pool.map(lambda cell: finished(one(cell)), [c for c in plan if methods[c[0]].kind not in AT_ONCE]) for r in runs]
    records = spark.createDataFrame([*before, *done], RECORD)
    empty = F.create_map().cast("map<string,double>")
    if not any(r[5] == "success" for r in [*before, *done]):
        return records.withColumn("metrics", empty)
    measured = mt.metrics_of(stored_predictions(records, path), ["run_key"], metrics)
    cells = measured.select("run_key", F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metrics"))
    return records.join(cells, "run_key", "left").withColumn("metrics", F.coalesce("metrics", empty))


def stored_predictions(records: DataFrame, path: str) -> DataFrame:
    """The predictions of a study's runs that succeeded."""
    spark = records.sparkSession
    names = records.filter("status = 'success'").select("run_key")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/predictions").join(names, "run_key", "left_semi")
