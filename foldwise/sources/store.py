"""Reading and writing of summaries, predictions, evidence and file manifests."""

from __future__ import annotations

import json as json_module
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.columns import safe_name
from foldwise.operators.reports import markdown_lines
from foldwise.operators.resample import ranked
from foldwise.sources.tables import Task, kind_of

#: Columns that predictions are stored by.
PARTITIONS = ("case_name", "method", "resample_id", "seed")


def save_summary(table: DataFrame, csv: str | None = None, json: str | None = None, markdown: str | None = None) -> None:
    """A report as CSV, as JSON records with nulls, and as Markdown lines."""
    if csv:
        table.write.option("header", True).option("emptyValue", "").csv(csv)
    if json:
        table.write.option("ignoreNullFields", False).json(json)
    if markdown:
        names = " | ".join(table.columns)
        head = table.sparkSession.range(1).select(F.explode(F.array(F.lit(f"| {names} |"), F.lit("|" + " --- |" * len(table.columns)))).alias("line"))
        head.unionByName(markdown_lines(table)).write.text(markdown)


def load_summary(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A saved report; from CSV all columns are text, and empty cells stay empty text."""
    if kind == "json":
        return spark.read.json(path)
    frame = spark.read.option("header", True).option("nullValue", "\x00").csv(path)
    return frame.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in frame.columns])


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions in folders by run; columns that hold nothing are left out by the caller."""
    predictions.write.mode("errorifexists").partitionBy(*[c for c in PARTITIONS if c in predictions.columns]).parquet(path)


def load_predictions(spark: SparkSession, path: str, **run: str) -> DataFrame:
    """Stored predictions, of one run where its keys are given: only its folders are read."""
    frame = spark.read.parquet(path)
    for key, value in run.items():
        frame = frame.filter(F.col(key) == value)
    return frame


def run_evidence(runs: DataFrame) -> DataFrame:
    """One JSON record for each run and the path that it is kept under."""
    keys = [c for c in PARTITIONS if c in runs.columns]
    return runs.select(F.concat_ws("/", *[F.concat(F.lit("seed_"), F.col(c).cast("string")) if c == "seed" else safe_name(F.col(c).cast("string")) for c in keys]).alias("path"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(runs.columns)]), {"ignoreNullFields": "false"}).alias("record"))


def save_evidence(records: DataFrame, path: str) -> None:
    """Records as text; a destination that exists is refused."""
    records.select("record").write.mode("errorifexists").text(path)


def case_evidence(assignment: DataFrame, key: str, size: int = 100_000) -> DataFrame:
    """A digest of the exact keys of every split: that of the digests of runs of ``size`` keys in order, as JSON.

    No task gathers more keys than a run has, or more than one digest for each run of a split.
    """
    place = F.floor(F.col("position") / size).alias("part")
    runs = ranked(assignment, key, None, ["resample_id", "role"]).groupBy("resample_id", "role", place).agg(
        F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(key))), 256).alias("digest"))
    digests = F.array_sort(F.collect_list(F.struct("part", "digest")))
    return runs.groupBy("resample_id", "role").agg(
        F.sum("n").alias("n"), F.sha2(F.concat_ws(",", F.transform(digests, lambda p: p["digest"])), 256).alias("keys_sha256"))


def case_record(case: str, frame: DataFrame, task: Task, assignment: DataFrame, key: str, source: Mapping[str, str] | None = None, size: int = 100_000) -> DataFrame:
    """case_name and record: one line of JSON with the table's rows, columns and schema, the task, and every split's role with its
    number of rows and the digest of its keys."""
    schema = [{"name": f.name, "type": f.dataType.simpleString(), "kind": f.metadata.get("kind") or kind_of(f.dataType), "tags": sorted(f.metadata.get("tags", []))} for f in frame.schema.fields]
    fixed = {"case": case, "source": dict(source or {}), "columns": frame.columns, "schema": schema, "task": {k: list(v) if isinstance(v, (list, tuple)) else v for k, v in vars(task).items()}, "row_id": key}
    splits = case_evidence(assignment, key, size).agg(F.array_sort(F.collect_list(F.struct("resample_id", "role", "n", "keys_sha256"))).alias("splits"))
    counted = frame.agg(F.count("*").alias("rows")).crossJoin(splits)  # one row each
    return counted.select(F.lit(case).alias("case_name"), F.to_json(F.struct(F.lit(json_module.dumps(fixed, sort_keys=True)).alias("fixed"), "rows", "splits")).alias("record"))


def save_case(record: DataFrame, path: str) -> None:
    """The record at a path; one that is there already stays if it is the same, and another one is refused."""
    spark = record.sparkSession
    system, there = file_system(spark, path)
    new = record.first()["record"]
    if system.exists(there):
        if spark.read.text(path).first()[0] != new:
            raise ValueError(f"{path} holds another record of the case")
        return
    staged(spark, path, lambda place: spark.createDataFrame([(new,)], "value string").coalesce(1).write.text(place))


def conflicts(evidence: DataFrame, name: str, record: Column) -> DataFrame:
    """Names under which different records were given."""
    return evidence.groupBy(name).agg(F.count_distinct(F.sha2(record, 256)).alias("n")).filter("n > 1").select(name)


def flattened(frame: DataFrame, key: str, column: str, depth: int = 3) -> DataFrame:
    """Dotted names and values of a JSON column's nested objects, down to a depth."""
    level = frame.select(key, F.lit("").alias("_prefix"), F.col(column).alias("_json"))
    done = None
    for i in range(depth):
        pairs = level.select(key, "_prefix", F.explode(F.from_json("_json", "map<string,string>")).alias("_k", "value"))
        named = pairs.select(key, F.concat(F.col("_prefix"), F.col("_k")).alias("name"), "value")
        nested = F.coalesce(F.col("value").startswith("{"), F.lit(False)) if i < depth - 1 else F.lit(False)
        leaves = named.filter(~nested)
        done = leaves if done is None else done.unionByName(leaves)
        level = named.filter(nested).select(key, F.concat(F.col("name"), F.lit(".")).alias("_prefix"), F.col("value").alias("_json"))
    return done


def metric_history(wide: DataFrame, run: str, split: str, step: str, metrics: Sequence[str]) -> DataFrame:
    """One row for each run, split, step and metric."""
    return wide.unpivot([run, split, step], list(metrics), "metric", "value").withColumn("metric", F.concat_ws("/", split, "metric"))


def append_history(history: DataFrame, path: str) -> None:
    history.write.mode("append").parquet(path)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again, for what is read several times."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a Spark that runs in
    one process takes a folder of its own, and any other refuses."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foldwise-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it names it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(there)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path below the root, length and SHA-256 of the files under a path."""
    root = file_system(spark, path)[1].toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").substr(F.lit(len(root) + 2), F.length("path")).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Each wanted file with what is wrong with it: missing, length, sha256 or nothing (null)."""
    found = manifest(spark, path).select("file", F.col("length").alias("_length"), F.col("sha256").alias("_sha"))
    problem = F.when(F.col("_length").isNull(), "missing").when(F.col("_length") != F.col("length"), "length").when(F.col("_sha") != F.col("sha256"), "sha256")
    return wanted.join(found, "file", "left").select("file", "length", "sha256", problem.alias("problem"))


def staged(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside the destination and rename it when all is there; a destination that exists is
    refused, and a failure leaves nothing behind."""
    system, there = file_system(spark, path)
    if system.exists(there):
        raise FileExistsError(f"{path} exists already")
    beside = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    system, stage = file_system(spark, beside)
    try:
        write(beside)
        if not system.rename(stage, there):
            raise OSError(f"{beside} couldn't be renamed to {path}")
    except BaseException:
        system.delete(stage, True)
        raise
