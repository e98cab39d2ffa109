"""Tables with typed column roles: kind and tags live in the metadata of the frame's fields."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds and the usual tags of columns.
KINDS = ("id", "group", "timestamp", "numeric", "categorical", "binary", "ordinal", "text", "embedding", "weight", "mask", "unknown")
TAGS = ("missing_values", "skewed", "zero_inflated", "high_cardinality", "bounded")


@dataclass
class Task:
    """What is predicted from which columns."""

    task_type: str
    source: Sequence[str]
    target: str
    weight: str | None = None
    groups: Sequence[str] = field(default_factory=tuple)
    metrics: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.task_type not in ("binary", "multiclass", "regression"):
            raise ValueError(f"unknown task type {self.task_type}")
        if self.target in self.source:
            raise ValueError("the target is among the source columns")

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.source, self.target, *self.groups, *([self.weight] if self.weight else [])]))

    def checked(self, frame: DataFrame) -> DataFrame:
        missing = [c for c in self.columns() if c not in frame.columns]
        if missing:
            raise ValueError(f"the table lacks the columns {missing}")
        return frame

    def sources(self, frame: DataFrame) -> DataFrame:
        return self.checked(frame).select(*self.source)

    def targets(self, frame: DataFrame) -> DataFrame:
        return self.checked(frame).select(self.target)


def kind_of(data_type: T.DataType) -> str:
    """The kind that a column's type suggests."""
    if isinstance(data_type, T.BooleanType):
        return "binary"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "categorical"


def with_roles(frame: DataFrame, roles: Mapping[str, str] | None = None, tags: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """The frame with a kind and tags for every column: given ones, else by type."""
    roles, tags = roles or {}, tags or {}
    for name in {*roles, *tags} - set(frame.columns):
        raise ValueError(f"no column {name}")
    for kind in roles.values():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
    for f in frame.schema.fields:
        frame = frame.withMetadata(f.name, {**f.metadata, "kind": roles.get(f.name, kind_of(f.dataType)), "tags": sorted(set(tags.get(f.name, ())))})
    return frame


def columns_of(frame: DataFrame, kinds: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), match_all: bool = True) -> list[str]:
    """Names of columns of these kinds that have the tags to include, all or any, and none of those to exclude."""
    out = []
    for f in frame.schema.fields:
        tags = set(f.metadata.get("tags", []))
        wanted = (tags.issuperset(include) if match_all else bool(tags.intersection(include))) if include else True
        if (not kinds or f.metadata.get("kind") in kinds) and wanted and not tags.intersection(exclude):
            out.append(f.name)
    return out


def is_missing(name: str, data_type: str) -> Column:
    missing = F.col(name).isNull()
    return missing | F.isnan(name) if data_type in ("double", "float") else missing


def profile(frame: DataFrame) -> DataFrame:
    """column, kind, n_null and n_distinct of every column, from one pass."""
    wide = frame.agg(*[F.struct(F.count_if(is_missing(c, k)).alias("n_null"), F.count_distinct(c).alias("n_distinct")).alias(c) for c, k in frame.dtypes])
    kinds = F.create_map(*[F.lit(x) for f in frame.schema.fields for x in (f.name, f.metadata.get("kind") or kind_of(f.dataType))])
    return wide.unpivot([], frame.columns, "column", "s").select("column", kinds[F.col("column")].alias("kind"), "s.n_null", "s.n_distinct")


def with_missing_tags(frame: DataFrame) -> DataFrame:
    """Tag the columns that hold nulls."""
    audit = frame.agg(*[F.count_if(is_missing(c, k)).alias(c) for c, k in frame.dtypes]).first()
    for f in frame.schema.fields:
        if audit[f.name]:
            frame = frame.withMetadata(f.name, {**f.metadata, "tags": sorted({*f.metadata.get("tags", []), "missing_values"})})
    return frame


def refuse_missing(frame: DataFrame) -> DataFrame:
    """The frame, whose rows raise an error where a value is missing."""
    ok = ~F.greatest(F.lit(False), *[is_missing(c, k) for c, k in frame.dtypes])
    return frame.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a value is missing")).cast("boolean")))


def repeated_ids(frame: DataFrame, row_id: str) -> DataFrame:
    """Ids that are null or come more than once, with their number."""
    return frame.groupBy(row_id).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(row_id).isNull())


def dataset_violations(frame: DataFrame, schema: Mapping[str, str], row_id: str | None = None) -> DataFrame:
    """What is wrong with a table under a declared schema (name -> kind), as violation, name and n; no rows: nothing.

    Columns named twice (as Spark compares names, without case), columns that the schema lacks or has too many, a row id that
    isn't there, isn't of the kind id, or has null or repeated values (n: the rows that have such values).
    """
    counts: dict[str, int] = {}
    for c in frame.columns:
        counts[c.lower()] = counts.get(c.lower(), 0) + 1
    found = [("duplicate_column", c, n) for c, n in counts.items() if n > 1]
    found += [("missing_from_schema", c, 1) for c in dict.fromkeys(frame.columns) if c not in schema]
    found += [("extra_in_schema", c, 1) for c in schema if c not in frame.columns]
    if row_id is not None:
        if row_id not in frame.columns:
            found.append(("row_id_absent", row_id, 1))
        elif schema.get(row_id) != "id":
            found.append(("row_id_kind", row_id, 1))
    out = frame.sparkSession.createDataFrame(found, "violation string, name string, n long")
    if row_id in frame.columns and counts[row_id.lower()] == 1:
        repeated = repeated_ids(frame.select(row_id), row_id).agg(F.sum("n").alias("n")).filter("n > 0")
        out = out.unionByName(repeated.select(F.lit("row_id_repeated").alias("violation"), F.lit(row_id).alias("name"), "n"))
    return out


def checked_dataset(frame: DataFrame, schema: Mapping[str, str], row_id: str | None = None) -> DataFrame:
    """The frame with its roles, or an error that names all violations."""
    bad = dataset_violations(frame, schema, row_id).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['violation']}: {r['name']} ({r['n']})" for r in bad))
    return with_roles(frame, dict(schema))


def bag_violations(bags: DataFrame, instances: DataFrame, bag_id: str, instance_bag: str) -> DataFrame:
    """Instances without bag and bags without instances: violation, bag and number of instances."""
    known = instances.groupBy(F.col(instance_bag).alias("bag")).agg(F.count("*").alias("n"))
    ids = bags.select(F.col(bag_id).alias("bag"))
    return known.join(ids, "bag", "left_anti").select(F.lit("orphan").alias("violation"), "bag", "n").unionByName(
        ids.join(known, "bag", "left_anti").select(F.lit("empty").alias("violation"), "bag", F.lit(0).cast("long").alias("n")))


def task_type(frame: DataFrame, target: str, classification: bool) -> DataFrame:
    """Type of the task and kind of the target, from the number of the target's values."""
    n = F.count_distinct(target)
    if not classification:
        return frame.agg(F.lit("regression").alias("task_type"), F.lit("numeric").alias("target_kind"), n.alias("n_distinct"))
    return frame.agg(F.when(n == 2, "binary").otherwise("multiclass").alias("task_type"), F.when(n == 2, "binary").otherwise("categorical").alias("target_kind"), n.alias("n_distinct"))
