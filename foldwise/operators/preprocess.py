"""Preprocessing fitted on training rows, kept as tables, and applied to all rows.

A policy routes columns by kind and tags into branches. Fitting gives two tables, for one training frame or for all resamples
at once: ``statistics``, a row for each resample with fills, means, deviations, largest sizes and exponents, and
``categories``, a row for each resample, column and category with its place. Both are written when the policy is fitted, so a
fitted policy can be stored with a model, loaded again and applied without the training rows. What a column becomes is one
expression, and places come by joins, so that categories of any number stay off the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.columns import same
from foldwise.operators.resample import ranked
from foldwise.operators.statistics import number, powers, quantiles, transformed, widened
from foldwise.sources.store import new_path

NUMERIC, CATEGORICAL = ("numeric",), ("categorical", "binary", "ordinal")
#: Categories that a column without the tag high_cardinality may have as 0/1 columns, which are a schema.
MOST_COLUMNS = 1000
#: What missing values become under the option constant.
CONSTANT_NUMBER, CONSTANT_TEXT = 0.0, "missing_value"
#: Options and their defaults.
LINEAR = {"numeric_impute": "median", "categorical_impute": "most_frequent", "skewed_numeric_transform": "yeo-johnson",
          "high_cardinality_max_categories": 20, "high_cardinality_min_frequency": 1}
TREE = {"numeric_impute": "median", "categorical_impute": "most_frequent", "high_cardinality_max_categories": None, "high_cardinality_min_frequency": 1}


@dataclass
class Feature:
    """A column's kind and tags."""

    name: str
    kind: str
    tags: set[str] = field(default_factory=set)

    def has(self, tag: str) -> bool:
        return tag in self.tags


def standardized(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std == 0, 1.0).otherwise(std)


def yeo_johnson(x: Column, power: Column) -> Column:
    return transformed(x, power, "yeo-johnson")[0]


def box_cox(x: Column, power: Column) -> Column:
    return transformed(x, power, "box-cox")[0]


class Gathered:
    """Statistics as they come in: for each group a row of numbers and texts, on the driver."""

    def __init__(self, by: Sequence[str]):
        self.by, self.fields = list(by), []
        self.rows: dict[tuple, dict] = {}

    def add(self, frame: DataFrame) -> None:
        """Further columns of the groups, computed once."""
        known = {f.name for f in self.fields}
        self.fields += [f for f in frame.schema.fields if f.name not in known]
        for r in frame.collect():
            self.rows.setdefault(tuple(r[c] for c in self.by), {}).update(r.asDict())

    def frame(self, spark: SparkSession) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in self.fields]
        return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in self.rows.values()], T.StructType(fields))


def untagged_missing(frame: DataFrame, features: Sequence[Feature]) -> list[str]:
    """Columns that hold nulls without the tag missing_values."""
    if not features:
        return []
    missing = {f.name: (number(f.name) if f.kind in NUMERIC else F.col(f.name)).isNull() for f in features}
    audit = frame.agg(*[F.count_if(m).alias(c) for c, m in missing.items()]).first()
    return [f.name for f in features if audit[f.name] and not f.has("missing_values")]


# categories: by, _column, _category (as text), _number (where the column is a number) and _n

def category_counts(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of each category of each column, nulls included; categories of numbers are in the order of numbers."""
    numbers = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)}
    each = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_category"),
                              (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("_number")) for c in columns])
    return rows.select(*by, F.explode(each).alias("_e")).select(*by, "_e.*").groupBy(*by, "_column", "_category", "_number").agg(F.count("*").alias("_n"))


def most_frequent(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, _column and value: the most frequent category, the smallest on ties."""
    order = F.struct(-F.col("_n"), F.col("_number"), F.col("_category"))
    return counts.filter("_category is not null").groupBy(*by, "_column").agg(F.min_by("_category", order).alias("value"))


def modes(train: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent value of a column, the smallest on ties, for each group."""
    found = most_frequent(category_counts(train, [column], by), by)
    return found.select(*by, F.col("value").cast(train.schema[column].dataType).alias(f"{column}__mode"))


def completed_counts(counts: DataFrame, fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts after nulls have become their column's fill; fills: by, _column, value (null: nulls are left out)."""
    keys = [*by, "_column"]
    renamed = fills.select(*[F.col(c).alias(f"_f{c}") for c in keys], F.col("value").alias("_fill"))
    filled = counts.join(renamed, same(keys, "_f"), "left")
    category = F.coalesce("_category", "_fill")
    return filled.select(*keys, category.alias("_category"), "_number", "_n").filter("_category is not null").groupBy(*keys, "_category").agg(
        F.max("_number").alias("_number"), F.sum("_n").alias("_n"))


def kept_categories(counts: DataFrame, by: Sequence[str], most: int | None, least: int = 1) -> DataFrame:
    """Counts with _kept: whether a category keeps a place of its own: at least ``least`` rows, and at most ``most`` places, one of
    them for the rest if there is any. The most frequent ones stay, the smaller ones on ties."""
    keys = [*by, "_column"]
    if most is None and least <= 1:
        return counts.withColumn("_kept", F.lit(True))
    sizes = counts.groupBy(*keys).agg(F.count_if(F.col("_n") >= least).alias("_frequent"), F.count_if(F.col("_n") < least).alias("_rare"))
    if most is None:
        return counts.withColumn("_kept", F.col("_n") >= least)
    # ranks up to ``most`` only, so that tasks send on no more than that before they meet
    order = W.partitionBy(*keys).orderBy(F.col("_n").desc(), "_number", "_category")
    top = counts.filter(F.col("_n") >= least).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    places = F.when(F.col("_frequent") + (F.col("_rare") > 0).cast("int") <= most, most).otherwise(most - 1)
    sized = top.join(sizes.withColumnsRenamed({c: f"_s{c}" for c in keys}), same(keys, "_s")).filter(F.col("_rank") <= places)
    marks = sized.select(*[F.col(c).alias(f"_m{c}") for c in keys], F.col("_category").alias("_m_category"), F.lit(True).alias("_top"))
    return counts.join(marks, same([*keys, "_category"], "_m"), "left").select(*counts.columns, F.coalesce("_top", F.lit(False)).alias("_kept"))


def placed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept categories with _place, their place in sorted order within group and column; numbered in ranges, not in one task."""
    keys = [*by, "_column"]
    named = ranked(counts.filter("_number is null"), "_category", None, keys)
    counted = ranked(counts.filter("_number is not null"), "_number", None, keys)
    return named.unionByName(counted).select(*keys, "_category", F.col("position").cast("int").alias("_place"))


def category_places(counts: DataFrame, by: Sequence[str], most: int | None, least: int, rest_too: bool) -> tuple[DataFrame, DataFrame]:
    """Places of categories, and for each group and column the number of places (``width``) and that of the rest (``rest``, -1:
    none). ``rest_too``: list the categories that share the place of the rest as well."""
    keys = [*by, "_column"]
    marked = kept_categories(counts, by, most, least)
    widths = marked.groupBy(*keys).agg(F.count_if("_kept").alias("_k"), F.count_if(~F.col("_kept")).alias("_r")).select(
        *keys, (F.col("_k") + (F.col("_r") > 0).cast("int")).cast("int").alias("width"), F.when(F.col("_r") > 0, F.col("_k")).otherwise(-1).cast("int").alias("rest"))
    places = placed(marked.filter("_kept"), by)
    if rest_too and (most is not None or least > 1):
        others = marked.filter(~F.col("_kept")).join(widths.withColumnsRenamed({c: f"_w{c}" for c in keys}), same(keys, "_w"))
        places = places.unionByName(others.select(*keys, "_category", F.col("rest").alias("_place")))
    return places, widths


def frequent_categories(train: DataFrame, column: str, most: int = 20, least: int = 1) -> DataFrame:
    """The categories that keep a place of their own, with their rows, the most frequent first."""
    counts = category_counts(train.filter(F.col(column).isNotNull()), [column])
    kept = kept_categories(counts, [], most, least).filter("_kept")
    return kept.select(F.col("_category").cast(train.schema[column].dataType).alias(column), F.col("_n").alias("n")).orderBy(F.col("n").desc(), column)


def with_places(frame: DataFrame, places: DataFrame, columns: Sequence[str], by: Sequence[str], suffix: str) -> DataFrame:
    """The frame with the place of each column's category as a column, null where it has none; Spark chooses each join by size."""
    for c in columns:
        mine = places.filter(F.col("_column") == c).select(*[F.col(b).alias(f"_p{b}") for b in by], F.col("_category").alias("_p_category"), F.col("_place").alias(f"{c}{suffix}"))
        on = same(by, "_p") & (F.col(c).cast("string") == F.col("_p_category"))
        frame = frame.join(mine, on, "left").drop("_p_category", *[f"_p{b}" for b in by])
    return frame


def ordinal(frame: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """The column as the index of its category among the train rows' sorted ones; unknown and missing ones are -1."""
    places, _ = category_places(category_counts(train.filter(F.col(column).isNotNull()), [column]), [], None, 1, True)
    return with_places(frame, places, [column], [], "__index").withColumn(f"{column}__index", F.coalesce(f"{column}__index", F.lit(-1)))


def one_hot(frame: DataFrame, train: DataFrame, column: str, most: int | None = None, least: int = 1) -> DataFrame:
    """A 0/1 column for each kept category of the train rows; with a place for the rest, unknown ones are there, else all 0."""
    counts = category_counts(train.filter(F.col(column).isNotNull()), [column])
    places, widths = category_places(counts, [], most, least, False)
    names, rest = column_names(places, widths, column)
    return indicators(with_places(frame, places, [column], [], "__place"), column, names, F.lit(rest))


def column_names(places: DataFrame, widths: DataFrame, column: str) -> tuple[list[str], int]:
    """Names of the 0/1 columns, and the place of the rest; more than MOST_COLUMNS are refused."""
    width = widths.filter(F.col("_column") == column).first()
    if width is None:
        return [], -1
    if width["width"] > MOST_COLUMNS:
        raise ValueError(f"{column} has {width['width']} categories: tag it high_cardinality")
    mine = places.filter(F.col("_column") == column).orderBy("_place").select("_category").collect()
    # dots and backticks would have to be escaped wherever the columns are named
    names = [f"{column}_{r[0].replace('.', '_').replace('`', '_')}" for r in mine] + [f"{column}_infrequent"] * (width["rest"] >= 0)
    return [n if names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)], width["rest"]


def indicators(frame: DataFrame, column: str, names: Sequence[str], rest: Column) -> DataFrame:
    at = F.when(F.col(column).isNotNull(), F.coalesce(F.col(f"{column}__place"), rest))
    return frame.withColumns({name: F.coalesce((at == i).cast("int"), F.lit(0)) for i, name in enumerate(names)}).drop(f"{column}__place")


class Fitted:
    """A fitted policy at a path: spec (one line of JSON), statistics and categories."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        self.features = [Feature(f["name"], f["kind"], set(f["tags"])) for f in self.spec["features"]]
        self.by, self.options, self.trees = self.spec["by"], self.spec["options"], self.spec["trees"]
        self.statistics = spark.read.parquet(f"{path}/statistics")
        self.categories = spark.read.parquet(f"{path}/categories")

    def __call__(self, frame: DataFrame) -> DataFrame:
        return self.transform(frame)

    def save(self, path: str) -> None:
        """A copy at another path."""
        spark = self.statistics.sparkSession
        self.statistics.coalesce(1).write.parquet(f"{path}/statistics")
        self.categories.write.parquet(f"{path}/categories")
        spark.read.text(f"{self.path}/spec").coalesce(1).write.text(f"{path}/spec")

    def names(self, kinds: Sequence[str]) -> list[str]:
        return [f.name for f in self.features if f.kind in kinds]

    def outputs(self) -> list[str]:
        """Names of the columns that the features become, in their order (for a policy of one training frame)."""
        made: list[str] = self.names(NUMERIC)
        for c in self.names(CATEGORICAL):
            made += [f"{c}__index"] if self.trees else self.spec["columns"][c]
        return made

    def _found(self, name: str, row) -> Column:
        """A statistic: a column of the joined row of the group, or a constant."""
        return F.col(name) if self.by else F.lit(row[name])

    def completed(self, frame: DataFrame, row) -> DataFrame:
        """Numbers as doubles, and missing values filled."""
        values = {}
        for f in self.features:
            filled = f.has("missing_values")
            if f.kind in NUMERIC:
                values[f.name] = F.coalesce(number(f.name), self._found(f"{f.name}__fill", row)) if filled else number(f.name)
            elif filled:
                values[f.name] = F.coalesce(F.col(f.name).cast("string"), self._found(f"{f.name}__mode", row))
        return frame.withColumns(values)

    def transform(self, frame: DataFrame) -> DataFrame:
        """The frame with its features transformed: numbers in place; categories as 0/1 columns (linear), as ``__index`` (trees), or,
        by resample, as ``__place`` and ``__width``."""
        row = None if self.by else self.statistics.first()
        if self.by:
            groups = self.statistics.withColumnsRenamed({c: f"_g{c}" for c in self.by})
            frame = frame.join(groups, same(self.by, "_g")).drop(*[f"_g{c}" for c in self.by])
        out = self.completed(frame, row)
        if not self.trees:
            out = out.withColumns({f.name: scaled(f, F.col(f.name), self.options, lambda s, f=f: self._found(f"{f.name}__{s}", row)) for f in self.features if f.kind in NUMERIC})
        categorical = self.names(CATEGORICAL)
        out = with_places(out, self.categories, categorical, self.by, "__place")
        for c in categorical:
            rest = self._found(f"{c}__rest", row)
            if self.trees:
                out = out.withColumn(f"{c}__index", F.coalesce(F.col(f"{c}__place"), F.lit(-1))).drop(f"{c}__place")
            elif self.by:
                out = out.withColumn(f"{c}__place", F.when(F.col(c).isNotNull(), F.coalesce(f"{c}__place", F.nullif(rest, F.lit(-1)))))
            else:
                out = indicators(out, c, self.spec["columns"][c], rest)
        drop = [n for n in self.statistics.columns if self.by and n not in self.by and not (n.endswith("__width") and not self.trees)]
        return out.drop(*categorical, *drop)

    def vector(self, numeric_first: bool = True) -> Column:
        """size, indices and values of a row's features under a policy by resample: numbers, then a place of each category."""
        numbers, categorical = self.names(NUMERIC), self.names(CATEGORICAL)
        values = [F.col(c).cast("double") for c in numbers]
        if self.trees:
            values += [F.col(f"{c}__index").cast("double") for c in categorical]
            categorical = []
        base, at, ones = F.lit(len(values)), [F.lit(i) for i in range(len(values))], values
        entries = [F.struct(i.alias("i"), v.alias("v")) for i, v in zip(at, ones, strict=True)]
        for c in categorical:
            entries.append(F.struct((base + F.col(f"{c}__place")).alias("i"), F.lit(1.0).alias("v")))
            base = base + F.col(f"{c}__width")
        kept = F.filter(F.array(*entries), lambda e: e["i"].isNotNull())
        return F.struct(base.cast("int").alias("size"), F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["v"]).alias("values"))


def dense(vector: Column) -> Column:
    """size, indices and values as an array of that size."""
    where = F.map_from_arrays(vector["indices"], vector["values"])
    return F.transform(F.sequence(F.lit(0), vector["size"] - 1), lambda i: F.coalesce(F.element_at(where, i), F.lit(0.0)))


def scaled(f: Feature, x: Column, options: Mapping[str, object], found: Callable[[str], Column]) -> Column:
    """What the linear policy makes of a number, from its statistics."""
    if f.has("skewed"):
        return standardized(transformed(x, found("power"), str(options["skewed_numeric_transform"]))[0], found("mean"), found("std"))
    if f.has("zero_inflated"):
        largest = found("max")
        return x / F.when(largest == 0, 1.0).otherwise(largest)
    return standardized(x, found("mean"), found("std"))


def fit_policy(train: DataFrame, features: Sequence[Feature], name: str, trees: bool, options: Mapping[str, object], by: Sequence[str] = (), path: str | None = None) -> Fitted:
    """Statistics and categories of the train rows, for each group of ``by``, written to ``path`` (or the shared folder)."""
    by, spark, features = list(by), train.sparkSession, list(features)
    path = path or new_path(spark, "policy")
    numeric, categorical = [f for f in features if f.kind in NUMERIC], [f for f in features if f.kind in CATEGORICAL]
    bad = [f.name for f in features if f.kind not in (*NUMERIC, *CATEGORICAL)]
    if bad:
        raise ValueError(f"columns of kinds that the policy can't take: {bad}")
    missing = untagged_missing(train, features)
    if missing:
        raise ValueError(f"columns with missing values that aren't tagged missing_values: {missing}")
    found = Gathered(by)
    if by:
        found.add(train.select(*by).distinct())
    filled = [f.name for f in numeric if f.has("missing_values")]
    if filled:
        found.add(fills(train, filled, str(options["numeric_impute"]), by))
    spec = {"policy": name, "trees": trees, "by": by, "options": dict(options), "features": [asdict(f) | {"tags": sorted(f.tags)} for f in features], "columns": {}}
    places = None
    if categorical:
        counts_path = new_path(spark, "category-counts")
        category_counts(train, [f.name for f in categorical], by).write.parquet(counts_path)
        parts, places = fit_categories(spark.read.parquet(counts_path), categorical, trees, options, by)
        for part in parts:
            found.add(part)
    if not trees and numeric:
        half = Fitted.__new__(Fitted)
        half.features, half.by, rows = numeric, by, train
        if by and filled:
            rows = rows.join(F.broadcast(found.frame(spark).withColumnsRenamed({c: f"_g{c}" for c in by})), same(by, "_g"))  # a row for each group
        base = half.completed(rows, found.rows.get(())).select(*by, *[f.name for f in numeric])
        for part in numeric_statistics(base, numeric, str(options["skewed_numeric_transform"]), by):
            found.add(part)
    if not by and not found.rows:
        found.add(spark.range(1).select(F.lit(0).alias("none")))
    statistics = found.frame(spark)
    # a row for each group: one file
    statistics.coalesce(1).write.parquet(f"{path}/statistics")
    empty = "".join(f"`{c}` {dict(train.dtypes)[c]}, " for c in by) + "_column string, _category string, _place int"
    (places if places is not None else spark.createDataFrame([], empty)).write.parquet(f"{path}/categories")
    if categorical and not trees and not by:
        written, row = spark.read.parquet(f"{path}/categories"), found.rows[()]
        widths = spark.createDataFrame([(f.name, row[f"{f.name}__width"], row[f"{f.name}__rest"]) for f in categorical if row.get(f"{f.name}__width") is not None], "_column string, width int, rest int")
        spec["columns"] = {f.name: column_names(written, widths, f.name)[0] for f in categorical}
    spark.createDataFrame([(json.dumps(spec, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/spec")
    return Fitted(spark, path)


def fills(train: DataFrame, columns: Sequence[str], how: str, by: Sequence[str]) -> DataFrame:
    """What replaces the missing values of numeric columns, as ``column__fill``."""
    if how == "median":
        return widened(quantiles(train, dict.fromkeys(columns, 0.5), by), columns, by, "__fill")
    if how == "mean":
        return train.groupBy(*by).agg(*[F.avg(number(c)).alias(f"{c}__fill") for c in columns])
    if how == "most_frequent":
        numbers = train.select(*by, *[number(c).alias(c) for c in columns])
        found = most_frequent(category_counts(numbers, columns, by), by).withColumn("value", F.col("value").cast("double"))
        return widened(found, columns, by, "__fill")
    if how == "constant":
        return train.groupBy(*by).agg(*[F.max(F.lit(CONSTANT_NUMBER)).alias(f"{c}__fill") for c in columns])
    raise ValueError(f"unknown way to fill numbers: {how}")


def fit_categories(counts: DataFrame, features: Sequence[Feature], trees: bool, options: Mapping[str, object], by: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """Fills, widths and rests of the columns, and the places of their categories."""
    how = str(options["categorical_impute"])
    names = [f.name for f in features if f.has("missing_values")]
    if how == "most_frequent":
        found = most_frequent(counts.filter(F.col("_column").isin(names)), by)
    elif how == "constant":
        found = counts.filter(F.col("_column").isin(names)).groupBy(*by, "_column").agg(F.max(F.lit(CONSTANT_TEXT)).alias("value"))
    else:
        raise ValueError(f"unknown way to fill categories: {how}")
    parts = [widened(found, names, by, "__mode")] if names else []
    full = completed_counts(counts, found, by)
    wide = [f.name for f in features if f.has("high_cardinality")]
    most, least = options["high_cardinality_max_categories"], int(options["high_cardinality_min_frequency"] or 1)
    limits = [([f.name for f in features if f.name not in wide], None, 1), (wide, most, least)]
    places, widths = None, None
    for columns, limit, rare in limits:
        if columns:
            p, w = category_places(full.filter(F.col("_column").isin(columns)), by, limit, rare, trees)
            places, widths = (p, w) if places is None else (places.unionByName(p), widths.unionByName(w))
    columns = [F.max(F.when(F.col("_column") == f.name, F.col(s))).alias(f"{f.name}__{s}") for f in features for s in ("width", "rest")]
    return [*parts, widths.groupBy(*by).agg(*columns)], places


def numeric_statistics(rows: DataFrame, features: Sequence[Feature], method: str, by: Sequence[str]) -> list[DataFrame]:
    """Means and deviations, largest sizes, and for skewed columns exponents and the transformed column's mean and deviation."""
    skewed = [f.name for f in features if f.has("skewed")]
    parts, base = [], rows
    if skewed:
        found = powers(rows, skewed, method, by)
        parts.append(found)
        if by:
            base = base.join(F.broadcast(found.withColumnsRenamed({c: f"_g{c}" for c in by})), same(by, "_g"))  # a row for each group
            power = {c: F.col(f"{c}__power") for c in skewed}
        else:
            row = found.first()
            power = {c: F.lit(row[f"{c}__power"]) for c in skewed}
    wanted = []
    for f in features:
        x = transformed(F.col(f.name), power[f.name], method)[0] if f.has("skewed") else F.col(f.name)
        if f.has("zero_inflated") and not f.has("skewed"):
            wanted.append(F.max(F.abs(x)).alias(f"{f.name}__max"))
        else:
            wanted += [F.avg(x).alias(f"{f.name}__mean"), F.stddev_pop(x).alias(f"{f.name}__std")]
    return [*parts, base.groupBy(*by).agg(*wanted)]


def known_options(options: Mapping[str, object] | None, known: Mapping[str, object]) -> dict:
    unknown = sorted(set(options or {}) - set(known))
    if unknown:
        raise ValueError(f"unknown options {unknown}")
    return {**known, **(options or {})}


def linear_policy(train: DataFrame, features: Sequence[Feature], options: Mapping[str, object] | None = None, by: Sequence[str] = (), path: str | None = None) -> Fitted:
    """Numeric columns standardised, skewed ones power-transformed, zero-inflated ones scaled; categories as 0/1 columns."""
    return fit_policy(train, features, "linear_default", False, known_options(options, LINEAR), by, path)


def tree_policy(train: DataFrame, features: Sequence[Feature], options: Mapping[str, object] | None = None, by: Sequence[str] = (), path: str | None = None) -> Fitted:
    """Numeric columns as they are or imputed; all categories as indexes."""
    return fit_policy(train, features, "tree_default", True, known_options(options, TREE), by, path)


def resample_policy(rows: DataFrame, features: Sequence[Feature], options: Mapping[str, object] | None = None, by: Sequence[str] = ("resample_id",), policy: str = "linear_default") -> DataFrame:
    """All rows of all resamples (role: train, valid, test) as a policy makes them that is fitted to each resample's train and valid rows."""
    return POLICIES[policy](rows.filter(F.col("role").isin("train", "valid")), features, options, by=list(by)).transform(rows)


def fitted_powers(train: DataFrame, column: str, method: str = "yeo-johnson", by: Sequence[str] = ()) -> DataFrame:
    """The exponent of largest likelihood, and mean and deviation of the transformed column."""
    rows = train.select(*by, number(column).alias(column))
    found = Gathered(by)
    for part in numeric_statistics(rows, [Feature(column, "numeric", {"skewed"})], method, list(by)):
        found.add(part)
    return found.frame(train.sparkSession)


#: Name -> policy: a function of (train, features, options) that gives a transform; further ones by register_policy.
POLICIES: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {"linear_default": linear_policy, "neural_default": linear_policy, "tree_default": tree_policy}
#: The policy that a kind of method has unless told otherwise.
DEFAULT_POLICIES = {"random_forest": "tree_default", "gradient_boosting": "tree_default", "boosted_trees": "tree_default"}


def register_policy(name: str, policy: Callable[..., Callable[[DataFrame], DataFrame]]) -> None:
    if name in POLICIES:
        raise ValueError(f"policy {name} exists already")
    POLICIES[name] = policy


def policy_named(name: str) -> Callable[..., Callable[[DataFrame], DataFrame]]:
    if name not in POLICIES:
        raise KeyError(f"unknown policy {name}; known: {sorted(POLICIES)}")
    return POLICIES[name]
