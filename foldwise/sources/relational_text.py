"""Relational text: records of comma-separated fields of which a quoted one holds a bag's instances, a line each."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A field from the record's start or a comma on; each character is read once.
FIELD = '(?:^|,)\\s*("[^"]*"|[^,]*)'


@dataclass
class Header:
    """Bag fields with their types, in order; the relational one has its own fields."""

    fields: list[tuple[str, str]]
    inner: list[tuple[str, str]]
    relational: str

    def roles(self) -> tuple[str, str]:
        """The bag's id (the first plain field) and target (``class``, else the last plain field)."""
        plain = [n for n, _ in self.fields if n != self.relational]
        return plain[0], "class" if "class" in plain else plain[-1]


def parse_header(text: str) -> Header:
    fields: list[tuple[str, str]] = []
    inner: list[tuple[str, str]] = []
    name, inside = None, False
    for line in text.splitlines():
        words = line.strip()
        found = re.match(r"(?i)@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)$", words)
        if found:
            field, kind = found[1].strip("'\""), found[2].strip()
            (inner if inside else fields).append((field, kind.lower() if kind.lower() == "relational" else kind))
            if kind.lower() == "relational":
                name, inside = field, True
        elif re.match(r"(?i)@end\b", words):
            inside = False
    if name is None:
        raise ValueError("the header has no relational attribute")
    return Header(fields, inner, name)


def typed(value: Column, kind: str) -> Column:
    """A field by its declared type; a question mark is null."""
    text = F.nullif(F.trim(F.trim(value), F.lit("'")), F.lit("?"))
    if kind.lower() in ("numeric", "real"):
        return text.try_cast("double")
    if kind.lower() == "integer":
        return text.try_cast("bigint")
    return text


def parse_records(records: DataFrame, header: Header, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Bags and instances (with bag id and position in the bag) of records, a row each."""
    parts = records.filter(F.trim(column) != "").select(F.regexp_extract_all(column, F.lit(FIELD), F.lit(1)).alias("_p"))
    names = [n for n, _ in header.fields]
    bag_id, _ = header.roles()
    cells = {n: F.trim(F.get(F.col("_p"), F.lit(i))) for i, n in enumerate(names)}
    bags = parts.select(*[typed(cells[n], k).alias(n) for n, k in header.fields if n != header.relational])
    body = F.replace(F.trim(cells[header.relational], F.lit('"')), F.lit("\\n"), F.lit("\n"))
    lines = parts.select(typed(cells[bag_id], dict(header.fields)[bag_id]).alias(bag_id), F.posexplode(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")).alias("position", "_line"))
    cut = lines.withColumn("_v", F.split("_line", ","))
    return bags, cut.select(bag_id, "position", *[typed(F.get(F.col("_v"), F.lit(i)), k).alias(n) for i, (n, k) in enumerate(header.inner)])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with their file, the byte range that they were read in (_block) and their order in it (_line)."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def records_of(lines: DataFrame) -> DataFrame:
    """Lines put together to records: a line begins one where the quotes before it in its file are even in number.

    Quotes are counted by byte range; a file's ranges are summed in order, and windows run inside a range, so a file of any
    size is read by many tasks. Records that reach over ranges meet by their number.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("_quotes", quotes)
    inside = W.partitionBy("_file", "_block").orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)

    def with_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
        """The sum of a value over the lines before, in the whole file."""
        ranges = rows.groupBy("_file", "_block").agg(F.sum(value).alias("_sum")).select(
            F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
        summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        return summed.join(ranges, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).withColumn(name, F.col("_earlier") + F.col("_inside")).drop("_f", "_b", "_earlier", "_inside")

    begun = with_sum(counted, "_quotes", "_before").withColumn("_begins", (F.col("_before") % 2 == 0).cast("long"))
    numbered = with_sum(begun, "_begins", "_records").withColumn("_record", F.col("_records") + F.col("_begins"))
    parts = numbered.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("_parts"))
    return parts.select(F.array_join(F.transform("_parts", lambda p: p["value"]), "\n").alias("value"))


def read_relational_text(spark: SparkSession, path: str, header: Header | None = None) -> tuple[DataFrame, DataFrame]:
    """Bags and instances of files. Each file begins with the header, up to @data, unless one is given for files without."""
    lines = numbered_lines(spark, path)
    if header is None:
        place = F.struct("_block", "_line")
        ends = lines.filter(F.lower(F.ltrim("value")).startswith("@data")).groupBy("_file").agg(F.min(place).alias("_end")).withColumnRenamed("_file", "_f")
        marked = lines.join(ends, F.col("_file") == F.col("_f"))
        # a header is as long as its attributes are many; that of the first file counts
        above = marked.filter(place < F.col("_end"))
        first = above.agg(F.min("_file")).first()[0]
        header = parse_header("\n".join(r["value"] for r in above.filter(F.col("_file") == first).orderBy("_block", "_line").collect()))
        lines = marked.filter(place > F.col("_end")).select(*lines.columns)
    return parse_records(records_of(lines), header)
