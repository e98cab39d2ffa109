"""URL filters by cascades of Bloom filters, in DataFrame functions only.

A rule (action, host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's; the longest fitting rule decides. Every url yields the keys that could be rules: its host's suffixes joined to
its path's prefixes, of the label counts and lengths that occur in rules. The keys of all urls are the universe. Level 1
of a cascade encodes the listed keys, level 2 the keys of the universe that level 1 takes wrongly, level 3 the listed
keys that level 2 takes, and so on until no key is wrong: so each key of the universe is judged exactly, with no join.
Each action has a cascade; a url with no key in either is allowed.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated pages give repeated rows. Empty
tables give an empty result. Other columns of the input are not read. A rule listed under both actions blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import stored

#: Bits for a key of a level, hash functions, and the most bits that a level may have: the bound of what is sent to executors.
BITS_PER_KEY, HASHES, MOST_BITS = 8, 3, 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """All keys of a url that a rule with so many labels at most and a path of one of these lengths could have."""
    labels = F.split(host, "\\.")
    n = F.least(F.size(labels), F.lit(most_labels))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length(path)), lambda x: F.substring(path, F.lit(1), x))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(level * HASHES + i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


class Level:
    """One Bloom filter; its words are a constant of the plan, of at most MOST_BITS bits."""

    def __init__(self, keys: DataFrame, number: int):
        n = keys.count()
        self.number, self.bits = number, 1 << max(6, (n * BITS_PER_KEY - 1).bit_length())
        if self.bits > MOST_BITS:
            raise ValueError(f"{n} keys need more than {MOST_BITS} bits at level {number}")
        spots = keys.select(F.explode(F.array(*_positions(F.col("key"), number, self.bits))).alias("at"))
        words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value"))
        found = dict(words.collect())
        self.words = ",".join(str(found.get(i, 0)) for i in range(self.bits // 64))

    def takes(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        return reduce(lambda a, b: a & b, [
            F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            for p in _positions(key, self.number, self.bits)])


def cascade(universe: DataFrame, most_levels: int = 60) -> list[Level]:
    """Levels for a universe (key, listed) without repeats, until none of its keys is judged wrongly."""
    right = universe.filter("listed").select("key")
    wrong = universe.filter("not listed").select("key")
    levels: list[Level] = []
    while len(levels) < most_levels:
        level = Level(right, len(levels))
        levels.append(level)
        kept = stored(wrong.filter(level.takes(F.col("key"))), "level")
        if kept.isEmpty():
            return levels
        right, wrong = kept, right
    raise ValueError("the cascade doesn't end")


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: which level is the first not to take it."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].takes(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict of every page; rules: action (allow, block), host, path."""
    shape = rules.agg(F.max(F.size(F.split("host", "\\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    none = urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    if not shape["lengths"]:
        return none
    keys = candidate_keys(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])
    universe = urls.select(F.explode(keys).alias("key")).distinct()
    given = rules.select(F.concat("host", "path").alias("key"), "action").groupBy("key").agg(F.max("action").alias("action"))
    known = stored(universe.join(given, "key", "left"), "universe")
    actions = {a: cascade(known.select("key", (F.coalesce("action", F.lit("")) == a).alias("listed"))) for a in ("allow", "block")}
    hits = F.transform(keys, lambda k: F.struct(
        F.length(k).alias("size"), k.alias("key"),
        F.when(listed(actions["block"], k), F.lit("block")).when(listed(actions["allow"], k), F.lit("allow")).alias("action")))
    best = F.array_max(F.filter(hits, lambda x: x["action"].isNotNull()))
    return urls.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))


#: The rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.sql(f"select * from values {values} as rules(action, host, path)"))


ORACLE = f"""
with rules(action, rhost, rpath) as (values {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
urls as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
fits as (select page_id, rhost || rpath as rule, action,
    row_number() over (partition by page_id order by length(rhost || rpath) desc) as n
    from (select distinct page_id, host, path from urls) u join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select u.page_id, host, path, rule, coalesce(action, 'allow') as verdict from urls u left join fits f on u.page_id = f.page_id and n = 1
"""
