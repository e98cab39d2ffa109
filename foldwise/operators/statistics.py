"""Statistics that one aggregate can't give: exact quantiles and exponents of power transforms, for all groups and columns at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.functions.columns import same

#: Values of a group that a window may hold; accuracy of the approximate quantiles that bracket a rank.
MOST_VALUES, ACCURACY = 1_000_000, 10_000
#: Newton steps after which an exponent is taken as it is, and the size of a step that ends them.
STEPS, CLOSE = 60, 1e-10


def number(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def long_values(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, _column and _value: a row for each number of the columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), number(c).alias("_value")) for c in columns]))
    return rows.select(*by, each.alias("_each")).select(*by, "_each.*").filter("_value is not null")


def quantiles(rows: DataFrame, wanted: Mapping[str, float], by: Sequence[str] = (), most: int = MOST_VALUES) -> DataFrame:
    """Exact quantiles (linear between neighbours) of columns, for each group of ``by``: by, _column and value.

    Approximate quantiles bracket the two ranks that matter; exact counts below the bracket tell where in it they are, and
    only values inside it meet in a window. A bracket that holds more than ``most`` values is narrowed again, and one that
    misses its ranks is widened to the whole column, so the result doesn't depend on the sketch. What is kept on the
    way is a row for each group and column.
    """
    by = list(by)
    keys = [*by, "_column"]
    values = long_values(rows, list(wanted), by)
    margin = 2.0 / ACCURACY

    def around(at: float, name: str) -> Column:
        return F.percentile_approx("_value", [min(1.0, max(0.0, at - margin)), min(1.0, at + margin)], ACCURACY).alias(name)

    shares = sorted(set(wanted.values()))
    found = values.groupBy(*keys).agg(F.count("*").alias("_n"), *[around(q, f"_a{i}") for i, q in enumerate(shares)])
    kinds = dict(found.dtypes)
    schema = ", ".join([*[f"`_k{c}` {kinds[c]}" for c in keys], "_n long, _rank double, _low double, _high double"])
    # a row for each group and column is on the driver, so that no pass is run again and what it sends out is as small
    brackets = []
    for r in found.collect():
        low, high = r[f"_a{shares.index(wanted[r['_column']])}"]
        brackets.append((*[r[c] for c in keys], r["_n"], wanted[r["_column"]] * (r["_n"] - 1), low, high))
    for turn in range(64):
        joined = values.join(F.broadcast(rows.sparkSession.createDataFrame(brackets, schema)), same(keys, "_k"))
        inside = F.col("_value").between(F.col("_low"), F.col("_high"))
        counted = joined.groupBy(*[f"_k{c}" for c in keys], "_n", "_rank", "_low", "_high").agg(
            F.count_if(F.col("_value") < F.col("_low")).alias("_before"), F.count_if(inside).alias("_inside"),
            F.min("_value").alias("_min"), F.max("_value").alias("_max"),
            F.percentile_approx(F.when(inside, F.col("_value")), [i / 256 for i in range(257)], ACCURACY).alias("_cuts"))
        marks = counted.collect()
        crowded = [m["_inside"] > most and m["_low"] < m["_high"] for m in marks]
        missed = [not (m["_before"] <= math.floor(m["_rank"]) and math.ceil(m["_rank"]) < m["_before"] + m["_inside"]) for m in marks]
        if not any(crowded) and not any(missed):
            break
        brackets = []
        for m, many, miss in zip(marks, crowded, missed, strict=True):
            low, high = m["_low"], m["_high"]
            if miss:
                low, high = m["_min"], m["_max"]
            elif many and turn < 63:
                # the cuts are about 1/256 of the inside apart, and two more on each side hold the ranks for sure
                at = (m["_rank"] - m["_before"]) / m["_inside"] * 256
                low, high = m["_cuts"][max(0, int(at) - 2)], m["_cuts"][min(256, int(at) + 3)]
            brackets.append((*[m[f"_k{c}"] for c in keys], m["_n"], m["_rank"], low, high))
    exact = [(*[m[f"_k{c}"] for c in keys], m["_n"], m["_rank"], m["_low"], m["_high"], m["_before"]) for m in marks]
    picked = values.join(F.broadcast(rows.sparkSession.createDataFrame(exact, schema + ", _before long")), same(keys, "_k")).filter(F.col("_value").between(F.col("_low"), F.col("_high")))
    distinct = picked.groupBy(*keys, "_rank", "_before", "_value").agg(F.count("*").alias("_count"))
    upto = F.col("_before") + F.sum("_count").over(W.partitionBy(*keys).orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    placed = distinct.withColumn("_upto", upto)
    first, last = F.floor("_rank"), F.ceil("_rank")
    here = [(F.col("_upto") > rank) & (F.col("_upto") - F.col("_count") <= rank) for rank in (first, last)]
    ends = placed.groupBy(*keys, "_rank").agg(F.max(F.when(here[0], F.col("_value"))).alias("_a"), F.max(F.when(here[1], F.col("_value"))).alias("_b"))
    return ends.select(*keys, (F.col("_a") + (F.col("_rank") - first) * (F.col("_b") - F.col("_a"))).alias("value"))


def widened(found: DataFrame, columns: Sequence[str], by: Sequence[str], suffix: str, value: str = "value") -> DataFrame:
    """(by, _column, value) as a column for each of ``columns``."""
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col(value))).alias(f"{c}{suffix}") for c in columns])


def series(log: Column, power: Column, order: int) -> Column:
    """The derivative of that order, by the exponent, of (exp(exponent x log) - 1) / exponent, near exponent 0."""
    terms = []
    for k in range(order, order + 7):
        factor = math.prod(range(k - order + 1, k + 1)) / math.factorial(k + 1)
        terms.append(F.pow(power, F.lit(k - order)) * F.pow(log, F.lit(k + 1)) * factor)
    return sum(terms[1:], terms[0])


def power_and_slopes(base: Column, power: Column) -> tuple[Column, Column, Column]:
    """(base^power - 1) / power and its first two derivatives by the exponent."""
    log = F.log(base)
    near = F.abs(power * log) < 0.01
    raised = F.exp(power * log)
    t = F.when(near, series(log, power, 0)).otherwise((raised - 1) / power)
    t1 = F.when(near, series(log, power, 1)).otherwise((raised * log - (raised - 1) / power) / power)
    t2 = F.when(near, series(log, power, 2)).otherwise((raised * log * log - 2 * (raised * log - (raised - 1) / power) / power) / power)
    return t, t1, t2


def transformed(x: Column, power: Column, method: str) -> tuple[Column, Column, Column]:
    """The transform and its first two derivatives by the exponent."""
    if method == "box-cox":
        return power_and_slopes(x, power)
    up, down = power_and_slopes(1 + x, power), power_and_slopes(1 - x, 2 - power)
    return tuple(F.when(x >= 0, u).otherwise(sign * d) for u, d, sign in zip(up, down, (-1, 1, -1), strict=True))


def powers(rows: DataFrame, columns: Sequence[str], method: str = "yeo-johnson", by: Sequence[str] = ()) -> DataFrame:
    """The exponent of largest likelihood of each column and group: by, and ``column__power`` for each column.

    Newton's steps on the likelihood's slope, for all columns and groups in one aggregation a step; where a step leaves the
    interval known to hold the root it is halved instead, and the interval is unbounded until a slope of each sign was seen.
    Columns that have ended are left out of the next step. The driver holds a few numbers for each group and column.
    Columns without spread have the exponent 1. Box-Cox takes positive values only; others are left out.
    """
    by, spark = list(by), rows.sparkSession
    if method not in ("yeo-johnson", "box-cox"):
        raise ValueError(f"unknown transform {method}")
    values = {c: F.when(number(c) > 0, number(c)) if method == "box-cox" else number(c) for c in columns}
    base = rows.select(*by, *[v.alias(c) for c, v in values.items()])
    groups = [tuple(r) for r in base.select(*by).distinct().collect()] if by else [()]
    state = {(g, c): {"at": 1.0, "low": None, "high": None, "done": False} for g in groups for c in columns}
    kinds = {n: k for n, k in base.dtypes}
    schema = ", ".join([*[f"`_k{n}` {kinds[n]}" for n in by], "_at map<string,double>"])
    for _ in range(STEPS):
        open_ = sorted({c for (_, c), s in state.items() if not s["done"]})
        if not open_:
            break
        table = [(*g, {c: state[g, c]["at"] for c in open_}) for g in groups if any(not state[g, c]["done"] for c in open_)]
        # one row for each group that is still open
        joined = base.join(F.broadcast(spark.createDataFrame(table, schema)), same(by, "_k"))
        wanted = []
        for c in open_:
            x, p = F.col(c), F.col("_at")[c]
            t, t1, t2 = (F.col(f"_{c}_t{i}") for i in range(3))
            joined = joined.withColumns({f"_{c}_t{i}": v for i, v in enumerate(transformed(x, p, method))})
            slope = F.sum(F.log(x)) if method == "box-cox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
            wanted.append(F.struct(F.count(t).alias("n"), slope.alias("slope"), F.var_pop(t).alias("v"), F.covar_pop(t, t1).alias("c"),
                                   F.var_pop(t1).alias("v1"), F.covar_pop(t, t2).alias("c2")).alias(c))
        for r in joined.groupBy(*[f"_k{n}" for n in by]).agg(*wanted).collect():
            g = tuple(r[f"_k{n}"] for n in by)
            for c in open_:
                if not state[g, c]["done"]:
                    advance(state[g, c], r[c])
    result = [(*g, *[state[g, c]["at"] for c in columns]) for g in groups]
    return spark.createDataFrame(result, ", ".join([*[f"`{n}` {kinds[n]}" for n in by], *[f"`{c}__power` double" for c in columns]]))


def advance(s: dict, sums) -> None:
    """One step of an exponent: towards the root of the likelihood's slope."""
    n, v = sums["n"], sums["v"]
    at = s["at"]
    if not n or v == 0:
        s.update(at=1.0, done=True)
        return
    good = all(x is not None and math.isfinite(x) for x in (v, sums["c"], sums["v1"], sums["c2"]))
    slope = sums["slope"] - n * sums["c"] / v if good else None
    if slope is None:
        # too far out for numbers: come back to what is known
        s["high" if at > 0 else "low"] = at
        inner = s["low"] if at > 0 else s["high"]
        s["at"] = ((inner if inner is not None else 0.0) + at) / 2
        return
    bend = -n * ((sums["v1"] + sums["c2"]) / v - 2 * (sums["c"] / v) ** 2)
    s["low" if slope > 0 else "high"] = at
    step = -slope / bend if bend < 0 else math.copysign(max(1.0, abs(at)), slope)
    step = max(-2 * max(1.0, abs(at)), min(2 * max(1.0, abs(at)), step))
    to = at + step
    low, high = s["low"], s["high"]
    if low is not None and high is not None and not low < to < high:
        to = (low + high) / 2
    s["done"] = slope == 0 or abs(to - at) <= CLOSE * max(1.0, abs(at))
    s["at"] = to
