"""Quantiles by rank and exponents by likelihood, against small local versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import statistics


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 400), (None, 301), ("b", 2), ("c", 1)):
        x = rng.lognormal(size=n)
        rows += [(g, float(v), float(round(v)), None if i % 3 else float(v)) for i, v in enumerate(x)]
    rows += [("d", None, float("nan"), None)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_quantiles_are_exact(numbers, most):
    rows, frame = numbers
    wanted = {"x": 0.5, "y": 0.5, "z": 0.9}
    got = {(r["g"], r["_column"]): r["value"] for r in statistics.quantiles(frame, wanted, ["g"], most).collect()}
    expected = {}
    for g in ("a", None, "b", "c", "d"):
        for i, c in enumerate("xyz", 1):
            mine = [r[i] for r in rows if r[0] == g and r[i] is not None and not math.isnan(r[i])]
            if mine:
                expected[g, c] = float(np.quantile(mine, wanted[c]))
    assert got == pytest.approx(expected)


def test_windows_hold_few_values(spark):
    """Of 60,000 distinct values only those next to the rank are left for the window."""
    frame = spark.range(60_000).select((F.xxhash64("id") / 1e15).alias("x"))
    most = 200
    assert statistics.quantiles(frame, {"x": 0.5}, most=most).first()["value"] == pytest.approx(np.median([r[0] for r in frame.collect()]), rel=1e-15)


def likelihood(x, p, method):
    if method == "box-cox":
        t, slope = (np.log(x) if abs(p) < 1e-12 else (x**p - 1) / p), np.log(x).sum()
    else:
        up, down = np.where(x >= 0, x, 0), np.where(x < 0, x, 0)
        high = np.log1p(up) if abs(p) < 1e-12 else ((1 + up) ** p - 1) / p
        low = -np.log1p(-down) if abs(p - 2) < 1e-12 else -((1 - down) ** (2 - p) - 1) / (2 - p)
        t, slope = np.where(x >= 0, high, low), (np.sign(x) * np.log1p(np.abs(x))).sum()
    return -len(x) / 2 * np.log(t.var()) + (p - 1) * slope


def by_halving(x, method, low=-60.0, high=60.0):
    """The optimum by golden section, then the root of the difference quotient."""
    golden = (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if likelihood(x, a, method) > likelihood(x, b, method) else (a, high)
    mid, h = (low + high) / 2, 1e-3
    slope = (likelihood(x, mid + h, method) - likelihood(x, mid - h, method)) / (2 * h)
    bend = (likelihood(x, mid + h, method) - 2 * likelihood(x, mid, method) + likelihood(x, mid - h, method)) / h**2
    return mid - slope / bend


@pytest.mark.parametrize("method", ["box-cox", "yeo-johnson"])
def test_exponents(spark, method):
    rng = np.random.default_rng(7)
    columns = {
        "logarithm": np.exp(rng.normal(size=300)),
        "root": np.abs(rng.normal(3, 0.5, size=300)) ** 2 + 0.1,
        # far outside of -2..2: powers of a normal variable near 1
        "high": (1 + 0.02 * rng.normal(size=300)) ** (1 / 9),
        "low": (1 + 0.03 * rng.normal(size=300)) ** (-1 / 4),
    }
    if method == "yeo-johnson":
        columns["both_signs"] = rng.normal(size=300) ** 3
    names = list(columns)
    frame = spark.createDataFrame([("g", *map(float, v)) for v in zip(*columns.values(), strict=True)], "g string, " + ", ".join(f"{n} double" for n in names))
    got = statistics.powers(frame, names, method, ["g"]).first()
    for n in names:
        assert got[f"{n}__power"] == pytest.approx(by_halving(columns[n], method), abs=2e-3 * max(1, abs(got[f"{n}__power"])) if n in ("high", "low") else 1e-4), n
        # a local optimum to 10^-6: the slope's root lies between
        p, h = got[f"{n}__power"], 1e-3
        slope = (likelihood(columns[n], p + h, method) - likelihood(columns[n], p - h, method)) / (2 * h)
        bend = (likelihood(columns[n], p + h, method) - 2 * likelihood(columns[n], p, method) + likelihood(columns[n], p - h, method)) / h**2
        assert abs(slope / bend) < 1e-4 * max(1, abs(p)), n
    assert any(abs(got[f"{n}__power"]) > 2 for n in names)


def test_exponents_of_groups_and_odd_columns(spark):
    rows = [(g, float(v), 5.0, None) for g, values in (("a", [1, 2, 4, 8]), (None, [3, 9, 27, 81, 1])) for v in values]
    frame = spark.createDataFrame(rows, "g string, x double, same double, none double")
    got = {r["g"]: r for r in statistics.powers(frame, ["x", "same", "none"], "box-cox", ["g"]).collect()}
    for g in ("a", None):
        x = np.array([r[1] for r in rows if r[0] == g])
        assert got[g]["x__power"] == pytest.approx(by_halving(x, "box-cox", -5, 5), abs=1e-5)
        assert got[g]["same__power"] == 1.0 and got[g]["none__power"] == 1.0
    with pytest.raises(ValueError):
        statistics.powers(frame, ["x"], "no_such")
