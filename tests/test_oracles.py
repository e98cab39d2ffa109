"""Every query of the library that has SQL gives the SQL's rows, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows(frame):
    def text(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA or v is pd.NaT:
            return "null"
        return format(float(v) + 0.0, ".9g") if isinstance(v, (float, int)) and not isinstance(v, bool) or type(v).__name__ in ("Decimal", "float64", "float32", "int64", "int32") else str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(text(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    ours = registry.QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.execute(registry.ORACLES[name]).df()
    assert rows(ours) == rows(theirs)


def test_halves_are_rounded_alike(spark, duck):
    from foldwise.plans import preprocessing

    assert f"lambda v: {preprocessing.THREE}" in registry.ORACLES["pp_assemble"]
    halves = [sign * (n / 1000 + 0.0005) for n in range(3000) for sign in (1, -1)]
    five = [round(h, 5) for h in halves]
    ours = [r[0] for r in spark.createDataFrame([(v,) for v in five], "v double").select(F.format_string("%.3f", F.round("v", 3) + 0.0)).collect()]
    assert ours == [r[0] for r in duck.execute(f"select {preprocessing.THREE} from (select unnest($v::double[]) as v)", {"v": five}).fetchall()]
