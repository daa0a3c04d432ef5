"""The lake's folders, and derived series that follow from a fetch."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlspan.operators import refresh as W
from marlspan.sources import store

SCHEMA = "series_id string, ts timestamp_ntz, value double"
FORMULAS = {"d": ("a - b", {"a": "A", "b": "B"}), "e": ("d / c", {"d": "d", "c": "C"}), "f": ("e + d * 2", {"e": "e", "d": "d"}), "g": ("x", {"x": "X"})}


def test_levels_and_cycles():
    assert W.levels(FORMULAS) == [["d", "g"], ["e"], ["f"]]
    with pytest.raises(ValueError, match="each other: p, q"):
        W.levels({"p": ("q", {"q": "q"}), "q": ("p", {"p": "p"}), "r": ("a", {"a": "A"})})
    with pytest.raises(ValueError):
        W.levels({"p": ("p", {"p": "p"})})


def rows(df):
    return sorted((r["series_id"], r["ts"], round(r["value"], 9)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_refresh_equals_recomputing(spark, seed):
    rng = np.random.default_rng(seed)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=int(k))
    base = [(s, day(k), float(rng.integers(0, 5))) for s in "ABCX" for k in sorted(rng.choice(60, 25, replace=False))]
    news = {"A": [50, 58, 61], "B": [30], "C": []} if seed else {"C": [3]}
    fetched = [(s, day(k), 7.5) for s, ks in news.items() for k in ks] + [r for r in base if r[0] == "A"][:5]  # some come again as they are
    stored = spark.createDataFrame(base, SCHEMA)
    stored = stored.unionByName(W.recompute(stored, FORMULAS, fill=4)).persist()
    fresh = spark.createDataFrame(fetched, SCHEMA)
    written, since = W.refresh(stored, fresh, FORMULAS, fill=4)
    begins = {r["series_id"]: r["since"] for r in since.collect()}
    assert "g" not in begins and ("d" in begins) == bool(seed)
    got = {(s, t): v for s, t, v in rows(stored) if not (s in begins and t >= begins[s])} | {(s, t): v for s, t, v in rows(written)}
    now = {(r[0], r[1]): r[2] for r in base} | {(r[0], r[1]): r[2] for r in fetched}
    full = spark.createDataFrame([(*k, v) for k, v in now.items()], SCHEMA)
    want = {(s, t): v for s, t, v in rows(full.unionByName(W.recompute(full, FORMULAS, fill=4)))}
    assert got == want
    assert all(t >= begins[s] for s, t, _ in rows(written) if s in begins)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_write_leaves_other_folders_and_a_failed_one_all(spark, tmp_path):
    at, t = str(tmp_path / "lake"), dt.datetime(2024, 1, 1)
    series = [f"s{k}" for k in range(40)]
    store.create(spark.createDataFrame([(s, t, 1.0) for s in series], SCHEMA), at, 8)
    before = files(at)
    store.upsert(spark.createDataFrame([("s3", t, 2.0), ("s3", dt.datetime(2024, 1, 2), 3.0), ("s3x", t, 4.0)], SCHEMA), at, 8)
    after = files(at)
    touched = {r[0] for r in spark.createDataFrame([("s3",), ("s3x",)], "s string").select(store.folder(F.col("s"), 8)).collect()}
    assert {f for f in before if int(f.split("folder=")[1].split("/")[0]) not in touched} <= after and not before & {f for f in after if int(f.split("folder=")[1].split("/")[0]) in touched}
    assert rows(store.read(spark, at, ["s3"], 8)) == [("s3", t, 2.0), ("s3", dt.datetime(2024, 1, 2), 3.0)] and store.read(spark, at).count() == 42
    bad = spark.createDataFrame([("s5", t, 9.0)], SCHEMA).withColumn("value", F.when(F.col("series_id") == "s5", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        store.upsert(bad, at, 8)
    assert files(at) == after and rows(store.read(spark, at, ["s5"], 8)) == [("s5", t, 1.0)]
    plan = store.read(spark, at, ["s3"], 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    store.replace_from(spark.createDataFrame([("s3", dt.datetime(2024, 1, 3), 5.0)], SCHEMA), spark.createDataFrame([("s3", dt.datetime(2024, 1, 2))], "series_id string, since timestamp_ntz"), at, 8)
    assert rows(store.read(spark, at, ["s3"], 8)) == [("s3", t, 2.0), ("s3", dt.datetime(2024, 1, 3), 5.0)]
