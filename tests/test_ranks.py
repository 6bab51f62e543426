"""Positions and order statistics against plain sorting."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from stopwise.operators import calibrate as cb
from stopwise.operators.ranks import conformal_rank, numbered, order_statistics, trailing_order_statistics
from stopwise.operators.relational import dense_index


def test_numbered_whatever_aqe_does(spark):
    rng = random.Random(1)
    rows = [(7,)] * 3000 + [(rng.randrange(10**9),) for _ in range(500)] + [(None,)]
    df = spark.createDataFrame(rows, "x long").repartition(7)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for size, parts in (("1k", "37"), ("64m", "37"), ("4k", "5")):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted((r["n"], r["x"]) for r in numbered(df, [F.col("x").asc_nulls_first()], "n").collect())
            assert [n for n, _ in got] == list(range(len(rows)))
            assert [x for _, x in got] == [None, *sorted(r[0] for r in rows[:-1])]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert numbered(df.limit(0), [F.col("x")], "n").count() == 0
    keys = df.distinct().dropna()
    assert [r["x"] for r in dense_index(keys, "x").orderBy("idx").collect()] == sorted({r[0] for r in rows[:-1]})


def place(n, coverage):
    return math.ceil((n - 1) * min(1.0, math.ceil((n + 1) * coverage) / n)) if n else 0


@pytest.mark.parametrize("pieces", [2, 7, 256])
def test_order_statistics(spark, pieces):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.gauss(0, 5), float(rng.randrange(4))])) for _ in range(2000)] + [("none", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["stat"]): (r["n"], r["value"]) for r in order_statistics(df, ["g"], {"hi": (F.col("x"), conformal_rank(0.9)), "neg": (-F.col("x"), conformal_rank(0.5))}, pieces).collect()}
    want = {}
    for g in {"a", "b", None, "one"}:
        xs = [x for k, x in rows if k == g and x is not None]
        want[g, "hi"] = (len(xs), sorted(xs)[place(len(xs), 0.9)])
        want[g, "neg"] = (len(xs), sorted(-x for x in xs)[place(len(xs), 0.5)])
    assert got == want
    assert order_statistics(df.limit(0), ["g"], {"hi": (F.col("x"), conformal_rank(0.9))}).count() == 0


def test_trailing_order_statistics(spark):
    rng = random.Random(3)
    days = [1, 2, 3, 5, 6, 9, 10, 11]
    rows = [(d, rng.choice(["a", "b"]), rng.choice([None, rng.gauss(d, 3), float(rng.randrange(3))])) for d in days for _ in range(rng.choice([3, 60]))]
    df = spark.createDataFrame(rows, "operating_day int, g string, x double")
    got = {(r["for_day"], r["g"]): (r["days"], r["n"], r["value"]) for r in trailing_order_statistics(df, ["g"], {"s": (F.col("x"), conformal_rank(0.8))}, 3, 2, pieces=5).collect()}
    want = {}
    for i, d in enumerate(days):
        for g in "ab":
            before = days[max(0, i - 3) : i]
            past = [r for r in rows if r[0] in before and r[1] == g]
            xs = sorted(r[2] for r in past if r[2] is not None)
            if len(before) >= 2 and xs:
                want[d, g] = (len(before), len(xs), xs[place(len(xs), 0.8)])
    assert got == want


def test_no_window_over_rows(spark):
    """One horizon holds all rows: windows see counts alone, and the rows are counted before the shuffle by as many tasks as there are."""
    df = spark.range(200_000).select(F.lit(15).alias("horizon_min"), (F.col("id") % 50_000).cast("double").alias("x"))
    found = cb.higher_quantile(df, F.col("x"), 0.9, ["horizon_min"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # what is ordered are stored counts
    assert len(re.findall("Window", plan)) <= 3
    assert found.first()["offset"] == float(sorted(i % 50_000 for i in range(200_000))[place(200_000, 0.9)])
