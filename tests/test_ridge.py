"""Ridges: the penalty chosen and the predictions are those of a pipeline fitted anew for each penalty."""

import os
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stopwise.operators import learn as ln
from stopwise.sources.shared import stored

NUMBERS, NAMES, SOME = ["a", "b"], ["c"], (0.1, 100.0, 10_000.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(900):
        a, b, c = rng.choice([None, rng.gauss(0, 1)]), rng.random(), rng.choice(["x", "y", None])
        made.append((i, a, b, c, 2 * (a or 0) + b + (c == "x") + rng.gauss(0, 1)))
    df = spark.createDataFrame(made, "k int, a double, b double, c string, y double")
    return df.where("k < 600"), df.where("k >= 600")


def anew(train, penalty, n):
    return Pipeline(stages=[*ln.preparation(NUMBERS, NAMES, True), LinearRegression(labelCol="y", elasticNetParam=0.0, regParam=penalty / n)]).fit(train)


def test_same_as_a_pipeline_for_each_penalty(rows):
    a, b = (ln.flagged(x, NUMBERS) for x in rows)
    n = a.count()
    best = min(SOME, key=lambda p: ln.mae(anew(a, p, n).transform(b), "y"))
    model, chosen = ln.fit_ridge(*rows, "y", NUMBERS, NAMES, SOME)
    both = a.unionByName(b)
    want, got = ([r["prediction"] for r in m.transform(both).orderBy("k").collect()] for m in (anew(both, best, n), model))
    assert chosen == best and got == pytest.approx(want, abs=1e-9)


def test_the_preparation_is_learned_once_for_all_penalties(rows, monkeypatch):
    made = []
    whole = ln.preparation
    monkeypatch.setattr(ln, "preparation", lambda *a: made.append(a) or whole(*a))
    ln.fit_ridge(*rows, "y", NUMBERS, NAMES, SOME)
    tried = len(made)
    ln.fit_ridge(*rows, "y", NUMBERS, NAMES, (10.0,))
    assert (tried, len(made)) == (2, 3)


@pytest.mark.parametrize("penalties", [SOME, (10.0,)])
def test_rows_are_read_once_for_all_fits(spark, rows, penalties):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    a, b = (x.coalesce(1).mapInArrow(counted, x.schema) for x in rows)
    ln.fit_ridge(a, b, "y", NUMBERS, NAMES, penalties)
    assert read.value == 900


def test_a_reloaded_model_is_compared_row_by_row(spark, rows, tmp_path):
    """Rows that share a key, or have none, are each compared with themselves, in one pass without a join."""
    model, _ = ln.fit_ridge(*rows, "y", NUMBERS, NAMES, (10.0,))
    x = rows[1].select("*", F.lit("t").alias("trip_key"), F.lit(1).alias("stop_seq"), F.lit(15).alias("horizon_min"))
    assert ln.verify_reload(model, f"{tmp_path}/model", x, NUMBERS) == 0.0


def test_rows_stored_by_value_are_the_same_and_read_apart(spark):
    """Columns keep their order, nulls stay, and a horizon's rows are in files that no other horizon's reader opens."""
    df = spark.createDataFrame([(i, 15 * (i % 3 + 1), None if i % 7 == 0 else f"s{i % 2}", i / 2) for i in range(60)], "k int, horizon_min int, split string, v double")
    out = stored(df, "by", by=("horizon_min", "split"))
    assert out.dtypes == df.dtypes and sorted(out.collect(), key=lambda r: r["k"]) == df.collect()
    files = lambda x: {r[0] for r in x.select(F.input_file_name()).distinct().collect()}
    assert not files(out.where("horizon_min = 15")) & files(out.where("horizon_min <> 15"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_features_are_stored_by_horizon_and_split(spark):
    from stopwise.plans import models

    plan = models.rows(spark, "/root/testdata/sf0.001").where("horizon_min = 15 and split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "horizon_min" in plan.split("PartitionFilters: ")[1].split("], ")[0]
