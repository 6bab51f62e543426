"""Boosted quantiles: leaves by brute force, stopping, refits, several models at once, and the table of stages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.operators import boost as bo
from stopwise.operators import learn as ln

NUMBERS, NAMES = ["a", "b"], ["c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        a, b, c, h = rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)]), rng.random(), rng.choice(["x", "y", None]), 15 if i % 3 else 30
        y = 2 * (a or 0) * (b > 0.5) + (c == "x") + rng.gauss(0, 0.2 + b)
        rows.append((i, h, a, b, c, y, i % 4))
    df = spark.createDataFrame(rows, "k long, h int, a double, b double, c string, y double, fold int")
    part = F.when(F.col("fold") < 2, bo.FIT).when(F.col("fold") == 2, bo.TUNE).otherwise(bo.OTHER)
    b = bo.binning(df.where("fold < 2"), NUMBERS, NAMES)
    return df, bo.prepare(df, b, "h", "y", part, ["k"]), b


def models(alphas=(0.1, 0.5, 0.9), features=(0, 1, 2)):
    return [bo.Model(f"q{round(100 * a)}|{h}", h, a, list(features)) for a in alphas for h in (15, 30)]


@pytest.fixture(scope="module")
def fitted(table):
    return bo.fit(table[1], models(), 3, 60, patience=5)


def pinball(y, q, alpha):
    return float(np.mean(np.maximum(alpha * (y - q), (alpha - 1) * (y - q))))


def test_bins_keep_the_order(table):
    df, t, b = table
    rows = df.select("k", "a", "b", "c").join(t.select("k", "x"), "k").collect()
    for i, c in enumerate("ab"):
        bins = sorted((r[c], r["x"][i]) for r in rows if r[c] is not None)
        assert all(x <= y for (_, x), (_, y) in zip(bins, bins[1:])) and {r["x"][i] for r in rows if r[c] is None} <= {0} and bins[0][1] >= 1
        assert all(x == 1 + sum(e <= v for e in b.cuts[c]) for v, x in bins)
    assert {(r["c"], r["x"][2]) for r in rows} == {("x", 1), ("y", 2), (None, 0)}


def test_models_stop_before_the_bound_and_beat_one_tree(spark, table, fitted):
    df, t, _ = table
    test = bo.predict(t.where(F.col("part") == bo.OTHER), fitted, ["k"]).join(df.select("k", "h"), "k").toPandas()
    train = df.where("fold < 2")
    for m in fitted:
        assert 1 <= m.best < 60 and len(m.trees) == m.best
        own = test[test.h == m.group]
        model, leaves = ln.fit_leaf_quantiles(train.where(F.col("h") == m.group), "y", NUMBERS, NAMES)
        one = model.transform(ln.flagged(df.where((F.col("fold") == 3) & (F.col("h") == m.group)), NUMBERS)).join(leaves, "leaf").select("y", "q10", "q90").toPandas()
        mine = pinball(own.y, own[m.name.split("|")[0]], m.alpha)
        if m.alpha != 0.5:
            assert mine < pinball(one.y, one[m.name.split("|")[0]], m.alpha)
            assert abs(np.mean(own.y <= own[m.name.split("|")[0]]) - m.alpha) < 0.06
        else:
            assert mine < 0.85 * pinball(own.y, np.median(own.y), 0.5)


def test_refit_uses_a_tenth_more_trees(table, fitted):
    again = bo.refitted(table[1], fitted, 3, 60)
    assert [len(m.trees) for m in again] == [max(1, math.ceil(1.1 * m.best)) for m in fitted]


def test_models_do_not_disturb_one_another(table, fitted):
    alone = bo.fit(table[1], models((0.9,))[:1], 3, 60, patience=5)[0]
    same = next(m for m in fitted if m.name == alone.name)
    assert alone.losses == pytest.approx(same.losses, rel=1e-9) and len(alone.trees) == len(same.trees)
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value) for a, b in zip(alone.trees, same.trees))


def test_a_feature_left_out_is_not_used(table):
    m = bo.fit(table[1], models((0.5,), (1, 2))[:1], 3, 3)[0]
    assert {int(f) for t in m.trees for f in t.feature} <= {-1, 1, 2} and set(m.gain) <= {1, 2}


def test_leaves_of_one_stage_by_brute_force(table):
    """Without sampling, a leaf's value is the least residual that reaches the model's share, and the split is the best of all."""
    m = bo.fit(table[1], models((0.9,))[:1], 3, 1, depth=1, least=20, share=1.0)[0]
    rows = [r for r in table[1].where(F.col("part") == bo.FIT).collect() if r["g"] == m.group]
    y = sorted(r["y"] for r in rows)
    assert m.base == y[math.ceil(0.9 * len(y)) - 1]
    d = np.array([r["y"] - m.base for r in rows])
    x = np.array([list(r["x"]) for r in rows])
    g = np.where(d > 0, 0.9, -0.1)
    best = max(
        (g[right].sum() ** 2 / right.sum() + g[~right].sum() ** 2 / (~right).sum() - g.sum() ** 2 / len(g), f, c)
        for f in range(3) for c in range(65) for right in [x[:, f] > c] if min(right.sum(), (~right).sum()) >= 20
    )
    t = m.trees[0]
    assert m.gain[int(t.feature[0])] == pytest.approx(best[0])
    right = x[:, t.feature[0]] > t.cut[0]
    for leaf, own in ((0, ~right), (1, right)):
        values = np.sort(d[own])
        assert t.value[leaf] == pytest.approx(values[math.ceil(0.9 * len(values)) - 1])


def test_stages_read_back(spark, table, fitted, tmp_path):
    path = f"{tmp_path}/stages"
    bo.stages(spark, fitted).write.parquet(path)
    back = bo.from_stages(spark.read.parquet(path))
    a = bo.predict(table[1], fitted, ["k"]).orderBy("k").collect()
    b = bo.predict(table[1], back, ["k"]).orderBy("k").select("k", "y", "q10", "q50", "q90").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_no_rows(spark, table):
    none = table[1].where("k < 0")
    m = bo.fit(none, models((0.5,)), 3, 5, patience=2)
    assert all(x.base == 0.0 and x.best == 0 for x in m) and bo.predict(none, m, ["k"]).count() == 0


def test_leaf_values_are_exact_when_tasks_give_points_only(table, monkeypatch):
    """Leaves far larger than the points that a task gives: the value is still the one at its rank, ties included."""
    monkeypatch.setattr(bo, "POINTS", 8)
    monkeypatch.setattr(bo, "HELD", 500)
    m = bo.fit(table[1], [bo.Model("q90|15", 15, 0.9, [])], 3, 1, share=1.0)[0]
    y = np.sort([r["y"] for r in table[1].where((F.col("part") == bo.FIT) & (F.col("g") == 15)).collect()])
    at = math.ceil(0.9 * len(y)) - 1
    assert m.base == y[at] and m.trees[0].value[0] == y[at] - m.base
    rng = np.random.default_rng(0)
    for alpha in (0.1, 0.5, 0.9):
        tasks = [np.round(rng.normal(i, 3, 1000 * (i + 1)), 1) for i in range(4)]
        given = [next(bo._points(0, np.zeros(len(t), np.uint8), t)) for t in tasks]
        rank, low, high, exact = bo._between(alpha, [g[2] for g in given], *[[np.frombuffer(g[k], t) for g in given] for k, t in ((3, float), (4, np.int64), (5, np.int64))])
        want = np.sort(np.concatenate(tasks))[math.ceil(alpha * 10_000) - 1]
        assert rank == math.ceil(alpha * 10_000) and low < want <= high and (not exact or high == want)


def test_blocks_are_dealt_evenly(spark, table, monkeypatch):
    """Rows that come from one task are read by all: no pass over the blocks waits for one task."""
    monkeypatch.setattr(bo, "BLOCK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    data = bo._pack(table[1].coalesce(1), models((0.5,)), {bo.FIT})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = data.groupBy(F.spark_partition_id()).agg(F.sum(F.length("part")).alias("n")).collect()
    assert sum(r["n"] for r in held) == table[1].where(F.col("part") == bo.FIT).count()
    assert max(r["n"] for r in held) < 0.5 * sum(r["n"] for r in held)


def test_categories_are_counted_by_one_job(spark):
    df = spark.createDataFrame([(v, v, v) for v in "xxyyzw"] + [(None, None, None)], "c string, d string, e string")
    sc, group = spark.sparkContext, "categories"
    sc.setJobGroup(group, group)
    b = bo.binning(df, [], ["c", "d", "e"], bins=4)
    few = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # the two commonest, and of those as common as each other the first
    assert b.values == {c: ["w", "x", "y"] for c in "cde"} and few <= 3


def test_bins_of_a_part_of_a_batch(table):
    whole = table[1].select("x").toArrow().combine_chunks().to_batches()[0]
    part = whole.slice(7, 20)
    assert bo._bins_of(part).T.tolist() == [list(v) for v in part.column("x").to_pylist()] and bo._bins_of(whole.slice(0, 0)).shape == (0, 0)
