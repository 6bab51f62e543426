"""The departure ahead found by streams: one row meets each point, and the answers are those of a search through all departures."""

import datetime
import random

import pytest

from stopwise.plans import streams
from stopwise.streaming import replay as rp

START = datetime.datetime(2024, 1, 1, 6)
DEP = "segment string, dep_time timestamp, dep_d double, arr_time timestamp, arr_d double"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def found(deps, segment, cut):
    """The latest departure of the 3600 s before, by brute force; of one second the largest delay, then arrival."""
    near = [x for x in deps if x[0] == segment and cut - 3600 < x[1] < cut]
    last = max(near, key=lambda x: (x[1], x[2], -1 if x[3] is None else x[3], x[4] or 0.0), default=None)
    if last is None:
        return None, None, None
    return at(last[1]), last[2], last[4] - last[2] if last[4] is not None and last[3] < cut else None


def run(spark, deps, points, **how):
    d = spark.createDataFrame([(s, at(t), x, None if a is None else at(a), y) for s, t, x, a, y in deps], DEP)
    p = spark.createDataFrame([(i, s, at(t)) for i, s, t in points], "point_id int, segment string, cut_time timestamp")
    until = max(at(t) for _, _, t in points)
    out = streams.drained(rp.train_ahead(streams.stream(d, "dep_time", until=until), streams.stream(p, "cut_time"), "60 minutes", **how))
    return {r["point_id"]: (r["dep_time"], r["dep_d"], r["gain"]) for r in out.where("point_id is not null").collect()}


def made(seed, exact):
    rng = random.Random(seed)
    deps = []
    for _ in range(250):
        t = rng.randrange(0, 4 * 3600, 20)  # many share a second, and many lie at whole minutes
        known = rng.random() < 0.7
        deps.append((rng.choice("ab"), t, float(rng.randrange(5)), t + rng.randrange(600) if known else None, float(rng.randrange(5)) if known else None))
    deps += [("c", 0, 1.0, None, None)]
    points = [(i, rng.choice("ab"), rng.randrange(0, 6 * 3600, 60 if exact else 7)) for i in range(150)]
    # an hour after the only departure, a second less, at it, more than a day after all departures, and elsewhere
    return deps, [*points, (500, "c", 3600), (501, "c", 3600 - 60 if exact else 3599), (502, "c", 0), (503, "c", 40 * 3600), (504, "none", 60)]


@pytest.mark.parametrize("how", [{}, {"grain": "1 minute"}])
def test_the_latest_departure_of_every_point(spark, how):
    deps, points = made(5, bool(how))
    assert run(spark, deps, points, **how) == {i: found(deps, s, t) for i, s, t in points}


def test_departures_of_a_minute_are_one_row_of_the_join(spark, monkeypatch):
    """What the join keeps and meets does not grow with the departures of a minute."""
    rows = []
    deps = [("a", t, 1.0, None, None) for t in range(0, 7200, 5)]
    points = [(i, "a", 60 * i) for i in range(20, 50)]

    def drained(out):
        path, kept = streams.shared_folder(spark, "sink"), streams.shared_folder(spark, "checkpoint")
        q = out.writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(path)
        q.awaitTermination()
        rows.extend(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin")
        return spark.read.schema(out.schema).parquet(path)

    monkeypatch.setattr(streams, "drained", drained)
    assert run(spark, deps, points, grain="1 minute") == {i: found(deps, s, t) for i, s, t in points}
    assert sum(rows) < len(points) + 20 < len(deps)


def test_cutoffs_off_the_grain_are_refused(spark):
    with pytest.raises(Exception, match="a cutoff is not a whole number"):
        run(spark, [("a", 0, 1.0, None, None)], [(1, "a", 61)], grain="1 minute")
    with pytest.raises(ValueError, match="whole number"):
        run(spark, [("a", 0, 1.0, None, None)], [(1, "a", 60)], grain="7 minutes")
