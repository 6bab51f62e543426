"""The latest departure before a cut-off, by brute force, and by a frame that only grows."""

import random

from stopwise.config import Config
from stopwise.operators import network as nw

C = Config()


def test_latest_departure_before_a_cut_off(spark):
    rng = random.Random(4)
    deps = [(1, rng.choice([2, 3]), rng.randrange(80_000, 95_000), float(rng.randrange(9)), None if rng.random() < 0.3 else 99_000, 1.0) for _ in range(60)]
    points = [(f"t{i}", i, 15, 1, rng.choice([2, 3, 4]), c) for i, c in enumerate([*(rng.randrange(80_000, 99_000) for _ in range(200)), *(d[2] + k for d in deps for k in (0, 1, 3599, 3600))])]
    d = spark.createDataFrame(deps, "from_station_id int, to_station_id int, dep_s long, dep_d double, arr_s long, arr_d double")
    p = spark.createDataFrame(points, "trip_key string, stop_seq int, horizon_min int, cur_station_id int, next_station_id int, cut_s long").selectExpr("*", "timestamp_seconds(cut_s)::timestamp_ntz as t_pred")
    out = nw.last_before(d, p, C)
    got = {r["trip_key"]: (r["net_ahead_headway_min"], r["net_ahead_dep_delay"]) for r in out.collect()}
    for key, _, _, a, b, cut in points:
        found = max([(x[2], x[3]) for x in deps if x[:2] == (a, b) and cut - 60 * C.ahead_max_min < x[2] < cut], default=None)
        assert got[key] == ((cut - found[0]) / 60, found[1]) if found else got[key] == (None, None)
    # a sliding frame would look at all departures of the hour again for every row
    assert "unboundedpreceding$(), currentrow$()" in out._jdf.queryExecution().analyzed().toString()
