"""Journeys, labels and network windows on hand-made stops."""

from datetime import date, datetime, timedelta

import duckdb
import pytest

from stopwise.config import Config
from stopwise.operators import journeys as jn
from stopwise.operators import labels as lb
from stopwise.operators import network as nw
from stopwise.operators.calibrate import higher_quantile
from stopwise.plans.oracles import oracle
from stopwise.sources import ingest

C = Config(scope=("IC",))
DAY = datetime(2026, 4, 1)
SCHEMA = (
    "operating_day date, trip_id string, operator_abbr string, line_name string, train_number string, category string, is_extra_trip boolean, is_cancelled boolean, is_pass_through boolean, "
    "station_id int, station_name string, arr_planned timestamp_ntz, arr_actual timestamp_ntz, arr_status string, dep_planned timestamp_ntz, dep_actual timestamp_ntz, dep_status string"
)


def trip(name, stations, late=1, gap=20, **flags):
    rows = []
    for i, st in enumerate(stations):
        arr = DAY + timedelta(minutes=600 + gap * i) if i else None
        dep = DAY + timedelta(minutes=602 + gap * i) if i + 1 < len(stations) else None
        add = timedelta(minutes=late)
        rows.append((date(2026, 4, 1), name, "OP", "L1", "1", "IC", False, flags.get("cancelled") == i, False, st, f"S{st}", arr, arr and arr + add, "REAL" if arr else None, dep, dep and dep + add, "REAL" if dep else None))
    return rows


@pytest.fixture(scope="module")
def journeys(spark):
    rows = trip("a", [8500001, 8500002, 8500003, 8500004, 8500005])[::-1] + trip("b", [8000001, 8500001, 8500002]) + trip("c", [8500001, 8500001, 8500003]) + trip("d", [8500001, 8500002, 8500003], late=-9) + trip("e", [8500001, 8500002, 8500003], cancelled=1) + trip("f", [8500005, 8500001])
    t = spark.createDataFrame(rows, SCHEMA)
    return jn.reconstruct_journeys(t, jn.station_quality(t, C), C)


def test_order_country_and_validity(journeys):
    rows = {(r["trip_id"], r["stop_seq"]): r for r in journeys.collect()}
    assert [rows["a", i]["station_id"] for i in range(1, 6)] == [8500001, 8500002, 8500003, 8500004, 8500005]
    assert rows["b", 1]["station_id"] == 8500001 and rows["b", 1]["enters_from_abroad"] and ("b", 3) not in rows
    assert not rows["c", 1]["is_valid_journey"] and rows["a", 1]["is_prediction_point"]
    assert rows["d", 1]["dep_delay_min"] is None  # beyond the valid range
    assert not rows["e", 2]["is_eligible_stop"]


def test_stops_of_one_time_and_station_have_a_place_each(spark):
    rows = trip("t", [8500001, 8500002, 8500002, 8500003], gap=0)
    later = [(*r[:12], r[11] + timedelta(minutes=5), *r[13:]) if i == 1 else r for i, r in enumerate(rows)]
    for given in (later, later[::-1]):
        got = jn.journey_order(spark.createDataFrame(given, SCHEMA).repartition(3), C).where("arr_planned is not null and dep_planned is not null").orderBy("place").collect()
        assert [(r["place"], r["arr_actual"] - r["arr_planned"]) for r in got] == [(2, timedelta(minutes=1)), (3, timedelta(minutes=5))]
    # the SQL gives places from 1 without gaps or repeats, too
    con = duckdb.connect()
    con.execute("create table events as select i as event_id, timestamp '2024-01-01 10:00:00' + to_seconds(i % 2) as ts, 3 as user_id, 'view' as event_type, i * 1.0 as value from unnest([210, 213, 633, 636]) t(i)")
    found = con.execute(oracle("select place from ordered order by place", "ordered")).fetchall()
    assert found == [(i,) for i in range(1, 5)]


def test_targets_and_statuses(journeys):
    rows = {(r["trip_key"].split("|")[1], r["stop_seq"], r["horizon_min"]): r for r in lb.horizon_labels(journeys, C).collect()}
    assert [rows["a", 1, h]["target_seq"] for h in (15, 30, 60)] == [2, 3, 5]
    assert rows["a", 4, 60]["label_status"] == "terminates" and rows["e", 1, 15]["label_status"] == "cancelled"
    assert rows["a", 1, 15]["delta_min"] == 0 and rows["a", 1, 60]["in_common_subset"]


def test_station_minutes_read_events_once(spark, capsys):
    rows = [(1, "2024-01-01 10:00:30", "2024-01-01 10:02:00", 4.0, 1.0), (1, None, "2024-01-01 10:00:59", None, 2.5), (2, "2024-01-01 10:00:00", "2024-01-01 10:00:00", 5.0, None)]
    events = spark.createDataFrame(rows, "station_id int, a string, b string, arr_d double, dep_d double")
    events = events.select("*", events["a"].cast("timestamp_ntz").alias("arr_actual"), events["b"].cast("timestamp_ntz").alias("dep_actual"))
    out = nw.station_minutes(events, C)
    first = out.agg({"minute": "min"}).first()[0]
    got = {(r["station_id"], r["minute"] - first): (r["n"], r["s"], r["l"]) for r in out.collect()}
    assert got == {(1, 0): (2, 6.5, 1), (1, 2): (1, 1.0, 0), (2, 0): (1, 5.0, 1)}
    capsys.readouterr()
    nw.station_minutes(events, C).explain()  # not run yet, so one plan is shown
    assert capsys.readouterr().out.count("Scan ") == 1


def test_baselines_are_shared(spark, capsys):
    from stopwise.plans import domain

    capsys.readouterr()
    domain.prior(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "prior-" in plan and "Join" not in plan


def test_window_edges(spark):
    minutes = spark.createDataFrame([(1, m, 1, 1.0, 0) for m in (70, 71, 90, 100, 101)], "station_id int, minute long, n long, s double, l long")
    points = spark.createDataFrame([("t", 1, 15, 1, 100), ("u", 1, 15, None, 100)], "trip_key string, stop_seq long, horizon_min int, st int, m_end long")
    got = {r["trip_key"]: r for r in nw.trailing_sums(minutes, points, {"station_id": "st"}, nw.KEYS, (10, 30, 60)).collect()}
    assert (got["t"]["n_10"], got["t"]["n_30"], got["t"]["n_60"]) == (1, 3, 4) and got["u"]["n_60"] == 0


def test_higher_quantile(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)], "g string, x double")
    assert higher_quantile(df, df["x"], 0.8, ["g"]).first()["offset"] == 10.0  # level 0.9, place ceil(8.1) from 0


def test_ingest(spark, tmp_path):
    head = list(ingest.COLUMNS)
    row = dict.fromkeys(head, "") | {"BETRIEBSTAG": "01.04.2026", "FAHRT_BEZEICHNER": "x", "PRODUKT_ID": "Zug", "BPUIC": "8500001", "ABFAHRTSZEIT": "01.04.2026 6:41", "AN_PROGNOSE": "bad"}
    bus = row | {"PRODUKT_ID": "Bus"}
    (tmp_path / "2026-04-01_x.csv").write_text("\n".join([";".join(head), *(";".join(r[h] for h in head) for r in (row, bus))]))
    raw = ingest.scan(spark, str(tmp_path))
    got = ingest.typed(raw).collect()
    assert len(got) == 1 and got[0]["dep_planned"] == datetime(2026, 4, 1, 6, 41) and got[0]["arr_actual"] is None
    report = {(r["problem"], r["what"]): r["n"] for r in ingest.validation_report(raw, "2026-04").collect()}
    assert report["unreadable", "arr_actual"] == 1 and sum(k[0] == "missing day" for k in report) == 29
    with pytest.raises(ValueError):
        ingest.check_columns(head[1:])
    assert ingest.publish(ingest.typed(raw), str(tmp_path / "out")) == 1
