"""What happens after a point's cut-off changes nothing that is known at the point, and publishing is all or nothing."""

import datetime

import pytest
from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.operators import graph as gr
from stopwise.operators import journeys as jn
from stopwise.operators import labels as lb
from stopwise.operators import network as nw
from stopwise.sources import ingest as ig
from stopwise.sources.fixture import stops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trains(spark):
    return stops(spark, SF).persist()


def tables(trains):
    j = jn.reconstruct_journeys(trains, jn.station_quality(trains, C), C)
    return j, nw.prediction_points(j, lb.horizon_labels(j, C), C)


def test_later_events_change_no_network_feature(spark, trains):
    j, p = tables(trains)
    one = p.orderBy(F.desc("m_end"), "trip_key", "stop_seq").limit(200).agg(F.min("cut_s")).first()[0]
    points = p.where(F.col("cut_s") <= one).orderBy(F.desc("cut_s"), "trip_key", "stop_seq", "horizon_min").limit(60).persist()
    after = F.lit(datetime.datetime.fromtimestamp(one, datetime.UTC).replace(tzinfo=None)).cast("timestamp_ntz")
    # whatever is measured after the last cut-off comes five minutes later than it did
    moved = trains
    for k in ("arr", "dep"):
        later = F.col(f"{k}_actual") >= after
        moved = moved.withColumn(f"{k}_actual", F.when(later, F.col(f"{k}_actual") + F.expr("interval 5 minutes")).otherwise(F.col(f"{k}_actual")))

    def features(t):
        e = nw.network_events(t, C)
        dep = nw.segment_departures(e)
        out = nw.features_of(nw.station_minutes(e, C), nw.segment_minutes(dep), dep, points, j, C)
        return sorted(map(str, out.select(*[F.round(c, 9).alias(c) if d == "double" else c for c, d in out.dtypes]).collect()))

    a, b = features(trains), features(moved)
    assert len(a) == 60 and a == b


def test_node_features_see_no_later_minute(spark, trains):
    j, p = tables(trains)
    points = p.where("horizon_min = 15").orderBy("m_end", "trip_key").limit(40).persist()
    edges = gr.static_edges(jn.journey_order(trains, C), C)
    nodes = gr.subgraph_nodes(points, j, edges, gr.static_stations(jn.journey_order(trains, C)), C).persist()
    minutes = nw.station_minutes(nw.network_events(trains, C), C)
    last = points.agg(F.max("m_end")).first()[0]
    said = lambda m: sorted(map(str, gr.node_features(nodes, points, m).select(*gr.POINT, "pos", *[F.round(c, 9) for c in gr.NODE_FEATURES]).collect()))
    later = minutes.withColumn("s", F.when(F.col("minute") > last, F.col("s") + 100).otherwise(F.col("s")))
    assert said(minutes) == said(later)


def test_hops_of_a_known_graph(spark):
    nodes = spark.createDataFrame([("t", 1, i) for i in range(10)], "trip_key string, stop_seq long, pos int")
    edges = spark.createDataFrame([("t", 1, i, i + 1) for i in range(8)], "trip_key string, stop_seq long, from_pos int, to_pos int")
    got = {(r["from_pos"], r["to_pos"]): r["hops"] for r in gr.hop_distances(nodes, edges).collect()}
    assert len(got) == 100
    assert all(h == (0 if a == b else 7 if 9 in (a, b) else min(7, abs(a - b))) for (a, b), h in got.items())


def test_a_failed_publish_leaves_what_was_there(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(datetime.date(2024, m, 1), f"t{i}") for m in (1, 2) for i in range(n)], "operating_day date, trip_id string")
    path = f"{tmp_path}/months"
    assert ig.publish(rows(3), path) == 6
    with pytest.raises(ValueError):
        ig.publish(rows(5), path, {"2024-01": 4, "2024-02": 5})
    held = lambda: ig.read_months(spark, path, rows(1).schema)
    assert held().count() == 6
    assert ig.publish(rows(5).where("month(operating_day) = 2"), path) == 5
    assert {r["month"]: r["count"] for r in held().groupBy("month").count().collect()} == {"2024-01": 3, "2024-02": 5}


def test_files_of_other_column_order_lose_no_row(spark, tmp_path):
    names = list(ig.COLUMNS)
    line = {c: "" for c in names} | {"BETRIEBSTAG": "01.02.2024", "PRODUKT_ID": "Zug", "BPUIC": "8500001", "FAHRT_BEZEICHNER": "a"}
    for day, order in (("2024-02-01", names), ("2024-02-02", ["NEW", *reversed(names)])):
        text = ";".join(order) + "\n" + ";".join((line | {"NEW": "x"})[c] for c in order) + "\n"
        (tmp_path / f"{day}_stops.csv").write_text(text)
    rows = ig.typed(ig.scan(spark, str(tmp_path))).collect()
    assert [(r["station_id"], r["trip_id"]) for r in rows] == [(8500001, "a")] * 2 and {str(r["file_date"]) for r in rows} == {"2024-02-01", "2024-02-02"}
    (tmp_path / "2024-02-03_stops.csv").write_text("A;B\n1;2\n")
    with pytest.raises(ValueError):
        ig.scan(spark, str(tmp_path))
