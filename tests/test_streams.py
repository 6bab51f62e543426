"""Streams dealt over files, and the state of several widths from panes."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["I01_tumbling_minutes", "I02_sliding_state", "I03_late_rows"])
def test_large_parts_are_written_by_several_tasks_for_one_stream(spark, monkeypatch, name):
    from stopwise import plans
    from stopwise.plans import streams

    paths, folder = [], streams.shared_folder
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "shared_folder", lambda s, n: (paths.append(folder(s, n)), paths[-1])[1])
    got = sorted(map(tuple, plans.QUERIES[name](spark, SF).collect()))
    made = [p for p in paths if "/stream-" in p]
    assert len(made) == 1  # whatever the number of widths
    files = [f for f in os.listdir(made[0].removeprefix("file:")) if f.endswith(".parquet")]
    assert len(files) > 2 * streams.FILES + 1
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = sorted(con.execute(plans.ORACLES[name]).fetchall())
    assert len(got) == len(want) and all(g == pytest.approx(w, abs=1e-6) for g, w in zip(got, want, strict=True))


def test_a_pane_goes_to_two_windows_and_not_to_one_a_minute(spark):
    from stopwise.plans import streams
    from stopwise.streaming import replay as rp

    e = spark.range(600).select((F.col("id") % 2).cast("int").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + 61 * F.col("id")).alias("event_time"), F.lit(1.0).alias("d"))
    out = streams.drained(rp.sliding_states(streams.stream(e, "event_time"), "k", (10, 60))).where("k is not null")
    minute = F.floor(F.unix_timestamp("event_time") / 60)
    want = e.crossJoin(spark.createDataFrame([(10,), (60,)], "width int")).withColumn("minute", F.explode(F.sequence(minute + 1, minute + F.col("width")))).groupBy("width", "minute", "k").agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    got = out.select("width", F.floor(F.unix_timestamp("at") / 60).alias("minute"), "k", "n", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
