"""Snapshots, the incremental build and the replay's state under injected faults."""

import pytest
from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.functions.columns import date_split
from stopwise.operators.calibrate import offsets_of
from stopwise.operators.journeys import with_trip
from stopwise.sources import ingest as ig
from stopwise.sources import snapshots as sn
from stopwise.streaming import replay as rp

STOPS = "operating_day date, trip_id string, category string, arr_planned string, dep_planned string"


def stops(spark, days, per_day=3):
    return spark.createDataFrame([(d, f"t{i}", "IC", None, None) for d in days for i in range(per_day)], "d string, trip_id string, category string, arr_planned string, dep_planned string").withColumn("operating_day", F.col("d").cast("date")).select(*[c.split()[0] for c in STOPS.split(", ")])


class Fault(Exception):
    pass


@pytest.mark.parametrize("fault", range(6))
def test_a_fault_anywhere_leaves_the_old_snapshot(spark, tmp_path, monkeypatch, fault):
    """Every file operation of a publish is made to fail in turn; what was there is read as it was, by old and new readers."""
    root = f"{tmp_path}/months"
    old = stops(spark, ["2024-01-01", "2024-02-01"])
    ig.publish(old, root)
    new = stops(spark, ["2024-01-01", "2024-02-01", "2024-02-02"], per_day=5)
    done = []

    def step(f):
        def run(*a, **k):
            if len(done) == fault:
                raise Fault
            done.append(1)
            return f(*a, **k)

        return run

    class Files:
        """The file system, whose operations may fail."""

        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            f = getattr(self.files, name)
            return step(f) if name in ("mkdirs", "create", "rename") else f

    files = sn._files
    monkeypatch.setattr(sn, "_files", lambda s, p: Files(files(s, p)))
    check = sn.commit
    monkeypatch.setattr(sn, "commit", step(check))
    try:
        ig.publish(new, root)
        failed = False
    except Fault:
        failed = True
    monkeypatch.undo()
    n = {r["month"]: r["count"] for r in ig.read_months(spark, root, old.schema).groupBy("month").count().collect()}
    assert n == ({"2024-01": 3, "2024-02": 3} if failed else {"2024-01": 5, "2024-02": 10})
    assert failed == (fault < 4)
    assert ig.publish(new, root) == 15  # a later run is not held up by what is left
    assert sn.read(spark, root, old.schema, version=1).count() == 6 and sn.versions(spark, root)[-1] == (2 if failed else 3)
    assert sn.vacuum(spark, root) >= 1 and ig.read_months(spark, root, old.schema).count() == 15


def test_a_month_without_rows_goes_and_writers_do_not_mix(spark, tmp_path):
    root = f"{tmp_path}/t"
    ig.publish(stops(spark, ["2024-01-01", "2024-02-01"]), root)
    ig.publish(stops(spark, ["2024-03-01"]), root, months=["2024-02", "2024-03"])
    assert sorted(sn.snapshot(spark, root).parts) == ["2024-01", "2024-03"]
    with pytest.raises(OSError):
        sn.commit(spark, root, {}, {}, base=1)
    with pytest.raises(ValueError):
        ig.publish(stops(spark, ["2024-05-01"]), root, {"2024-05": 99})
    assert sorted(sn.snapshot(spark, root).parts) == ["2024-01", "2024-03"]


def day_folder(spark, path, days, extra=None):
    t = stops(spark, days).withColumn("file_date", F.col("operating_day")).withColumn("transport_mode", F.lit("Zug"))
    t = t.withColumn("arr_planned", F.lit("01.01.2024 10:00")).withColumn("dep_planned", F.lit("01.01.2024 10:01"))
    ig.day_files((t if extra is None else t.withColumn("NOTE", F.lit(extra))).coalesce(1), path)


def test_build_skips_forces_and_records(spark, tmp_path):
    raw, root = f"{tmp_path}/raw", f"{tmp_path}/out"
    january = [f"2024-01-{d:02d}" for d in range(1, 32)]
    day_folder(spark, raw, [*january, "2024-02-01"])
    assert ig.build(ig.scan(spark, raw), root, ["2024-01", "2023-12"]) == {"2024-01": "built", "2023-12": "absent"}
    held = sn.snapshot(spark, root)
    assert held.records["2024-01"]["days"] == 31 and held.records["2024-01"]["train_rows"] == 93 and len(held.records["2024-01"]["by_day"]) == 31
    assert ig.build(ig.scan(spark, raw), root, ["2024-01"]) == {"2024-01": "skipped"} and sn.snapshot(spark, root).version == held.version
    assert ig.build(ig.scan(spark, raw), root, ["2024-01"], force=True) == {"2024-01": "built"} and sn.snapshot(spark, root).version == held.version + 1
    with pytest.raises(ValueError, match="missing day"):
        ig.build(ig.scan(spark, raw), root, ["2024-02"])
    assert sorted(sn.snapshot(spark, root).parts) == ["2024-01"]
    assert ig.build(ig.scan(spark, raw), root, ["2024-02"], require_full_month=False) == {"2024-02": "built"}


def test_headers_in_a_fixed_number_of_jobs(spark, tmp_path):
    """Twice the files take as many jobs; columns of one header are found together."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    counts = []
    for n in (4, 24):
        path = f"{tmp_path}/{n}"
        days = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in range(n)]
        day_folder(spark, path, days[: n // 2])
        day_folder(spark, path, days[n // 2 :], extra="x")
        before = jobs()
        spark.sparkContext.setJobGroup("headers", "headers")
        try:
            found = ig.headers(spark, path)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts.append(jobs() - before)
        assert len(found) == 2 and sum(map(len, found.values())) == n
    assert counts[0] == counts[1] > 0


def replayed(spark, tmp_path, name, days, monkeypatch=None, at=None):
    root, source = f"{tmp_path}/{name}", f"{tmp_path}/{name}-days"
    schema = days.schema
    for r in days.select("operating_day").distinct().orderBy("operating_day").collect():
        days.where(F.col("operating_day") == F.lit(r[0])).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def score(x, offsets):
        known = x.withColumn("d0_bucket", F.lit("<1")).join(F.broadcast(offsets.drop("operating_day")), ["horizon_min", "d0_bucket"], "left")
        return known.select("operating_day", "horizon_min", "offset")

    go = lambda: rp.daily_replay(stream, root, f"{root}-cp", score, C, window=3, least=2, min_points=5)
    if at is not None:
        calls, write = [], sn.commit

        def failing(*a, **k):
            calls.append(1)
            if len(calls) == at[0] and at[1] == "before":
                raise Fault
            out = write(*a, **k)
            if len(calls) == at[0]:
                raise Fault
            return out

        monkeypatch.setattr(sn, "commit", failing)
        try:
            go().awaitTermination()
        except Exception:  # the batch was killed
            pass
        monkeypatch.undo()
    go().awaitTermination()
    scores = sorted(map(tuple, rp.replay_table(spark, root, rp.SCORES, "operating_day date, horizon_min int, offset double").collect()), key=str)
    return scores, rp.days_of(sn.snapshot(spark, root), rp.STATE)


def test_a_batch_that_is_killed_and_run_again(spark, tmp_path, monkeypatch):
    rows = [(15, 0.5, float(i % 7) + d, 0.0, 1.0, f"2024-01-0{d}") for d in range(1, 7) for i in range(20)]
    days = spark.createDataFrame(rows, "horizon_min int, d0_min double, y double, q10 double, q90 double, day string").withColumn("operating_day", F.col("day").cast("date")).drop("day")
    want = replayed(spark, tmp_path, "plain", days)
    assert want[1] == ["2024-01-04", "2024-01-05", "2024-01-06"]
    by_day = {str(r[0]): r[2] for r in want[0]}
    for d in range(1, 7):
        past = days.where((F.dayofmonth("operating_day") < d) & (F.dayofmonth("operating_day") >= d - 3))
        found = offsets_of(past, "y", "q10", "q90", C, 2, 5).where("d0_bucket = '<1'").first()
        assert by_day[f"2024-01-0{d}"] == (found["offset"] if found else None)
    for at in ((4, "before"), (4, "after")):
        assert replayed(spark, tmp_path, f"killed-{at[1]}", days, monkeypatch, at) == want


def test_dates_outside_the_period(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2023-12-31",)], "d string").withColumn("d", F.col("d").cast("date"))
    assert df.where("d > '2024-01-01'").select(date_split("d", C, strict=True)).first()[0] == "train"
    with pytest.raises(Exception, match="outside the study period"):
        df.select(date_split("d", C, strict=True)).collect()
    with pytest.raises(Exception, match="outside the study period"):
        spark.sql("select cast(null as date) as d").select(date_split("d", C, strict=True)).collect()


def test_home_stops_without_a_time(spark):
    rows = [("a", 1, 2, 8000001, False, None, "2024-01-01 10:00"), ("a", 2, 2, 8500001, True, None, None), ("b", 1, 2, 8000001, False, None, "2024-01-01 10:00"), ("b", 2, 2, 8500001, True, "2024-01-01 11:00", None)]
    df = spark.createDataFrame(rows, "trip_key string, place int, places int, station_id int, is_home boolean, a string, d string")
    df = df.select("*", F.col("a").cast("timestamp_ntz").alias("arr_planned"), F.col("d").cast("timestamp_ntz").alias("dep_planned"), F.lit("OP").alias("operator_abbr"), F.lit(None).cast("int").alias("next_station_id"), F.lit(None).cast("timestamp_ntz").alias("next_arr_planned"))
    got = {r["trip_key"]: r["enters_from_abroad"] for r in with_trip(df).select("trip_key", "enters_from_abroad").distinct().collect()}
    assert got == {"a": False, "b": True}


def test_shared_tables_follow_their_input(spark, tmp_path):
    from stopwise.plans.core import shared

    d = str(tmp_path / "sf")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "x")
    rows(5).write.parquet(f"{d}/events.parquet")
    make = lambda: spark.read.parquet(f"{d}/events.parquet")
    assert shared(spark, d, "t", make).count() == 5 and shared(spark, d, "t", make).count() == 5
    rows(9).write.mode("overwrite").parquet(f"{d}/events.parquet")
    spark.catalog.refreshByPath(f"{d}/events.parquet")
    assert shared(spark, d, "t", make).count() == 9
