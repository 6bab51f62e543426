"""Queries of the ingest: daily CSV files made of ``events``, read, checked and published again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.plans.core import trains
from stopwise.plans.oracles import oracle
from stopwise.plans.registry import query
from stopwise.sources import ingest as ig
from stopwise.sources.shared import shared_folder
from stopwise.sources.snapshots import snapshot

#: The same rows as the files hold, typed: a trip numbered 7 stands in the next day's file.
FILES = {"files": "select *, operating_day + (train_number = '7')::int as file_date, if(category = 'signup', 'Bus', 'Zug') as mode from trains"}
RAIL = FILES | {"rail": "select * from files where upper(mode) = 'ZUG'"}
READ = RAIL | {"read_": "select *, if(is_extra_trip, null, arr_planned) as arr_read, if(is_pass_through, null, station_id) as station_read from rail"}


def folder(s: SparkSession, d: str) -> str:
    """Day files of the stop records. Some hold an additional first column, and some values cannot be read."""
    path = shared_folder(s, "day-files")
    t = trains(s, d).withColumn("file_date", F.date_add("operating_day", (F.col("train_number") == "7").cast("int")))
    t = t.withColumn("transport_mode", F.when(F.col("category") == "signup", "Bus").otherwise("Zug"))
    late = F.date_format("arr_planned", "dd.MM.yyyy HH:mm:ss")  # a planned time has no seconds
    t = t.withColumn("arr_planned", F.when(F.col("is_extra_trip"), late).otherwise(F.date_format("arr_planned", "dd.MM.yyyy HH:mm")))
    t = t.withColumn("station_id", F.when(F.col("is_pass_through"), F.lit("?")).otherwise(F.col("station_id").cast("string")))
    odd = F.dayofmonth("file_date") % 5 == 0
    for part in (t.where(~odd), t.where(odd).withColumn("NOTE", F.lit("x"))):
        ig.day_files(part, path)
    return path


def raw(s: SparkSession, d: str) -> DataFrame:
    return ig.scan(s, folder(s, d))


def published(s: SparkSession, d: str) -> str:
    path = shared_folder(s, "months")
    ig.publish(ig.typed(raw(s, d)), path)
    return path


def daily(df: DataFrame) -> DataFrame:
    return df.groupBy("month", "operating_day").agg(F.count("*").alias("n"), F.count_distinct("trip_id").alias("trips"))


def replaced(s: SparkSession, d: str) -> DataFrame:
    """All months published twice, the second time with the clicks alone; a third time that fails its check changes nothing."""
    path, rows = shared_folder(s, "months"), ig.typed(raw(s, d))
    ig.publish(rows, path)
    ig.publish(rows.where("category = 'click'"), path)
    try:
        ig.publish(rows, path, expected={"1900-01": 1})
    except ValueError:
        return daily(ig.read_months(s, path, rows.schema))
    raise AssertionError("rows that differ were published")


def reconciled(s: SparkSession, d: str) -> DataFrame:
    rows = ig.typed(raw(s, d))
    given = rows.groupBy(F.date_format("operating_day", "yyyy-MM").alias("month")).agg(F.count("*").alias("given"))
    written = ig.read_months(s, published(s, d), rows.schema).groupBy("month").agg(F.count("*").alias("written"))
    return given.join(written, "month", "full").withColumn("equal", F.col("given").eqNullSafe(F.col("written")))


def clean(s: SparkSession, d: str) -> DataFrame:
    """Day files that pass validation: every row in its own day's file, all values readable."""
    path = shared_folder(s, "clean-files")
    ig.day_files(trains(s, d).withColumn("file_date", F.col("operating_day")).withColumn("transport_mode", F.lit("Zug")), path)
    return ig.scan(s, path)


def built(s: SparkSession, d: str) -> DataFrame:
    """What two builds and a forced one did with each month, and the days and rows that the last snapshot holds and records."""
    files, path = clean(s, d), shared_folder(s, "build")
    asked = ["2023-12", "2024-01", "2024-02"]
    runs = [ig.build(files, path, asked[:2], require_full_month=False), ig.build(files, path, asked, require_full_month=False), ig.build(files, path, asked[1:2], force=True, require_full_month=False)]
    rows = [(m, *(run.get(m) for run in runs)) for m in asked]
    said = s.createDataFrame(rows, "month string, first string, second string, forced string")
    records = snapshot(s, path).records
    kept = s.createDataFrame([(m, r["days"], r["train_rows"]) for m, r in records.items()], "month string, recorded_days long, recorded long")
    held = ig.read_months(s, path, ig.typed(files).schema).groupBy("month").agg(F.count_distinct("operating_day").alias("days"), F.count("*").alias("n"))
    return said.join(held, "month", "left").join(kept, "month", "left")


def report(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "report")
    ig.write_report(ig.typed(raw(s, d)).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("trip_id").alias("trips")), path)
    return s.read.schema("category string, n long, trips long").option("header", True).csv(path)


def manifest(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "manifest")
    ig.write_manifest(ig.audit(raw(s, d), "ZUG"), path)
    m = ig.read_manifest(s, path)
    return m.select("month", "days", "raw_rows", "train_rows", F.explode("by_day").alias("day", "n"))


_day = "strftime(operating_day, '%d.%m.%Y')"
query("A01_csv_scan", oracle(f"select {_day} as day, count(*) as n, count(distinct trip_id) as trips, min(strftime(dep_planned, '%d.%m.%Y %H:%M')) as first_dep, count(arr_planned) as arrivals, count_if(is_cancelled)::bigint as cancelled from files group by all", "trains", FILES))(
    lambda s, d: raw(s, d).groupBy(F.col("BETRIEBSTAG").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("FAHRT_BEZEICHNER").alias("trips"), F.min("ABFAHRTSZEIT").alias("first_dep"), F.count("ANKUNFTSZEIT").alias("arrivals"), F.count_if(F.col("FAELLT_AUS_TF") == "true").alias("cancelled"))
)
query("A02_month_scan", oracle("select strftime(file_date, '%Y-%m') as month, count(distinct file_date) as files, count(*) as n from files group by all", "trains", FILES))(
    lambda s, d: raw(s, d).groupBy(F.date_format("file_date", "yyyy-MM").alias("month")).agg(F.count_distinct("file_date").alias("files"), F.count("*").alias("n"))
)
query("A03_file_date", oracle(f"select file_date, {_day} as day, count(*) as n from files group by all", "trains", FILES))(
    lambda s, d: raw(s, d).groupBy("file_date", F.col("BETRIEBSTAG").alias("day")).agg(F.count("*").alias("n"))
)
_months = "select strftime(operating_day, '%Y-%m') as month, operating_day, count(*) as n, count(distinct trip_id) as trips from rail"
query("A05_parquet_sink", oracle(f"{_months} group by all", "trains", RAIL))(lambda s, d: daily(ig.read_months(s, published(s, d), ig.typed(raw(s, d)).schema)))
query("A06_atomic_publish", oracle(f"{_months} where category = 'click' group by all", "trains", RAIL))(replaced)
query(
    "A07_incremental_build",
    oracle(
        "with held as (select strftime(operating_day, '%Y-%m') as month, count(distinct operating_day) as days, count(*) as n from trains group by all), "
        "asked as (select * from (values ('2023-12', 1), ('2024-01', 2), ('2024-02', 3)) v(month, i)) "
        "select month, if(i = 3, null, if(days is null, 'absent', 'built')) as first, if(i < 3 and days is not null, 'skipped', if(days is null, 'absent', 'built')) as second, "
        "if(i = 2, if(days is null, 'absent', 'built'), null) as forced, days, n, days as recorded_days, n as recorded from asked left join held using (month)",
        "trains",
    ),
)(built)
query("A08_csv_report", oracle("select category, count(*) as n, count(distinct trip_id) as trips from rail group by all", "trains", RAIL))(report)
query("A09_manifest", oracle("with days as (select operating_day as day, count(*) as raw_rows, count_if(mode = 'Zug')::bigint as n from files group by all) select strftime(day, '%Y-%m') as month, count(*) over w as days, sum(raw_rows) over w::bigint as raw_rows, "
  "sum(n) over w::bigint as train_rows, day::varchar as day, n from days window w as (partition by strftime(day, '%Y-%m'))", "trains", FILES))(manifest)
query("A10_reconciliation", oracle("select strftime(operating_day, '%Y-%m') as month, count(*) as given, count(*) as written, true as equal from rail group by all", "trains", RAIL))(reconciled)
query("B03_unreadable", oracle("select * from (select 'arr_planned' as \"column\", count_if(is_extra_trip and arr_planned is not null)::bigint as n from rail union all select 'station_id', count_if(is_pass_through)::bigint from rail) where n > 0", "trains", RAIL))(lambda s, d: ig.unreadable(raw(s, d)))
query("B04_columns", oracle("select distinct file_date, if(day(file_date) % 5 = 0, 'NOTE', '') as extra_columns from files", "trains", FILES))(lambda s, d: raw(s, d).select("file_date", "extra_columns").distinct())
query("B05_validation_report", oracle(
    "with bad as (select 'unreadable' as problem, 'arr_planned' as what, count_if(is_extra_trip and arr_planned is not null)::bigint as n from rail union all select 'unreadable', 'station_id', count_if(is_pass_through)::bigint from rail), "
    "wrong as (select 'wrong day', operating_day::varchar, count(*) from rail where operating_day <> file_date group by operating_day), "
    "outside as (select 'outside month', operating_day::varchar, count(*) from rail where strftime(operating_day, '%Y-%m') <> '2024-01' group by operating_day, file_date), "
    "several as (select 'several files', operating_day::varchar, count(distinct file_date) as k from rail group by operating_day having k > 1), "
    "gone as (select 'missing day', d::date::varchar, 0 from unnest(range(timestamp '2024-01-01', timestamp '2024-02-01', interval 1 day)) t(d) where d::date not in (select operating_day from rail)) "
    "select * from bad where n > 0 union all select * from wrong union all select * from outside union all select * from several union all select * from gone", "trains", RAIL))(lambda s, d: ig.validation_report(raw(s, d), "2024-01"))
query("H01_try_strptime", oracle("select operating_day, count(*) as n, count(arr_read) as planned, min(arr_read) as first_arr, max(dep_actual) as last_dep, count(station_read) as stations from read_ group by all", "trains", READ))(
    lambda s, d: ig.typed(raw(s, d)).groupBy("operating_day").agg(
        F.count("*").alias("n"), F.count("arr_planned").alias("planned"), F.min("arr_planned").alias("first_arr"), F.max("dep_actual").alias("last_dep"), F.count("station_id").alias("stations"))
)
