"""Queries of stop records, journeys and labels."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from stopwise.config import EVENTS as C
from stopwise.operators import journeys as jn
from stopwise.operators import labels as lb
from stopwise.plans.oracles import oracle
from stopwise.plans.registry import query
from stopwise.sources.fixture import stops
from stopwise.sources.shared import present, shared_folder, stored


#: Tables that queries of one session share, written once: by application, folder, state of the input and name.
_tables: dict[tuple, tuple[str, DataFrame]] = {}


def source_state(spark: SparkSession, d: str) -> tuple[str, str]:
    """The folder and a digest of its input's file names, lengths and times: another one when the data has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [files.getFileStatus(at)]
    if found[0].isDirectory():
        found = list(files.listStatus(at))
    said = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in found)
    return d, hashlib.sha256("\n".join(said).encode()).hexdigest()


def shared(spark: SparkSession, d: str, name: str, make, by: tuple[str, ...] = ()) -> DataFrame:
    """The table ``make()``, written to the shared folder the first time, or if it has been cleared or the input has changed, and read from there."""
    key = (spark.sparkContext.applicationId, *source_state(spark, d), name)
    if key not in _tables or not present(spark, f"{_tables[key][0]}/_SUCCESS"):
        path = shared_folder(spark, name)
        _tables[key] = path, stored(make(), path=path, by=by)
    return _tables[key][1]


def trains(spark: SparkSession, d: str) -> DataFrame:
    return stops(spark, d)


def quality(spark: SparkSession, d: str) -> DataFrame:
    return jn.station_quality(trains(spark, d), C)


def reconstructed(spark: SparkSession, d: str) -> DataFrame:
    return jn.reconstruct_journeys(trains(spark, d), quality(spark, d), C)


def journeys(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "journeys", lambda: reconstructed(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return lb.horizon_labels(journeys(spark, d), C)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, "labels", lambda: labelled(spark, d))


def ordered(spark: SparkSession, d: str) -> DataFrame:
    return jn.journey_order(trains(spark, d), C)


query("B01_trains", oracle("select * from trains", "trains"))(trains)
query("K01_station_quality", oracle("select * from quality", "quality"))(quality)
query("K02_journey_order", oracle("select trip_key, place, places, station_id, next_station_id, next_arr_planned from ordered", "ordered"))(
    lambda s, d: ordered(s, d).select("trip_key", "place", "places", "station_id", "next_station_id", "next_arr_planned")
)
query("K03_journey_checks", oracle("select * from checks", "checks"))(lambda s, d: jn.journey_checks(ordered(s, d)))
query("K04_enters_from_abroad", oracle("select trip_key, enters_from_abroad from checks", "checks"))(lambda s, d: jn.journey_checks(ordered(s, d)).select("trip_key", "enters_from_abroad"))
query("K05_reconstruct_journeys", oracle("select * from journeys", "journeys"))(reconstructed)
query("K06_horizon_labels", oracle("select * from labels_", "labels_"))(labelled)
query("K07_label_coverage", oracle("select horizon_min, label_status, count(*) as n from labels_ group by all", "labels_"))(lambda s, d: lb.label_coverage(labels(s, d)))
query(
    "A12_journey_summary",
    oracle(
        "select count(*) as n_rows, count(distinct trip_key) as journeys, count_if(is_eligible_stop)::bigint as eligible_stops, count_if(is_prediction_point)::bigint as prediction_points, "
        "count(distinct if(is_valid_journey, null, trip_key)) as invalid_journeys from journeys", "journeys",
    ),
)(lambda s, d: jn.journey_summary(journeys(s, d)))
