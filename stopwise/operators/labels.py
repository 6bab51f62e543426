"""Labels: the change of delay up to the first stop scheduled at least a horizon ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import elapsed_min, plus_minutes

POINT = ["operating_day", "trip_key", "stop_seq", "station_id", "category", "line_name", "operator_abbr", "train_number", "dep_planned"]


def candidates(journeys: DataFrame) -> DataFrame:
    """Stops that can be a target, by the timetable alone."""
    return journeys.where(
        F.col("arr_planned").isNotNull() & ~F.coalesce("is_pass_through", F.lit(False)) & F.col("is_valid_station") & ~F.col("is_plan_inconsistent")
    ).select(
        "trip_key", F.col("stop_seq").alias("target_seq"), F.col("station_id").alias("target_station_id"), F.col("arr_planned").alias("target_arr_planned"),
        F.col("arr_delay_min").alias("target_delay_min"), F.coalesce("is_cancelled", F.lit(False)).alias("target_cancelled"),
    )


def horizon_labels(journeys: DataFrame, cfg: Config) -> DataFrame:
    """A row for each prediction point and horizon, with target, label and status.

    A trip's candidate stops are gathered once (a trip has a few dozen stops); the first that lies
    far enough ahead is picked within the row, so points are never joined with stops.
    """
    stops = candidates(journeys).groupBy("trip_key").agg(
        F.sort_array(F.collect_list(F.struct("target_seq", "target_station_id", "target_arr_planned", "target_delay_min", "target_cancelled"))).alias("ahead")
    )
    points = journeys.where("is_prediction_point").select(*POINT, F.col("dep_actual").alias("t_pred"), F.col("dep_delay_min").alias("d0_min"))
    points = points.join(stops, "trip_key", "left").withColumn("horizon_min", F.explode(F.array(*map(F.lit, cfg.horizons))))
    points = points.withColumn("earliest", plus_minutes("dep_planned", F.col("horizon_min")))
    first = F.get(F.filter("ahead", lambda s: (s["target_seq"] > F.col("stop_seq")) & (s["target_arr_planned"] >= F.col("earliest"))), F.lit(0))
    t = points.withColumn("t", first)
    status = (
        F.when(F.col("t").isNull(), "terminates").when(F.col("t.target_cancelled"), "cancelled").when(F.col("t.target_delay_min").isNull(), "not_measured").otherwise("ok")
    )
    t = t.withColumn("label_status", status)
    return t.select(
        *POINT, "t_pred", "d0_min", "horizon_min", "t.target_seq", "t.target_station_id", "t.target_arr_planned",
        elapsed_min("dep_planned", "t.target_arr_planned").alias("sched_gap_min"), "t.target_delay_min",
        F.when(F.col("label_status") == "ok", F.col("t.target_delay_min") - F.col("d0_min")).alias("delta_min"), "label_status",
        F.bool_and(F.col("label_status") == "ok").over(Window.partitionBy("trip_key", "stop_seq")).alias("in_common_subset"),
    )


def label_coverage(labels: DataFrame) -> DataFrame:
    return labels.groupBy("horizon_min", "label_status").agg(F.count("*").alias("n"))
