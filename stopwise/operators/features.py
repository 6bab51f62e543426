"""A train's own features: references, slack, history, timetable and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import date_split, day_type, elapsed_min, iso_weekday, ratio

def by_stop():
    """The stops of a trip in order."""
    return Window.partitionBy("trip_key").orderBy("stop_seq")



def _train_days(df: DataFrame, cfg: Config) -> DataFrame:
    return df.where(F.col("operating_day") <= F.lit(cfg.train_end).cast("date"))


def segment_reference(journeys: DataFrame, cfg: Config) -> DataFrame:
    """Fast running time and median planned time of each pair of neighbouring stations, on training days."""
    s = _train_days(journeys, cfg).select(
        F.col("station_id").alias("from_station_id"), F.lead("station_id").over(by_stop()).alias("to_station_id"),
        elapsed_min("dep_planned", F.lead("arr_planned").over(by_stop())).alias("plan"), (F.lead("arr_delay_min").over(by_stop()) - F.col("dep_delay_min")).alias("gain"),
    ).where("to_station_id is not null and plan is not null and gain is not null")
    return s.groupBy("from_station_id", "to_station_id").agg(
        F.count("*").alias("n"), F.median("plan").alias("planned_run_median_min"), F.percentile(F.col("plan") + F.col("gain"), cfg.reference_quantile).alias("run_ref_min")
    ).where(F.col("n") >= cfg.min_segment)


def dwell_reference(journeys: DataFrame, cfg: Config) -> DataFrame:
    """Short dwell time of each station and category, on training days."""
    s = _train_days(journeys, cfg).where(F.col("arr_planned").isNotNull() & F.col("dep_planned").isNotNull() & ~F.coalesce("is_pass_through", F.lit(False)))
    s = s.select("station_id", "category", (elapsed_min("arr_planned", "dep_planned") + F.col("dep_delay_min") - F.col("arr_delay_min")).alias("real")).where("real is not null")
    return s.groupBy("station_id", "category").agg(F.count("*").alias("n"), F.percentile("real", cfg.reference_quantile).alias("dwell_ref_min")).where(F.col("n") >= cfg.min_segment)


def stop_states(journeys: DataFrame, segments: DataFrame, dwells: DataFrame) -> DataFrame:
    """Each stop with its reserves, their sums before it, and what was seen before it. One shuffle by trip."""
    trip = Window.partitionBy("trip_key")
    before = by_stop().rowsBetween(Window.unboundedPreceding, -1)
    s = journeys.select(
        "trip_key", "stop_seq", "n_stops", "station_id", "category", "arr_delay_min", "dep_delay_min", "dep_planned", "enters_from_abroad", "is_extra_trip", "operator_abbr", "operating_day",
        F.lead("station_id").over(by_stop()).alias("next_station_id"), elapsed_min("dep_planned", F.lead("arr_planned").over(by_stop())).alias("planned_run_min"),
        elapsed_min("arr_planned", "dep_planned").alias("planned_dwell_min"),
    )
    run = segments.select(F.col("from_station_id").alias("station_id"), F.col("to_station_id").alias("next_station_id"), "run_ref_min")
    s = s.join(F.broadcast(run), ["station_id", "next_station_id"], "left").join(F.broadcast(dwells.select("station_id", "category", "dwell_ref_min")), ["station_id", "category"], "left")
    s = s.withColumn("run_reserve", F.col("planned_run_min") - F.col("run_ref_min")).withColumn("dwell_reserve", F.col("planned_dwell_min") - F.col("dwell_ref_min"))
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0.0))).over(before), F.lit(0.0))
    return s.select(
        "*", total("run_reserve").alias("run_before"), total("dwell_reserve").alias("dwell_before"), *[F.lag("dep_delay_min", k).over(by_stop()).alias(f"lag{k}") for k in (1, 3, 5)],
        *[elapsed_min(F.lag("dep_planned", k).over(by_stop()), "dep_planned").alias(f"gap{k}") for k in (3, 5)], F.max("dep_delay_min").over(before).alias("max_prev_delay_min"),
        F.count("dep_delay_min").over(before).alias("n_observed_prev"), elapsed_min(F.min("dep_planned").over(trip), "dep_planned").alias("minutes_since_origin"),
    )


def train_features(labels: DataFrame, states: DataFrame, priors: DataFrame | None, cfg: Config) -> DataFrame:
    """All own features of labelled points. ``priors`` may bring pred_historical and is_disruption_day by point."""
    l = labels.where("label_status = 'ok'").alias("l")
    target = states.select("trip_key", F.col("stop_seq").alias("target_seq"), F.col("run_before").alias("t_run"), F.col("dwell_before").alias("t_dwell"))
    now = states.drop("station_id", "category", "dep_planned", "operator_abbr", "operating_day")
    x = l.join(now, ["trip_key", "stop_seq"]).join(target, ["trip_key", "target_seq"])
    if priors is not None:
        x = x.join(priors.select("trip_key", "stop_seq", "horizon_min", "pred_historical", "is_disruption_day"), ["trip_key", "stop_seq", "horizon_min"], "left")
    else:
        x = x.withColumn("pred_historical", F.lit(None).cast("double")).withColumn("is_disruption_day", F.lit(False))
    run = F.col("t_run") - F.col("run_before")
    dwell = F.col("t_dwell") - F.col("dwell_before") - F.coalesce("dwell_reserve", F.lit(0.0))
    d0 = F.col("d0_min")
    return x.select(
        "operating_day", "trip_key", "stop_seq", "horizon_min", date_split("operating_day", cfg).alias("split"), "delta_min", "in_common_subset", "pred_historical",
        F.coalesce("is_disruption_day", F.lit(False)).alias("is_disruption_day"), "line_name", "station_id", "target_seq", "d0_min", F.col("arr_delay_min").alias("arr_delay_now_min"),
        (F.col("dep_delay_min") - F.col("arr_delay_min")).alias("dwell_excess_now_min"),
        *[c for k in (1, 3, 5) for c in (F.col(f"lag{k}").alias(f"delay_lag{k}_min"), (d0 - F.col(f"lag{k}")).alias(f"delta_last{k}_min"))],
        *[ratio(10 * (d0 - F.col(f"lag{k}")), f"gap{k}").alias(f"trend{k}_per10min") for k in (3, 5)], "max_prev_delay_min", "n_observed_prev",
        (run + dwell).alias("slack_to_target_min"), run.alias("run_reserve_to_target_min"), dwell.alias("dwell_reserve_to_target_min"), "sched_gap_min",
        (F.col("target_seq") - F.col("stop_seq")).alias("n_stops_to_target"), (F.col("n_stops") - F.col("stop_seq")).alias("stops_remaining"), (F.col("stop_seq") / F.col("n_stops")).alias("frac_journey"),
        "minutes_since_origin", F.col("planned_dwell_min").alias("planned_dwell_now_min"), F.hour("dep_planned").alias("hour"), iso_weekday("operating_day").alias("weekday"),
        day_type("operating_day").alias("day_type"), "category", "operator_abbr", "enters_from_abroad", F.coalesce("is_extra_trip", F.lit(False)).alias("is_extra_trip"),
    )
