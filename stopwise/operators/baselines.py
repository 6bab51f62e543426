"""Days, disruption flags and the median baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import date_split, day_type

#: Grouping keys from fine to coarse; the last is the horizon alone.
LEVELS = [["line_name", "station_id", "hour", "day_type"], ["line_name", "station_id", "hour"], ["line_name", "station_id"], ["station_id"], []]


def daily_stats(journeys: DataFrame) -> DataFrame:
    """Runs, points, delays and the share of cancelled runs of each day, over valid journeys of target operators."""
    point = F.when(F.col("is_prediction_point"), F.col("dep_delay_min"))
    return journeys.where("is_valid_journey and is_target_operator").groupBy("operating_day").agg(
        F.count_distinct("trip_key").alias("runs"), F.count_if("is_prediction_point").alias("prediction_points"), F.avg(point).alias("mean_delay_min"), F.percentile(point, 0.9).alias("p90_delay_min"),
        (F.count_distinct(F.when(F.col("is_cancelled"), F.col("trip_key"))) / F.count_distinct("trip_key")).alias("cancelled_runs_share"),
    )


def flag_disruption_days(stats: DataFrame, cfg: Config, q: float = 0.95) -> DataFrame:
    """Days whose mean z-score of delay and cancellations is above a quantile of that of training days. One row of each statistic is broadcast."""
    train = F.col("operating_day") <= F.lit(cfg.train_end).cast("date")
    cols = ["mean_delay_min", "cancelled_runs_share"]
    ref = stats.where(train).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in cols]
    scored = stats.join(F.broadcast(ref)).withColumn("disruption_score", (z[0] + z[1]) / 2)
    limit = scored.where(train).agg(F.percentile("disruption_score", q).alias("disruption_threshold"))
    return scored.join(F.broadcast(limit)).select(*stats.columns, "disruption_score", "disruption_threshold", (F.col("disruption_score") > F.col("disruption_threshold")).alias("is_disruption_day"))


def labelled(labels: DataFrame, cfg: Config) -> DataFrame:
    """Labelled points with split, hour and type of day."""
    return labels.where("label_status = 'ok'").select("*", F.hour("dep_planned").alias("hour"), day_type("operating_day").alias("day_type"), date_split("operating_day", cfg).alias("split"))


def fit_medians(lab: DataFrame, cfg: Config) -> list[DataFrame]:
    """Training medians of each level whose groups are large enough; the coarser levels come from ever fewer groups."""
    train = lab.where("split = 'train'")
    return [
        train.groupBy(*keys, "horizon_min").agg(F.count("*").alias("n"), F.median("delta_min").alias("value")).where(F.col("n") >= cfg.min_history) for keys in LEVELS
    ]


def historical_median(lab: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Each point with the median of the finest level that has one, the level's number, and the simpler baselines.

    A null key matches no group and falls through to the next level.
    """
    out = lab
    for i, (keys, table) in enumerate(zip(LEVELS, levels, strict=True)):
        out = out.join(table.withColumnRenamed("value", f"v{i}").drop("n"), [*keys, "horizon_min"], "left")
    level = F.coalesce(*[F.when(F.col(f"v{i}").isNotNull(), F.lit(i)) for i in range(len(LEVELS))])
    return out.select(
        *lab.columns, F.lit(0.0).alias("pred_persistence"), F.col(f"v{len(LEVELS) - 1}").alias("pred_offset"), F.coalesce(*[f"v{i}" for i in range(len(LEVELS))]).alias("pred_historical"), level.alias("hist_level")
    )
