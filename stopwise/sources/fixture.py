"""The ``events`` table read as stop records, for the registered queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.functions.columns import plus_minutes

LINES = {"click": 0, "view": 1, "purchase": 2, "error": 3, "signup": 4}


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop records (``trains``) made of events: a trip is a user group's events of one type on a day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    line = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in LINES.items()])
    e = e.select(
        "*", F.to_date("ts").alias("operating_day"), F.floor(F.col("user_id") / 30).cast("int").alias("grp"), line.alias("line"),
        (F.lit(360) + F.floor(seconds / 480)).cast("int").alias("pm"), (100 * F.col("value")).cast("long").alias("cents"),
    ).withColumn("trip_id", F.concat("event_type", F.lit("-"), F.col("grp").cast("string")))
    trip = Window.partitionBy("operating_day", "trip_id")
    e = e.withColumn("rn", F.row_number().over(trip.orderBy("pm", "event_id"))).withColumn("n", F.count("*").over(trip))
    x = (7 * F.col("line") + F.col("rn") - F.when(F.col("event_id") % 211 == 0, 1).otherwise(0)) % 60
    day = F.col("operating_day").cast("timestamp_ntz")
    arr = F.when(F.col("rn") > 1, plus_minutes(day, F.col("pm")))
    dep = F.when(F.col("rn") < F.col("n"), plus_minutes(day, F.col("pm") + (F.col("event_id") % 3).cast("int")))
    late_arr = (F.col("cents") % 720 - 60).cast("int")
    late_dep = F.when(F.col("event_id") % 997 == 0, F.lit(-900)).otherwise((F.col("cents") % 660 - 40).cast("int"))
    mod = lambda k: F.col("event_id") % k == 0
    abbr = F.concat(F.lit("OP"), (F.col("grp") % 7).cast("string"))
    out = e.withColumn("x", x).withColumn("arr_planned", arr).withColumn("dep_planned", dep)
    return out.select(
        "operating_day", "trip_id", abbr.alias("operator_id"), abbr.alias("operator_abbr"), F.concat(F.lit("Operator "), F.col("grp") % 7).alias("operator_name"),
        F.lit("ZUG").alias("transport_mode"), F.col("grp").cast("string").alias("train_number"),
        F.concat("event_type", F.lit("-"), F.col("grp") % 3).alias("line_name"), F.lit(None).cast("string").alias("rotation_id"), F.col("event_type").alias("category"),
        mod(53).alias("is_extra_trip"), mod(41).alias("is_cancelled"), mod(37).alias("is_pass_through"),
        F.when(F.col("x") < 55, 8500000 + F.col("x")).otherwise(8000000 + F.col("x")).cast("int").alias("station_id"), F.concat(F.lit("S"), F.col("x").cast("string")).alias("station_name"),
        "arr_planned", (F.col("arr_planned") + F.make_dt_interval(secs=late_arr)).alias("arr_actual"),
        F.when(F.col("arr_planned").isNotNull(), F.when(mod(23), "PROGNOSE").otherwise("REAL")).alias("arr_status"),
        "dep_planned", (F.col("dep_planned") + F.make_dt_interval(secs=late_dep)).alias("dep_actual"),
        F.when(F.col("dep_planned").isNotNull(), F.when(mod(29), "UNBEKANNT").otherwise("REAL")).alias("dep_status"),
    )
