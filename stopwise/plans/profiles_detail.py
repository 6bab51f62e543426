"""Data-profiling queries by further keys: operators, stations, days, weekdays, months, splits, and single rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.functions.columns import date_split, elapsed_min, in_country
from stopwise.plans.core import journeys, labels, ordered, trains
from stopwise.plans.domain import flags, q
from stopwise.plans.oracles import SPLIT
from stopwise.plans.quality import DAYS

E: dict = {}
TRIP = ["operating_day", "trip_key"]
share = lambda c: F.round(F.avg(c.cast("int")), 6)
six = lambda c: F.round(c, 6)


q(
    "N03_foreign_operators",
    "select operator_abbr, category, count(*) as trips, count_if(touched)::bigint as with_foreign_stops, count_if(not home)::bigint as foreign_only from (select trip_id, operating_day, min(operator_abbr) as operator_abbr, "
    "min(category) as category, bool_or(station_id // 100000 = 85) as home, bool_or(station_id // 100000 <> 85) as touched from trains group by all) group by all",
    E,
    lambda s, d: trains(s, d).groupBy("operating_day", "trip_id").agg(
        F.min("operator_abbr").alias("operator_abbr"), F.min("category").alias("category"),
        F.bool_or(in_country("station_id", 85)).alias("home"), F.bool_or(~in_country("station_id", 85)).alias("touched"),
    ).groupBy("operator_abbr", "category").agg(F.count("*").alias("trips"), F.count_if("touched").alias("with_foreign_stops"), F.count_if(~F.col("home")).alias("foreign_only")),
)


def measured(s, d, *by):
    """Departures at home stations and how many of them were measured."""
    x = trains(s, d).where(in_country("station_id", 85) & F.col("dep_planned").isNotNull())
    return x.groupBy(*by).agg(F.count("*").alias("dep_events"), share(F.col("dep_status") == "REAL").alias("share_real"))


for _name, _by in (("station", "station_id"), ("day", "operating_day")):
    q(
        f"N04_measured_by_{_name}",
        f"select {_by}, count(*) as dep_events, round(avg((dep_status = 'REAL')::int), 6) as share_real from trains where station_id // 100000 = 85 and dep_planned is not null group by {_by}",
        E, lambda s, d, by=_by: measured(s, d, by),
    )


CANCELLED = {
    "runs_": "select operating_day, trip_key, bool_and(is_cancelled) as a, bool_or(is_cancelled) as b, bool_or(is_extra_trip) as x from scoped group by all",
    "daily_": "select operating_day, avg(a::int) as fully_cancelled, avg((b and not a)::int) as partially_cancelled, avg(x::int) as extra_trips from runs_ group by all",
}
KINDS = ["fully_cancelled", "partially_cancelled", "extra_trips"]
_means = ", ".join(f"round(100 * avg({c}), 6) as {c}" for c in KINDS)


def cancelled(s, d, by):
    """Means over days of the daily shares of runs that are cancelled or extra, in percent."""
    runs = ordered(s, d).groupBy(*TRIP).agg(F.bool_and("is_cancelled").alias("a"), F.bool_or("is_cancelled").alias("b"), F.bool_or("is_extra_trip").alias("x"))
    parts = {"fully_cancelled": F.col("a"), "partially_cancelled": F.col("b") & ~F.col("a"), "extra_trips": F.col("x")}
    daily = runs.groupBy("operating_day").agg(*[F.avg(c.cast("int")).alias(n) for n, c in parts.items()])
    return daily.groupBy(by).agg(*[six(100 * F.avg(c)).alias(c) for c in KINDS])


q("N07_by_weekday", f"select isodow(operating_day) as weekday, {_means} from daily_ group by all", CANCELLED, lambda s, d: cancelled(s, d, (F.weekday("operating_day") + 1).alias("weekday")))
q("N07_by_month", f"select strftime(operating_day, '%Y-%m') as month, {_means} from daily_ group by all", CANCELLED, lambda s, d: cancelled(s, d, F.date_format("operating_day", "yyyy-MM").alias("month")))

#: Delays as they were reported, before what is out of range is left out.
RAW = {"raw_": "select *, (epoch(dep_actual) - epoch(dep_planned)) / 60.0 as reported from scoped where dep_status = 'REAL' and dep_planned is not null and dep_actual is not null"}


def reported(s, d):
    return ordered(s, d).where("dep_status = 'REAL'").withColumn("reported", elapsed_min("dep_planned", "dep_actual")).where("reported is not null")


q(
    "N09_extreme_buckets",
    "select case when reported < -1440 then 'a: < -1 day' when reported < -60 then 'b: -1 day .. -1 h' when reported < -5 then 'c: -1 h .. -5 min' else 'd: > 3 h' end as bucket, count(*) as n, "
    "count(distinct operating_day) as days, round(min(reported), 6) as min_delay, round(max(reported), 6) as max_delay from raw_ where reported < -5 or reported > 180 group by all",
    RAW,
    lambda s, d: reported(s, d).where("reported < -5 or reported > 180")
    .groupBy(F.when(F.col("reported") < -1440, "a: < -1 day").when(F.col("reported") < -60, "b: -1 day .. -1 h").when(F.col("reported") < -5, "c: -1 h .. -5 min").otherwise("d: > 3 h").alias("bucket"))
    .agg(F.count("*").alias("n"), F.count_distinct("operating_day").alias("days"), six(F.min("reported")).alias("min_delay"), six(F.max("reported")).alias("max_delay")),
)
WORST = ["operating_day", "trip_key", "station_id", "category", "operator_abbr", "dep_planned", "dep_actual"]
q(
    "N09_worst_rows",
    f"select {', '.join(WORST)}, round(reported, 1) as dep_delay_min from raw_ where reported < -5 order by reported, trip_key, station_id, dep_planned limit 20",
    RAW,
    lambda s, d: reported(s, d).where("reported < -5").orderBy("reported", "trip_key", "station_id", "dep_planned").limit(20).select(*WORST, F.round("reported", 1).alias("dep_delay_min")),
)

NUMBERS_OF = {"stations": "station_id", "operators": "operator_id", "categories": "category", "train_numbers": "train_number"}
TEN = {
    "trips_": "select trip_key, count(*) as n_stops, " + ", ".join(f"count(distinct {c}) as n_{n}" for n, c in NUMBERS_OF.items())
    + ", bool_or(place = 1 and arr_planned is not null) as first_has_arr, bool_or(place = places and dep_planned is not null) as last_has_dep, "
    "count(*) filter (where dep_planned > next_arr_planned) as backwards, count(*) filter (where station_id = next_station_id) as doubled from ordered group by trip_key",
}
COUNTS = {
    "single_stop": "n_stops = 1", "repeated_station": "n_stations < n_stops", "multi_operator": "n_operators > 1", "multi_category": "n_categories > 1", "multi_train_number": "n_train_numbers > 1",
    "first_stop_has_arr": "first_has_arr", "last_stop_has_dep": "last_has_dep", "order_violation": "backwards > 0", "consecutive_duplicate": "doubled > 0",
}


def ten_checks(s, d):
    first, last = (F.col("place") == 1) & F.col("arr_planned").isNotNull(), (F.col("place") == F.col("places")) & F.col("dep_planned").isNotNull()
    trips = ordered(s, d).groupBy("trip_key").agg(
        F.count("*").alias("n_stops"), *[F.count_distinct(c).alias(f"n_{n}") for n, c in NUMBERS_OF.items()], F.bool_or(first).alias("first_has_arr"), F.bool_or(last).alias("last_has_dep"),
        F.count_if(F.col("dep_planned") > F.col("next_arr_planned")).alias("backwards"), F.count_if(F.col("station_id") == F.col("next_station_id")).alias("doubled"),
    )
    return trips.agg(F.count("*").alias("journeys"), *[F.count_if(F.expr(rule)).alias(n) for n, rule in COUNTS.items()])


q("N11_ten_checks", "select count(*) as journeys, " + ", ".join(f"count(*) filter (where {rule}) as {n}" for n, rule in COUNTS.items()) + " from trips_", TEN, ten_checks)
AHEAD = {
    "next_": "select *, lead(arr_actual) over w as next_arr_actual, lead(arr_status) over w as next_arr_status from ordered window w as (partition by trip_key order by place)",
}
ORDER = {
    "planned_order_violations": "dep_planned > next_arr_planned", "planned_dep_before_arr": "arr_planned > dep_planned",
    "actual_next_arr_before_dep": "dep_status = 'REAL' and next_arr_status = 'REAL' and next_arr_actual < dep_actual",
}


def order_by_day(s, d):
    w = Window.partitionBy("trip_key").orderBy("place")
    x = ordered(s, d).withColumns({"next_arr_actual": F.lead("arr_actual").over(w), "next_arr_status": F.lead("arr_status").over(w)})
    daily = x.groupBy("operating_day").agg(*[F.count_if(F.expr(rule)).alias(n) for n, rule in ORDER.items()])
    return daily.withColumn("total", sum((F.col(n) for n in ORDER), F.lit(0)))


q(
    "N11_order_by_day",
    f"select *, {' + '.join(ORDER)} as total from (select operating_day, " + ", ".join(f"count(*) filter (where {rule}) as {n}" for n, rule in ORDER.items()) + " from next_ group by all)",
    AHEAD, order_by_day,
)
q(
    "N12_past_midnight",
    "select count(*) as trips, round(avg((last::date > operating_day)::int), 6) as share_past_midnight from (select trip_key, operating_day, max(coalesce(dep_planned, arr_planned)) as last from journeys group by all)",
    E,
    lambda s, d: journeys(s, d).groupBy(*TRIP).agg(F.max(F.coalesce("dep_planned", "arr_planned")).alias("last"))
    .agg(F.count("*").alias("trips"), share(F.to_date("last") > F.col("operating_day")).alias("share_past_midnight")),
)
TRACE = ["trip_key", "stop_seq", "station_name", "line_name", "arr_planned", "arr_actual", "arr_status", "dep_planned", "dep_actual", "dep_status", "is_cancelled"]


def trace(s, d):
    """All stops of one long journey: of those with most stops the first by key. The key is one row."""
    j = journeys(s, d)
    one = j.select("n_stops", "trip_key").orderBy(F.desc("n_stops"), "trip_key").limit(1).select("trip_key")
    return j.join(F.broadcast(one), "trip_key", "left_semi").select(*TRACE, six("arr_delay_min").alias("arr_delay_min"), six("dep_delay_min").alias("dep_delay_min"))


q(
    "N12_trace",
    f"select {', '.join(TRACE)}, round(arr_delay_min, 6) as arr_delay_min, round(dep_delay_min, 6) as dep_delay_min from journeys where trip_key = (select trip_key from journeys order by n_stops desc, trip_key limit 1)",
    E, trace,
)

DATED = {"lsplit": f"select *, {SPLIT.format('operating_day')} as split from labels_"}


def dated(s, d):
    return labels(s, d).withColumn("split", date_split("operating_day", C))


q(
    "N14_coverage_by_split", "select split, horizon_min, count(*) as n, round(avg((label_status = 'ok')::int), 6) as share_labelled from lsplit group by all", DATED,
    lambda s, d: dated(s, d).groupBy("split", "horizon_min").agg(F.count("*").alias("n"), share(F.col("label_status") == "ok").alias("share_labelled")),
)
q(
    "N14_common_subset",
    "select split, category, count(*) as points, count_if(in_common_subset)::bigint as common_points, round(avg(in_common_subset::int), 6) as share_common from lsplit where horizon_min = 15 group by all", DATED,
    lambda s, d: dated(s, d).where("horizon_min = 15").groupBy("split", "category")
    .agg(F.count("*").alias("points"), F.count_if("in_common_subset").alias("common_points"), share(F.col("in_common_subset")).alias("share_common")),
)
q(
    "N14_subset_bias",
    "select in_common_subset, count(*) as points, round(avg(d0_min), 6) as mean_d0, round(median(d0_min), 6) as median_d0, round(avg((d0_min > 3)::int), 6) as share_d0_over_3min, "
    "round(avg((category in ('click', 'view'))::int), 6) as share_long_distance from labels_ where horizon_min = 15 group by all", E,
    lambda s, d: labels(s, d).where("horizon_min = 15").groupBy("in_common_subset").agg(
        F.count("*").alias("points"), six(F.avg("d0_min")).alias("mean_d0"), six(F.median("d0_min")).alias("median_d0"), share(F.col("d0_min") > 3).alias("share_d0_over_3min"),
        share(F.col("category").isin("click", "view")).alias("share_long_distance"),
    ),
)
q(
    "N15_persistence_by_split",
    "select split, horizon_min, count(*) as n, round(avg(abs(delta_min)), 6) as persistence_mae, round(quantile_cont(abs(delta_min), 0.9), 6) as persistence_p90 from lsplit where in_common_subset group by all", DATED,
    lambda s, d: dated(s, d).where("in_common_subset").groupBy("split", "horizon_min")
    .agg(F.count("*").alias("n"), six(F.avg(F.abs("delta_min"))).alias("persistence_mae"), six(F.percentile(F.abs("delta_min"), 0.9)).alias("persistence_p90")),
)
q(
    "N16_by_split",
    f"select {SPLIT.format('operating_day')} as split, count_if(is_disruption_day)::bigint as flagged, count(*) as days, round(avg(is_disruption_day::int), 6) as share from flags group by 1", DAYS,
    lambda s, d: flags(s, d).groupBy(date_split("operating_day", C).alias("split"))
    .agg(F.count_if("is_disruption_day").alias("flagged"), F.count("is_disruption_day").alias("days"), share(F.col("is_disruption_day")).alias("share")),
)
