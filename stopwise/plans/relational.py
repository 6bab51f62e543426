"""Queries of filters, joins, aggregates, windows, sorting, reshaping and scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.functions import columns as fc
from stopwise.operators import journeys as jn
from stopwise.operators import labels as lb
from stopwise.operators import relational as rel
from stopwise.plans.core import journeys, labels, ordered, quality, trains
from stopwise.plans.oracles import DAYTYPE, HOME, SPLIT, oracle
from stopwise.plans.registry import query


def q(name: str, sql: str, upto: str | None, f) -> None:
    query(name, oracle(sql, upto))(f)


T, J, L = "trains", "journeys", "labels_"


def by_stop():
    """The stops of a trip in order."""
    return Window.partitionBy("trip_key").orderBy("stop_seq")


# B: projections, filters, predicates
q("B02_mode_filter", "select count(*) as n from trains where upper(transport_mode) = 'ZUG'", T, lambda s, d: trains(s, d).where(F.upper("transport_mode") == "ZUG").agg(F.count("*").alias("n")))
q("B06_scope_filter", "select operating_day, trip_id, category, station_id from trains where category in ('click', 'view', 'purchase', 'error')", T,
  lambda s, d: jn.in_scope(trains(s, d), C).select("operating_day", "trip_id", "category", "station_id"))
q("B07_home_predicate", f"select station_id, {HOME} as is_home, count(*) as n from trains group by all", T,
  lambda s, d: trains(s, d).groupBy("station_id", fc.in_country("station_id", 85).alias("is_home")).agg(F.count("*").alias("n")))
q("B08_valid_delay", "select trip_key, stop_seq, arr_delay_min, dep_delay_min from journeys", J, lambda s, d: journeys(s, d).select("trip_key", "stop_seq", "arr_delay_min", "dep_delay_min"))
q("B09_trip_key", "select operating_day::varchar || '|' || trip_id as trip_key, count(*) as n from trains group by all", T,
  lambda s, d: trains(s, d).groupBy(fc.trip_key("operating_day", "trip_id").alias("trip_key")).agg(F.count("*").alias("n")))
q("B10_eligibility", "select is_eligible_stop, is_prediction_point, is_valid_journey, is_target_operator, is_valid_station, count(*) as n from journeys group by all", J,
  lambda s, d: journeys(s, d).groupBy("is_eligible_stop", "is_prediction_point", "is_valid_journey", "is_target_operator", "is_valid_station").agg(F.count("*").alias("n")))
q("B11_candidate_targets", "select trip_key, stop_seq as target_seq, station_id as target_station_id, arr_planned as target_arr_planned, arr_delay_min as target_delay_min, is_cancelled as target_cancelled "
  "from journeys where arr_planned is not null and not is_pass_through and is_valid_station and not is_plan_inconsistent", J, lambda s, d: lb.candidates(journeys(s, d)))
q("B12_date_split", f"select {SPLIT.format('operating_day')} as split, count(*) as n, min(operating_day) as first_day from trains group by 1", T,
  lambda s, d: trains(s, d).groupBy(fc.date_split("operating_day", C, strict=True).alias("split")).agg(F.count("*").alias("n"), F.min("operating_day").alias("first_day")))
q("B13_feature_sets", "select trip_key, stop_seq, horizon_min, d0_min, sched_gap_min, category, operator_abbr from labels_", L,
  lambda s, d: rel.project_sets(labels(s, d), ["current", "timetable", "context"], {"current": ["d0_min"], "timetable": ["sched_gap_min", "d0_min"], "context": ["category", "operator_abbr"]}, ["trip_key", "stop_seq", "horizon_min"]))
q("B14_where_load", "select trip_key, stop_seq, horizon_min, d0_min, delta_min from labels_ where horizon_min = 30 and label_status = 'ok' and operating_day <= date '2024-01-18'", L,
  lambda s, d: rel.load(labels(s, d), "horizon_min = 30 and label_status = 'ok' and operating_day <= date '2024-01-18'", ["trip_key", "stop_seq", "horizon_min", "d0_min", "delta_min"]))
q("B15_journey_sample", "select trip_key, count(*) as n from journeys where ('0x' || substr(md5(trip_key || '|7'), 1, 8))::bigint % 1000 < 300 group by all", J,
  lambda s, d: journeys(s, d).where(fc.hash_bucket("trip_key", 7, 1000) < 300).groupBy("trip_key").agg(F.count("*").alias("n")))
q("B16_bounded_sample", "select trip_key, stop_seq, horizon_min from labels_ order by md5(trip_key || '|' || stop_seq || '|' || horizon_min), trip_key, stop_seq, horizon_min limit 500", L,
  lambda s, d: rel.bounded_sample(labels(s, d), ["trip_key", "stop_seq", "horizon_min"], 500))
q("B17_flags_to_int", "select trip_key, stop_seq, is_cancelled::int as is_cancelled, is_extra_trip::int as is_extra_trip from journeys", J,
  lambda s, d: rel.flags_to_int(journeys(s, d).select("trip_key", "stop_seq", "is_cancelled", "is_extra_trip")))

# C: joins
q("C01_inner_join", "select j.trip_key, j.stop_seq, repeats from journeys j join checks c on c.trip_key = j.trip_key", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq").join(jn.journey_checks(ordered(s, d)).select("trip_key", "repeats"), "trip_key"))
q("C02_left_join", "select t.station_id, count(*) as n, max(share_real) as share_real from trains t left join quality q on q.station_id = t.station_id group by all", "quality",
  lambda s, d: trains(s, d).groupBy("station_id").agg(F.count("*").alias("n")).join(F.broadcast(quality(s, d).select("station_id", "share_real")), "station_id", "left"))
q("C03_self_join_sequence", "select l.trip_key, l.stop_seq, l.horizon_min, a.dep_planned as now_dep, b.arr_planned as then_arr, b.station_id as then_station from labels_ l "
  "join journeys a on a.trip_key = l.trip_key and a.stop_seq = l.stop_seq join journeys b on b.trip_key = l.trip_key and b.stop_seq = l.target_seq", L, lambda s, d: rel.stops_of_points(labels(s, d), journeys(s, d)))
q("C04_horizons", "select trip_key, stop_seq, horizon_min from points", "points",
  lambda s, d: journeys(s, d).where("is_prediction_point").select("trip_key", "stop_seq", F.explode(F.array(*map(F.lit, C.horizons))).alias("horizon_min")))
q("C05_first_target", "select trip_key, stop_seq, horizon_min, target_seq from labels_ where target_seq is not null", L, lambda s, d: labels(s, d).where("target_seq is not null").select("trip_key", "stop_seq", "horizon_min", "target_seq"))
q("C06_route_range", "select l.trip_key, l.stop_seq, l.horizon_min, r.stop_seq as route_seq, r.station_id from labels_ l join journeys r on r.trip_key = l.trip_key and r.stop_seq > l.stop_seq and r.stop_seq <= l.target_seq", L,
  lambda s, d: rel.route_stops(labels(s, d), journeys(s, d)))
q("C10_anti_join", "select distinct station_id from trains t where not exists (select 1 from quality q where q.station_id = t.station_id)", "quality",
  lambda s, d: trains(s, d).select("station_id").distinct().join(quality(s, d).select("station_id"), "station_id", "left_anti"))
q("C11_neighbours", "select distinct a.trip_key, b.to_id as station_id from (select distinct trip_key, station_id from journeys) a join (select station_id as from_id, next_station_id as to_id from ordered where next_station_id is not null "
  "union select next_station_id, station_id from ordered where next_station_id is not null) b on b.from_id = a.station_id", J, lambda s, d: rel.neighbours(journeys(s, d).select("trip_key", "station_id"), ordered(s, d)))
q("C12_induced_edges", "with e as (select distinct station_id as a, next_station_id as b from ordered where next_station_id is not null), v as (select distinct trip_key, station_id from journeys) "
  "select x.trip_key, a, b from v x join e on e.a = x.station_id join v y on y.trip_key = x.trip_key and y.station_id = e.b", J, lambda s, d: rel.induced_edges(journeys(s, d).select("trip_key", "station_id"), ordered(s, d)))
q("C13_prediction_join", "select a.trip_key, a.stop_seq, a.d0_min as x, b.delta_min as y, c.delta_min as z from labels_ a join labels_ b using (trip_key, stop_seq) join labels_ c using (trip_key, stop_seq) "
  "where a.horizon_min = 15 and b.horizon_min = 30 and c.horizon_min = 60 and a.in_common_subset", L, lambda s, d: rel.across_horizons(labels(s, d)))
q("C14_complete_join", "select j.trip_key, j.stop_seq, c.places from journeys j join checks c on c.trip_key = j.trip_key", J,
  lambda s, d: rel.complete_join(journeys(s, d).select("trip_key", "stop_seq"), jn.journey_checks(ordered(s, d)).select("trip_key", "places"), ["trip_key"]))
q("C15_flag_join", "select l.trip_key, l.stop_seq, l.horizon_min, coalesce(f.bad, false) as bad from labels_ l left join (select operating_day, count(*) > 150 as bad from journeys where is_cancelled or dep_delay_min > 4 group by 1) f using (operating_day)", L,
  lambda s, d: labels(s, d).select("operating_day", "trip_key", "stop_seq", "horizon_min").join(
      F.broadcast(journeys(s, d).where("is_cancelled or dep_delay_min > 4").groupBy("operating_day").agg((F.count("*") > 150).alias("bad"))), "operating_day", "left"
  ).select("trip_key", "stop_seq", "horizon_min", F.coalesce("bad", F.lit(False)).alias("bad")))

# D: aggregates
q("D01_counts", "select operating_day, count(*) as n, count(distinct trip_key) as trips, count(distinct station_id) as stations from journeys group by all", J,
  lambda s, d: journeys(s, d).groupBy("operating_day").agg(F.count("*").alias("n"), F.count_distinct("trip_key").alias("trips"), F.count_distinct("station_id").alias("stations")))
q("D02_filtered", "select category, count(*) filter (where is_cancelled) as cancelled, round(avg(dep_delay_min) filter (where is_prediction_point), 6) as mean_delay, min(dep_planned) filter (where not is_cancelled) as first_dep from journeys group by all", J,
  lambda s, d: journeys(s, d).groupBy("category").agg(F.count_if("is_cancelled").alias("cancelled"), F.round(F.avg(F.when(F.col("is_prediction_point"), F.col("dep_delay_min"))), 6).alias("mean_delay"), F.min(F.when(~F.col("is_cancelled"), F.col("dep_planned"))).alias("first_dep")))
q("D03_bool_aggregates", "select trip_key, bool_and(is_cancelled) as all_cancelled, bool_or(is_cancelled) as any_cancelled from journeys group by all", J,
  lambda s, d: journeys(s, d).groupBy("trip_key").agg(F.bool_and("is_cancelled").alias("all_cancelled"), F.bool_or("is_cancelled").alias("any_cancelled")))
q("D04_share", "select station_id, round(avg((dep_status = 'REAL')::int), 9) as share from trains group by all", T, lambda s, d: trains(s, d).groupBy("station_id").agg(F.round(F.avg((F.col("dep_status") == "REAL").cast("int")), 9).alias("share")))
q("D05_quantile", "select line_name, round(median(delta_min), 6) as med, round(quantile_cont(delta_min, 0.9), 6) as p90 from labels_ group by all", L,
  lambda s, d: labels(s, d).groupBy("line_name").agg(F.round(F.median("delta_min"), 6).alias("med"), F.round(F.percentile("delta_min", 0.9), 6).alias("p90")))
q("D06_multi_quantile", "select category, quantile_cont(dep_delay_min, [0.1, 0.5, 0.9])[1]::double as p10, quantile_cont(dep_delay_min, [0.1, 0.5, 0.9])[2]::double as p50, quantile_cont(dep_delay_min, [0.1, 0.5, 0.9])[3]::double as p90 from journeys group by all", J,
  lambda s, d: rel.quantiles(journeys(s, d), ["category"], "dep_delay_min", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))
q("D07_mode", "select station_id, line_name from (select station_id, line_name, row_number() over (partition by station_id order by count(*) desc, line_name) as r from journeys group by station_id, line_name) where r = 1", J,
  lambda s, d: journeys(s, d).groupBy("station_id").agg(F.mode("line_name", True).alias("line_name")))
q("D08_having", "select station_id, category, count(*) as n from journeys group by all having count(*) >= 20", J, lambda s, d: journeys(s, d).groupBy("station_id", "category").agg(F.count("*").alias("n")).where("n >= 20"))
q("D09_group_by_all", "select category, line_name, operator_abbr, count(*) as n from journeys group by all", J, lambda s, d: s.sql("select category, line_name, operator_abbr, count(*) as n from {j} group by all", j=journeys(s, d)))
q("D12_guarded_ratio", "select trip_key, sum(dep_delay_min) / nullif(count(dep_delay_min), 0) as mean_delay from journeys group by all", J,
  lambda s, d: journeys(s, d).groupBy("trip_key").agg(F.sum("dep_delay_min").alias("s"), F.count("dep_delay_min").alias("n")).select("trip_key", fc.ratio("s", "n").alias("mean_delay")))
q("D13_sum_of_means", "select operating_day, round(sum(s / nullif(n, 0)), 6) as total, round(avg((n > 0)::double), 9) as coverage from (select operating_day, station_id, count(dep_delay_min) as n, sum(dep_delay_min) as s from journeys group by all) group by all", J,
  lambda s, d: journeys(s, d).groupBy("operating_day", "station_id").agg(F.count("dep_delay_min").alias("n"), F.sum("dep_delay_min").alias("s")).groupBy("operating_day").agg(
      F.round(F.sum(fc.ratio("s", "n")), 6).alias("total"), F.round(F.avg((F.col("n") > 0).cast("double")), 9).alias("coverage")))
q("D14_distinct_ratio", "select category, count(distinct if(is_cancelled, trip_key, null)) / count(distinct trip_key) as share, count(*) / count(distinct operating_day) as a_day from journeys group by all", J,
  lambda s, d: journeys(s, d).groupBy("category").agg((F.count_distinct(F.when(F.col("is_cancelled"), F.col("trip_key"))) / F.count_distinct("trip_key")).alias("share"), (F.count("*") / F.count_distinct("operating_day")).alias("a_day")))
q("D15_zscore", "select operating_day, round((m - avg(m) filter (where operating_day <= date '2024-01-18') over ()) / stddev_pop(m) filter (where operating_day <= date '2024-01-18') over (), 6) as z from (select operating_day, avg(dep_delay_min) as m from journeys group by all)", J,
  lambda s, d: rel.zscore(journeys(s, d).groupBy("operating_day").agg(F.avg("dep_delay_min").alias("m")), "m", F.col("operating_day") <= F.lit("2024-01-18").cast("date"), "z").select("operating_day", F.round("z", 6).alias("z")))
q("D16_weighted_mean", "select category, round(sum(n * m) / sum(n), 6) as wmean from (select category, operating_day, count(dep_delay_min) as n, avg(dep_delay_min) as m from journeys group by all) group by all", J,
  lambda s, d: rel.weighted_mean(journeys(s, d).groupBy("category", "operating_day").agg(F.count("dep_delay_min").alias("n"), F.avg("dep_delay_min").alias("m")), ["category"], "m", "n").select("category", F.round("m", 6).alias("wmean")))
q("D17_histogram", "select greatest(least(floor(dep_delay_min), 8), -3)::bigint as bin, count(*) as n from journeys where dep_delay_min is not null group by all", J, lambda s, d: rel.clipped_histogram(journeys(s, d), "dep_delay_min", -3, 8))
q("D18_trend", "select round(regr_slope(m, x), 9) as slope from (select date_diff('day', date '2024-01-01', operating_day) as x, avg(dep_delay_min) as m from journeys group by all)", J,
  lambda s, d: journeys(s, d).groupBy(F.date_diff("operating_day", F.lit("2024-01-01").cast("date")).alias("x")).agg(F.avg("dep_delay_min").alias("m")).agg(F.round(F.regr_slope("m", "x"), 9).alias("slope")))
q("D19_distinct", "select distinct trip_key, stop_seq from labels_", L, lambda s, d: labels(s, d).select("trip_key", "stop_seq").dropDuplicates())
q("D20_describe", "select count(m)::bigint as n, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as std, round(min(m), 6) as lo, round(quantile_cont(m, 0.25), 6) as q1, round(median(m), 6) as q2, round(quantile_cont(m, 0.75), 6) as q3, round(max(m), 6) as hi "
  "from (select avg(is_cancelled::int) as m from journeys group by operating_day)", J, lambda s, d: rel.describe(journeys(s, d).groupBy("operating_day").agg(F.avg(F.col("is_cancelled").cast("int")).alias("m")), "m"))
q("D21_complete_groups", "select trip_key, stop_seq, horizon_min from (select *, count(*) over (partition by trip_key, stop_seq) as n from labels_ where label_status = 'ok') where n = 3", L,
  lambda s, d: rel.complete_groups(labels(s, d).where("label_status = 'ok'"), ["trip_key", "stop_seq"], "horizon_min", 3).select("trip_key", "stop_seq", "horizon_min"))

# E: windows
q("E01_row_number", "select trip_key, station_id, place from ordered", "ordered", lambda s, d: ordered(s, d).select("trip_key", "station_id", "place"))
q("E02_partition_count", "select trip_key, place, places from ordered", "ordered", lambda s, d: ordered(s, d).select("trip_key", "place", "places"))
q("E03_lead_lag", "select trip_key, stop_seq, lead(station_id) over w as next_station, lag(dep_delay_min, 1) over w as lag1, lag(dep_delay_min, 3) over w as lag3, lag(dep_delay_min, 5) over w as lag5 from journeys window w as (partition by trip_key order by stop_seq)", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq", F.lead("station_id").over(by_stop()).alias("next_station"), *[F.lag("dep_delay_min", k).over(by_stop()).alias(f"lag{k}") for k in (1, 3, 5)]))
q("E04_before_current", "select trip_key, stop_seq, max(dep_delay_min) over w as max_prev, count(dep_delay_min) over w as n_prev from journeys window w as (partition by trip_key order by stop_seq rows between unbounded preceding and 1 preceding)", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq", F.max("dep_delay_min").over(by_stop().rowsBetween(Window.unboundedPreceding, -1)).alias("max_prev"), F.count("dep_delay_min").over(by_stop().rowsBetween(Window.unboundedPreceding, -1)).alias("n_prev")))
q("E05_running_total", "select trip_key, stop_seq, round(sum(coalesce(dep_delay_min, 0)) over (partition by trip_key order by stop_seq rows unbounded preceding), 6) as total from journeys", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq", F.round(F.sum(F.coalesce("dep_delay_min", F.lit(0.0))).over(by_stop().rowsBetween(Window.unboundedPreceding, 0)), 6).alias("total")))
q("E06_partition_min", "select trip_key, stop_seq, min(dep_planned) over (partition by trip_key) as origin, bool_and(is_eligible_stop) over (partition by trip_key) as all_eligible from journeys", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq", F.min("dep_planned").over(Window.partitionBy("trip_key")).alias("origin"), F.bool_and("is_eligible_stop").over(Window.partitionBy("trip_key")).alias("all_eligible")))
q("E07_share_of_total", "select category, line_name, count(*) as n, count(*) / sum(count(*)) over () as share, count(*) / sum(count(*)) over (partition by category) as in_category from journeys group by category, line_name", J,
  lambda s, d: rel.shares(journeys(s, d), ["category", "line_name"], ["category"], "in_category"))
q("E09_capped_rank", "select trip_key, least(count(*), 8) as kept, greatest(count(*) - 8, 0) as dropped from journeys group by all", J, lambda s, d: rel.capped(journeys(s, d), ["trip_key"], [F.col("stop_seq")], 8).groupBy("trip_key").agg(
    F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")))
q("E10_dense_index", "select station_id, row_number() over (order by station_id) - 1 as idx from (select distinct station_id from trains)", T, lambda s, d: rel.dense_index(trains(s, d).select("station_id").distinct(), "station_id"))

# F: order and top-k
q("F01_order", "select operating_day, trip_key, stop_seq from journeys order by all", J, lambda s, d: journeys(s, d).select("operating_day", "trip_key", "stop_seq").orderBy("operating_day", "trip_key", "stop_seq"))
q("F02_top_k", "select trip_key, stop_seq, dep_delay_min from journeys where dep_delay_min is not null order by dep_delay_min desc, trip_key, stop_seq limit 20", J,
  lambda s, d: journeys(s, d).where("dep_delay_min is not null").select("trip_key", "stop_seq", "dep_delay_min").orderBy(F.desc("dep_delay_min"), "trip_key", "stop_seq").limit(20))
q("F03_nulls_last", "select trip_key, stop_seq, row_number() over (partition by trip_key order by dep_delay_min desc nulls last, stop_seq) as r from journeys", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq", F.row_number().over(Window.partitionBy("trip_key").orderBy(F.desc_nulls_last("dep_delay_min"), "stop_seq")).alias("r")))

# G: sets and shapes
q("G01_union_all", "select station_id, arr_actual as t, arr_delay_min as delay from journeys where arr_delay_min is not null union all select station_id, dep_actual, dep_delay_min from journeys where dep_delay_min is not null", J,
  lambda s, d: rel.arrivals_and_departures(journeys(s, d)))
q("G02_union_distinct", "select station_id as a, next_station_id as b from ordered where next_station_id is not null union select next_station_id, station_id from ordered where next_station_id is not null", "ordered", lambda s, d: rel.adjacency(ordered(s, d)))
q("G03_unnest", "select trip_key, unnest([15, 30, 60]) as horizon_min from (select distinct trip_key from journeys)", J, lambda s, d: journeys(s, d).select("trip_key").distinct().withColumn("horizon_min", F.explode(F.array(F.lit(15), F.lit(30), F.lit(60)))))
q("G04_pivot", "select label_status, count(*) filter (where horizon_min = 15) as h15, count(*) filter (where horizon_min = 30) as h30, count(*) filter (where horizon_min = 60) as h60 from labels_ group by all", L,
  lambda s, d: labels(s, d).groupBy("label_status").pivot("horizon_min", [15, 30, 60]).agg(F.count("stop_seq")).na.fill(0).toDF("label_status", "h15", "h30", "h60"))
q("G05_unpivot", "select trip_key, stop_seq, 'arr' as what, arr_delay_min as delay from journeys union all select trip_key, stop_seq, 'dep', dep_delay_min from journeys", J,
  lambda s, d: journeys(s, d).select("trip_key", "stop_seq", F.col("arr_delay_min").alias("arr"), F.col("dep_delay_min").alias("dep")).unpivot(["trip_key", "stop_seq"], ["arr", "dep"], "what", "delay"))
q("G06_pack_arrays", "select trip_key, n::int as n, list_resize(ids, 12, 0) as ids from (select trip_key, least(count(*), 12) as n, list(station_id order by stop_seq) filter (where stop_seq <= 12) as ids from journeys group by all)", J,
  lambda s, d: rel.packed(journeys(s, d), ["trip_key"], "stop_seq", "station_id", 12))

# H: scalar rules
q("H02_try_cast", "select try_cast(train_number as integer) as number, try_cast(trip_id as integer) as none, count(*) as n from trains group by all", T,
  lambda s, d: trains(s, d).groupBy(F.col("train_number").try_cast("int").alias("number"), F.col("trip_id").try_cast("int").alias("none")).agg(F.count("*").alias("n")))
q("H03_elapsed", "select trip_id, operating_day, round((epoch(dep_planned) - epoch(arr_planned)) / 60.0, 6) as dwell from trains where arr_planned is not null and dep_planned is not null", T,
  lambda s, d: trains(s, d).where("arr_planned is not null and dep_planned is not null").select("trip_id", "operating_day", F.round(fc.elapsed_min("arr_planned", "dep_planned"), 6).alias("dwell")))
q("H04_epoch", "select epoch(dep_actual)::bigint as sec, (epoch(dep_actual)::bigint // 60) as minute from trains where dep_actual is not null", T, lambda s, d: trains(s, d).where("dep_actual is not null").select(fc.epoch_s("dep_actual").alias("sec"), fc.minute_idx("dep_actual").alias("minute")))
q("H05_plus_minutes", "select dep_planned + interval 30 minute as later, dep_planned - interval 2 minute as sooner from trains where dep_planned is not null", T,
  lambda s, d: trains(s, d).where("dep_planned is not null").select(fc.plus_minutes("dep_planned", 30).alias("later"), fc.plus_minutes("dep_planned", -2).alias("sooner")))
q("H06_calendar", f"select operating_day, isodow(operating_day) as weekday, dayofweek(operating_day) + 1 as dow, {DAYTYPE.format('operating_day')} as day_type, min(hour(arr_planned)) as h from trains group by all", T,
  lambda s, d: trains(s, d).groupBy("operating_day").agg(F.min(F.hour("arr_planned")).alias("h")).select("operating_day", fc.iso_weekday("operating_day").alias("weekday"), F.dayofweek("operating_day").alias("dow"), fc.day_type("operating_day").alias("day_type"), "h"))
q("H07_date_format", "select distinct strftime(operating_day, '%Y-%m') as month, dayname(operating_day) as day_name, last_day(operating_day) as month_end from trains", T,
  lambda s, d: trains(s, d).select(F.date_format("operating_day", "yyyy-MM").alias("month"), F.date_format("operating_day", "EEEE").alias("day_name"), F.last_day("operating_day").alias("month_end")).distinct())
q("H08_strings", "select distinct upper(line_name) as up, nullif(trim(' ' || category || ' '), '') as trimmed, regexp_extract(line_name, '^[A-Za-z]+') as prefix from trains", T,
  lambda s, d: trains(s, d).select(F.upper("line_name").alias("up"), F.nullif(F.trim(F.concat(F.lit(" "), "category", F.lit(" "))), F.lit("")).alias("trimmed"), F.regexp_extract("line_name", "^[A-Za-z]+", 0).alias("prefix")).distinct())
q("H09_arithmetic", "select trip_key, stop_seq, greatest(dep_delay_min, 0) as up, least(dep_delay_min, 5) as cut, abs(dep_delay_min) as size, floor(dep_delay_min)::bigint as whole, round(ln(1 + abs(dep_delay_min)), 9) as logged from journeys where dep_delay_min is not null", J,
  lambda s, d: journeys(s, d).where("dep_delay_min is not null").select("trip_key", "stop_seq", F.greatest("dep_delay_min", F.lit(0.0)).alias("up"), F.least("dep_delay_min", F.lit(5.0)).alias("cut"), F.abs("dep_delay_min").alias("size"), F.floor("dep_delay_min").alias("whole"), F.round(F.log1p(F.abs("dep_delay_min")), 9).alias("logged")))
q("H10_integer_division", "select distinct station_id, (station_id // 100000)::bigint as prefix from trains", T, lambda s, d: trains(s, d).select("station_id", F.expr("station_id div 100000").alias("prefix")).distinct())
q("H11_left_closed", "select case when d0_min < 1 then '<1' when d0_min < 3 then '1-3' when d0_min < 10 then '3-10' else '>10' end as d0_bucket, count(*) as n from labels_ group by all", L,
  lambda s, d: labels(s, d).groupBy(fc.d0_bucket("d0_min", C).alias("d0_bucket")).agg(F.count("*").alias("n")))
q("H12_right_closed", "select case when sched_gap_min > 0 and sched_gap_min <= 20 then 0 when sched_gap_min <= 40 then 1 when sched_gap_min <= 999 then 2 end as b, count(*) as n from labels_ where sched_gap_min > 0 group by all", L,
  lambda s, d: labels(s, d).where("sched_gap_min > 0").groupBy(fc.bucket("sched_gap_min", [0, 20, 40, 999], True).alias("b")).agg(F.count("*").alias("n")))
q("H13_quantile_bucket", "with e as (select quantile_cont(d0_min, 0.25) as a, median(d0_min) as b, quantile_cont(d0_min, 0.75) as c from labels_) select ((d0_min >= a)::int + (d0_min >= b)::int + (d0_min >= c)::int) as quartile, count(*) as n from labels_, e group by all", L,
  lambda s, d: rel.quantile_buckets(labels(s, d), "d0_min", [0.25, 0.5, 0.75], "quartile").groupBy("quartile").agg(F.count("*").alias("n")))
q("H14_pinball", "select horizon_min, round(avg(greatest(0.1 * (delta_min - d0_min), -0.9 * (delta_min - d0_min))), 6) as loss from labels_ group by all", L,
  lambda s, d: labels(s, d).groupBy("horizon_min").agg(F.round(F.avg(fc.pinball("delta_min", "d0_min", 0.1)), 6).alias("loss")))
q("H15_sort_three", "select trip_key, stop_seq, horizon_min, list_sort([d0_min, target_delay_min, delta_min]) as three from labels_ where label_status = 'ok'", L,
  lambda s, d: labels(s, d).where("label_status = 'ok'").select("trip_key", "stop_seq", "horizon_min", fc.sorted_three("d0_min", "target_delay_min", "delta_min").alias("three")))
q("H16_delay_text", "select trip_key, stop_seq, case when round(d0_min)::int = 0 then 'on time' else if(d0_min > 0, '+', '-') || abs(round(d0_min)::int) || ' min' end as said, strftime(dep_planned, '%H:%M') as clock from labels_", L,
  lambda s, d: labels(s, d).select("trip_key", "stop_seq", fc.delay_text("d0_min").alias("said"), F.date_format("dep_planned", "HH:mm").alias("clock")))

# J: functions for SQL users
q("J01_sql_functions", "select trip_key, stop_seq, case when arr_delay_min <> 0 then dep_delay_min / arr_delay_min end as r, greatest(0.9 * (dep_delay_min - arr_delay_min), -0.1 * (dep_delay_min - arr_delay_min)) as loss from journeys", J, lambda s, d: rel.with_sql_functions(s, journeys(s, d), C))
q("J02_aggregate_helpers", "select category, round(sum(n_stops * dep_delay_min) / sum(if(dep_delay_min is null, null, n_stops)), 6) as m from journeys group by all", J, lambda s, d: rel.weighted_mean(journeys(s, d), ["category"], "dep_delay_min", "n_stops").select("category", F.round("m", 6).alias("m")))
q("J03_table_functions", "select l.trip_key, l.stop_seq, l.horizon_min, unnest(generate_series(l.stop_seq + 1, l.target_seq)) as route_seq from labels_ l where target_seq is not null", L,
  lambda s, d: rel.explode_route(labels(s, d)).select("trip_key", "stop_seq", "horizon_min", "route_seq"))
