"""Data-profiling queries over stop records, journeys, labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.functions.columns import in_country
from stopwise.operators import calibrate as cb
from stopwise.operators import journeys as jn
from stopwise.operators import monitor as mo
from stopwise.operators import relational as rel
from stopwise.plans import quality as ql
from stopwise.plans.core import journeys, labels, ordered, trains
from stopwise.plans.domain import FEATURES, features, flags, prior, q, rounded

E: dict = {}
share = lambda c: F.round(F.avg(c.cast("int")), 6)

q("N01_monthly_overview", "select strftime(operating_day, '%Y-%m') as month, count(distinct operating_day) as days, count(*) as n, count(distinct operating_day::varchar || trip_id) as trips, count(distinct station_id) as stations from trains group by all", E,
  lambda s, d: trains(s, d).groupBy(F.date_format("operating_day", "yyyy-MM").alias("month")).agg(F.count_distinct("operating_day").alias("days"), F.count("*").alias("n"), F.count_distinct(F.concat(F.col("operating_day").cast("string"), "trip_id")).alias("trips"), F.count_distinct("station_id").alias("stations")))
q("N02_category_mix", "select category, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from trains group by category", E, lambda s, d: rounded(rel.shares(trains(s, d), ["category"], ["category"], "own").drop("own")))
q("N02_category_line", "select category, regexp_extract(line_name, '^[A-Za-z]+') as prefix, count(*) as n from trains group by all", E, lambda s, d: trains(s, d).groupBy("category", F.regexp_extract("line_name", "^[A-Za-z]+", 0).alias("prefix")).agg(F.count("*").alias("n")))
q("N03_run_kinds", "select kind, count(*) as runs from (select operating_day, trip_id, case when bool_and(station_id // 100000 = 85) then 'domestic' when bool_or(station_id // 100000 = 85) then 'cross-border' else 'foreign' end as kind from trains group by all) group by all", E,
  lambda s, d: trains(s, d).groupBy("operating_day", "trip_id").agg(F.bool_and(in_country("station_id", 85)).alias("a"), F.bool_or(in_country("station_id", 85)).alias("b")).groupBy(F.when(F.col("a"), "domestic").when(F.col("b"), "cross-border").otherwise("foreign").alias("kind")).agg(F.count("*").alias("runs")))
q("N04_measured_share", "select operator_abbr, station_id // 100000 = 85 as is_home, count(*) as n, round(avg((dep_status = 'REAL')::int), 6) as share from trains where dep_planned is not null group by all", E,
  lambda s, d: trains(s, d).where("dep_planned is not null").groupBy("operator_abbr", in_country("station_id", 85).alias("is_home")).agg(F.count("*").alias("n"), share(F.col("dep_status") == "REAL").alias("share")))
q("N04_poor_stations", "select station_id, count(*) as n, round(avg((dep_status = 'REAL')::int), 6) as share from trains where dep_planned is not null group by all having count(*) >= 20 and avg((dep_status = 'REAL')::int) < 0.97", E,
  lambda s, d: trains(s, d).where("dep_planned is not null").groupBy("station_id").agg(F.count("*").alias("n"), F.avg((F.col("dep_status") == "REAL").cast("int")).alias("m")).where("n >= 20 and m < 0.97").select("station_id", "n", F.round("m", 6).alias("share")))
q("N05_status_mix", "select what, status, n, round(n / sum(n) over (partition by what), 6) as share from (select 'arr' as what, arr_status as status, count(*) as n from trains where arr_planned is not null group by all union all select 'dep', dep_status, count(*) from trains where dep_planned is not null group by all)", E,
  lambda s, d: rounded(rel.shares(trains(s, d).where("arr_planned is not null").select(F.lit("arr").alias("what"), F.col("arr_status").alias("status")).union(trains(s, d).where("dep_planned is not null").select(F.lit("dep"), "dep_status")), ["what", "status"], ["what"], "part").select("what", "status", "n", F.col("part").alias("share"))))
q("N06_outage_days", "select operating_day, round(m, 6) as m from (select operating_day, m, avg(m) over () as a, stddev_samp(m) over () as s from (select operating_day, avg((dep_status = 'REAL')::int) as m from trains where dep_planned is not null group by all)) where m < a - 1.5 * s", E,
  lambda s, d: (lambda x: rounded(x.join(F.broadcast(x.agg(F.avg("m").alias("a"), F.stddev_samp("m").alias("sd")))).where("m < a - 1.5D * sd").select("operating_day", "m")))(trains(s, d).where("dep_planned is not null").groupBy("operating_day").agg(F.avg((F.col("dep_status") == "REAL").cast("int")).alias("m"))))
q("N07_cancellations", "select operating_day, round(avg(a::int), 6) as full_share, round(avg((b and not a)::int), 6) as part_share, round(avg(x::int), 6) as extra_share from (select operating_day, trip_key, bool_and(is_cancelled) as a, bool_or(is_cancelled) as b, bool_or(is_extra_trip) as x from scoped group by all) group by all", E,
  lambda s, d: ordered(s, d).groupBy("operating_day", "trip_key").agg(F.bool_and("is_cancelled").alias("a"), F.bool_or("is_cancelled").alias("b"), F.bool_or("is_extra_trip").alias("x")).groupBy("operating_day").agg(share(F.col("a")).alias("full_share"), share(F.col("b") & ~F.col("a")).alias("part_share"), share(F.col("x")).alias("extra_share")))
q("N08_delay_distribution", "select category, round(avg(dep_delay_min), 6) as mean, min(dep_delay_min) as lo, round(quantile_cont(dep_delay_min, 0.01), 6) as p01, round(quantile_cont(dep_delay_min, 0.99), 6) as p99, max(dep_delay_min) as hi, round(avg((dep_delay_min > 3)::int), 6) as late3 from journeys where dep_delay_min is not null group by all", E,
  lambda s, d: journeys(s, d).where("dep_delay_min is not null").groupBy("category").agg(F.round(F.avg("dep_delay_min"), 6).alias("mean"), F.min("dep_delay_min").alias("lo"), F.round(F.percentile("dep_delay_min", 0.01), 6).alias("p01"), F.round(F.percentile("dep_delay_min", 0.99), 6).alias("p99"), F.max("dep_delay_min").alias("hi"), share(F.col("dep_delay_min") > 3).alias("late3")))
q("N09_impossible", "select count(*) filter (where dep_status = 'REAL' and dep_delay_min is null) as out_of_range, count(*) filter (where arr_planned > dep_planned) as plan_backwards, count(*) filter (where arr_actual > dep_actual) as real_backwards, count(*) filter (where is_cancelled and dep_status = 'REAL') as cancelled_measured from journeys", E,
  lambda s, d: journeys(s, d).agg(F.count_if((F.col("dep_status") == "REAL") & F.col("dep_delay_min").isNull()).alias("out_of_range"), F.count_if(F.col("arr_planned") > F.col("dep_planned")).alias("plan_backwards"), F.count_if(F.col("arr_actual") > F.col("dep_actual")).alias("real_backwards"), F.count_if(F.col("is_cancelled") & (F.col("dep_status") == "REAL")).alias("cancelled_measured")))
q("N10_negative_dwell", "select category, count(*) as n, round(quantile_cont(x, 0.1), 6) as p10, round(median(x), 6) as p50, round(quantile_cont(x, 0.9), 6) as p90 from (select category, (epoch(dep_actual) - epoch(arr_actual)) / 60.0 as x from journeys where arr_actual > dep_actual) group by all", E,
  lambda s, d: (lambda x: rounded(x.groupBy("category").agg(F.count("*").alias("n")).join(rel.quantiles(x, ["category"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "category")))(journeys(s, d).where("arr_actual > dep_actual").select("category", __import__("stopwise.functions.columns", fromlist=["elapsed_min"]).elapsed_min("arr_actual", "dep_actual").alias("x"))))
_faults = ("repeats", "doubled", "backwards", "open_start", "open_end")
q("N11_integrity", f"select count(*) as trips, {', '.join(f'count_if({f} > 0)::bigint as {f}' for f in _faults)}, count_if(not is_valid_journey)::bigint as invalid from checks", E,
  lambda s, d: jn.journey_checks(ordered(s, d)).agg(F.count("*").alias("trips"), *[F.count_if(F.col(f) > 0).alias(f) for f in _faults], F.count_if(~F.col("is_valid_journey")).alias("invalid")))
q("N12_stops_per_journey", "select least(n, 40) as stops, count(*) as trips from (select trip_key, count(*) as n from journeys group by all) group by all", E, lambda s, d: journeys(s, d).groupBy("trip_key").agg(F.count("*").alias("n")).groupBy(F.least("n", F.lit(40)).alias("stops")).agg(F.count("*").alias("trips")))
q("N12_delay_by_stop", "select stop_seq, count(dep_delay_min) as n, round(avg(dep_delay_min), 6) as mean from journeys group by all", E, lambda s, d: journeys(s, d).groupBy("stop_seq").agg(F.count("dep_delay_min").alias("n"), F.round(F.avg("dep_delay_min"), 6).alias("mean")))
q("N13_departures_points", "select strftime(operating_day, '%Y-%m') as month, count(*) filter (where dep_planned is not null) as departures, count(*) filter (where is_prediction_point) as points from journeys group by all", E,
  lambda s, d: journeys(s, d).groupBy(F.date_format("operating_day", "yyyy-MM").alias("month")).agg(F.count("dep_planned").alias("departures"), F.count_if("is_prediction_point").alias("points")))
q("N14_label_coverage", "select category, horizon_min, count(*) as n, round(avg((label_status = 'ok')::int), 6) as ok, round(avg(in_common_subset::int), 6) as common, round(median(sched_gap_min - horizon_min), 6) as overshoot from labels_ group by all", E,
  lambda s, d: labels(s, d).groupBy("category", "horizon_min").agg(F.count("*").alias("n"), share(F.col("label_status") == "ok").alias("ok"), share(F.col("in_common_subset")).alias("common"), F.round(F.median(F.col("sched_gap_min") - F.col("horizon_min")), 6).alias("overshoot")))
q("N15_delta_by_bucket", f"select horizon_min, {ql.BUCKET} as d0_bucket, count(*) as n, round(median(delta_min), 6) as p50, round(avg(abs(delta_min)), 6) as persistence from labels_ where label_status = 'ok' group by all", E,
  lambda s, d: labels(s, d).where("label_status = 'ok'").groupBy("horizon_min", ql.ev.d0_bucket("d0_min", ql.C).alias("d0_bucket")).agg(F.count("*").alias("n"), F.round(F.median("delta_min"), 6).alias("p50"), F.round(F.avg(F.abs("delta_min")), 6).alias("persistence")))
q("N16_disruption_days", "select isodow(operating_day) as weekday, count(*) as days, count_if(is_disruption_day)::bigint as flagged from flags group by all", ql.DAYS, lambda s, d: flags(s, d).groupBy((F.weekday("operating_day") + 1).alias("weekday")).agg(F.count("*").alias("days"), F.count_if("is_disruption_day").alias("flagged")))
q("N17_fallback_usage", "select split, hist_level, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as share from prior group by split, hist_level", ql.DAYS, lambda s, d: rounded(rel.shares(prior(s, d), ["split", "hist_level"], ["split"], "part").select("split", "hist_level", "n", F.col("part").alias("share"))))
_feats = ["d0_min", "delay_lag1_min", "delay_lag3_min", "slack_to_target_min", "sched_gap_min"]
q("N18_feature_profile", " union all ".join(f"select '{f}' as feature, round(avg(({f} is not null)::int), 6) as known, round(quantile_cont({f}, 0.1), 6) as p10, round(median({f}), 6) as p50, round(quantile_cont({f}, 0.9), 6) as p90 from feat" for f in _feats), FEATURES,
  lambda s, d: features(s, d).select(*_feats).unpivot([], _feats, "feature", "v").groupBy("feature").agg(share(F.col("v").isNotNull()).alias("known"), F.round(F.percentile("v", 0.1), 6).alias("p10"), F.round(F.median("v"), 6).alias("p50"), F.round(F.percentile("v", 0.9), 6).alias("p90")))
q("N19_decile_profile", "with e as (select quantile_cont(d0_min, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from labels_) select len(list_filter(edges, lambda x: x <= d0_min))::int as decile, count(*) as n, round(median(delta_min), 6) as p50 from labels_, e group by all", E,
  lambda s, d: rel.quantile_buckets(labels(s, d), "d0_min", [i / 10 for i in range(1, 10)], "decile").groupBy("decile").agg(F.count("*").alias("n"), F.round(F.median("delta_min"), 6).alias("p50")))
q(
    "N20_daily_with_flag",
    "select operating_day, is_disruption_day, round(sum(n * mae) / sum(n), 6) as mae, round(sum(n * mae_historical) / sum(n), 6) as mae_historical, "
    "round(sum(n * coverage_rolling_tails) / sum(n), 6) as coverage from score group by all",
    ql.SCORE,
    lambda s, d: rounded(ql.scores(s, d).groupBy("operating_day", "is_disruption_day").agg(*[
        (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(name) for c, name in (("mae", "mae"), ("mae_historical", "mae_historical"), ("coverage_rolling_tails", "coverage"))
    ])),
)
LONG = " union all ".join(f"select operating_day, horizon_min, d0_bucket, y, '{n}' as strategy, lo_{n} as lo, hi_{n} as hi from iv" for n in cb.STRATEGIES)
TAILS = "count(*) as n, round(avg((y between lo and hi)::int), 6) as coverage, round(avg((y < lo)::int), 6) as below_p10, round(avg((y > hi)::int), 6) as above_p90"


def tails(s, d, by, width=False):
    """Coverage of the long form of the replay's intervals in groups."""
    rows = ql.shared(s, d, "replay_rows", lambda: ql.replay_rows(s, d))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    long = cb.by_strategy(rows)
    if "is_disruption_day" in by:
        days = F.broadcast(flags(s, d).select("operating_day", "is_disruption_day"))
        long = long.join(days, "operating_day", "left").withColumn("is_disruption_day", F.coalesce("is_disruption_day", F.lit(False)))
    return long.groupBy(*by, "strategy").agg(
        F.count("*").alias("n"), share(y.between(lo, hi)).alias("coverage"), share(y < lo).alias("below_p10"), share(y > hi).alias("above_p90"),
        *([F.round(F.median(hi - lo), 6).alias("median_width")] if width else []),
    )


q(
    "N20_coverage_by_bucket", f"select horizon_min, d0_bucket, strategy, {TAILS} from ({LONG}) group by all", ql.REPLAY,
    lambda s, d: tails(s, d, ["horizon_min", "d0_bucket"]),
)
q(
    "N20_coverage_by_disruption",
    f"select horizon_min, coalesce(is_disruption_day, false) as is_disruption_day, strategy, {TAILS}, round(median(hi - lo), 6) as median_width from ({LONG}) left join flags using (operating_day) group by all",
    ql.REPLAY, lambda s, d: tails(s, d, ["horizon_min", "is_disruption_day"], width=True),
)
q(
    "N20_psi", "select horizon_min, feature, round(avg(psi), 6) as psi_mean, round(max(psi), 6) as psi_max from fp group by all", ql.SCORE,
    lambda s, d: ql.scores(s, d).select("horizon_min", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"psi_{f}").alias("psi")) for f in ql.FEATURES])).alias("f"))
    .groupBy("horizon_min", "f.feature").agg(F.round(F.avg("f.psi"), 6).alias("psi_mean"), F.round(F.max("f.psi"), 6).alias("psi_max")),
)
q(
    "N20_alert_list",
    "select operating_day, horizon_min, alerts, round(mae, 6) as mae, round(mae_historical, 6) as mae_historical, is_disruption_day, round(coverage_rolling_tails, 6) as coverage_rolling_tails from alerted where alerts <> ''",
    ql.SCORE,
    lambda s, d: rounded(mo.alerts(ql.scores(s, d)).where("alerts <> ''").select("operating_day", "horizon_min", "alerts", "mae", "mae_historical", "is_disruption_day", "coverage_rolling_tails")),
)
# sources: what an ingest audits
q("A04_parquet_scan", "select event_type, count(*) as n from events group by all", E, lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")))
q("A11_audit", "select strftime(operating_day, '%Y-%m') as month, count(distinct operating_day) as days, count(*) as raw_rows, count(*) filter (where upper(transport_mode) = 'ZUG') as train_rows from trains group by all", E,
  lambda s, d: trains(s, d).groupBy(F.date_format("operating_day", "yyyy-MM").alias("month")).agg(F.count_distinct("operating_day").alias("days"), F.count("*").alias("raw_rows"), F.count_if(F.upper("transport_mode") == "ZUG").alias("train_rows")))
q("A13_month_days", "select distinct strftime(operating_day, '%Y-%m') as month, unnest(generate_series(date_trunc('month', operating_day)::date, last_day(operating_day), interval 1 day))::date as day from trains", E,
  lambda s, d: trains(s, d).select(F.date_format("operating_day", "yyyy-MM").alias("month"), F.explode(F.sequence(F.trunc("operating_day", "month"), F.last_day("operating_day"))).alias("day")).distinct())
