"""Queries of baselines, features and network state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.operators import baselines as bl
from stopwise.operators import features as ft
from stopwise.operators import network as nw
from stopwise.plans.core import journeys, labels, shared, trains
from stopwise.plans.oracles import DAYTYPE, SPLIT, _delay, oracle
from stopwise.plans.registry import query

R = 6
DAYS = {
    "days": """select operating_day, count(distinct trip_key) as runs, count_if(is_prediction_point)::bigint as prediction_points, avg(if(is_prediction_point, dep_delay_min, null)) as mean_delay_min,
  quantile_cont(if(is_prediction_point, dep_delay_min, null), 0.9) as p90_delay_min, count(distinct if(is_cancelled, trip_key, null)) / count(distinct trip_key) as cancelled_runs_share
  from journeys where is_valid_journey and is_target_operator group by all""",
    "ref": f"select avg(mean_delay_min) as ma, stddev_pop(mean_delay_min) as sa, avg(cancelled_runs_share) as mb, stddev_pop(cancelled_runs_share) as sb from days where operating_day <= date '{C.train_end}'",
    "scored": "select days.*, ((mean_delay_min - ma) / sa + (cancelled_runs_share - mb) / sb) / 2 as disruption_score from days, ref",
    "bar": f"select quantile_cont(disruption_score, 0.95) as disruption_threshold from scored where operating_day <= date '{C.train_end}'",
    "flags": "select *, disruption_score > disruption_threshold as is_disruption_day from scored, bar",
    "lab": f"select *, hour(dep_planned) as hour, {DAYTYPE.format('operating_day')} as day_type, {SPLIT.format('operating_day')} as split from labels_ where label_status = 'ok'",
}
for _i, _keys in enumerate(bl.LEVELS):
    _g = ", ".join([*_keys, "horizon_min"])
    DAYS[f"h{_i}"] = f"select {_g}, count(*) as n, median(delta_min) as value from lab where split = 'train' group by {_g} having count(*) >= {C.min_history}"
DAYS["prior"] = "select lab.*, 0.0::double as pred_persistence, h4.value as pred_offset, coalesce(h0.value, h1.value, h2.value, h3.value, h4.value) as pred_historical, " \
    "case when h0.value is not null then 0 when h1.value is not null then 1 when h2.value is not null then 2 when h3.value is not null then 3 when h4.value is not null then 4 end as hist_level from lab " \
    + " ".join(f"left join h{i} on " + " and ".join(f"h{i}.{k} = lab.{k}" for k in [*keys, "horizon_min"]) for i, keys in enumerate(bl.LEVELS))
FEATURES = DAYS | {
    "seg0": f"select station_id as a, lead(station_id) over w as b, (epoch(lead(arr_planned) over w) - epoch(dep_planned)) / 60.0 as plan, lead(arr_delay_min) over w - dep_delay_min as gain from journeys "
    f"where operating_day <= date '{C.train_end}' window w as (partition by trip_key order by stop_seq)",
    "segref": f"select a as from_station_id, b as to_station_id, count(*) as n, median(plan) as planned_run_median_min, quantile_cont(plan + gain, {C.reference_quantile}) as run_ref_min from seg0 "
    f"where b is not null and plan is not null and gain is not null group by all having count(*) >= {C.min_segment}",
    "dwellref": f"select station_id, category, count(*) as n, quantile_cont((epoch(dep_planned) - epoch(arr_planned)) / 60.0 + dep_delay_min - arr_delay_min, {C.reference_quantile}) as dwell_ref_min from journeys "
    f"where operating_day <= date '{C.train_end}' and not is_pass_through and dep_delay_min - arr_delay_min is not null group by all having count(*) >= {C.min_segment}",
    "st0": "select *, lead(station_id) over w as nxt, (epoch(lead(arr_planned) over w) - epoch(dep_planned)) / 60.0 as run_plan, (epoch(dep_planned) - epoch(arr_planned)) / 60.0 as dwell_plan from journeys window w as (partition by trip_key order by stop_seq)",
    "st1": "select s.*, coalesce(run_plan - run_ref_min, 0) as rr, coalesce(dwell_plan - dwell_ref_min, 0) as dr from st0 s left join segref r on r.from_station_id = s.station_id and r.to_station_id = s.nxt left join dwellref d on d.station_id = s.station_id and d.category = s.category",
    "st2": """select *, sum(rr) over upto - rr as run_before, sum(dr) over upto - dr as dwell_before, lag(dep_delay_min, 1) over w as lag1, lag(dep_delay_min, 3) over w as lag3, lag(dep_delay_min, 5) over w as lag5,
  (epoch(dep_planned) - epoch(lag(dep_planned, 3) over w)) / 60.0 as gap3, (epoch(dep_planned) - epoch(lag(dep_planned, 5) over w)) / 60.0 as gap5, max(dep_delay_min) over prev as max_prev_delay_min,
  count(dep_delay_min) over prev as n_observed_prev, (epoch(dep_planned) - epoch(min(dep_planned) over (partition by trip_key))) / 60.0 as minutes_since_origin from st1
  window w as (partition by trip_key order by stop_seq), upto as (partition by trip_key order by stop_seq rows unbounded preceding), prev as (partition by trip_key order by stop_seq rows between unbounded preceding and 1 preceding)""",
    "feat": f"""select l.operating_day, l.trip_key, l.stop_seq, l.horizon_min, {SPLIT.format('l.operating_day')} as split, l.delta_min, l.in_common_subset, p.pred_historical, coalesce(f.is_disruption_day, false) as is_disruption_day,
  l.line_name, l.station_id, l.target_seq, l.d0_min, c.arr_delay_min as arr_delay_now_min, c.dep_delay_min - c.arr_delay_min as dwell_excess_now_min, c.lag1 as delay_lag1_min, l.d0_min - c.lag1 as delta_last1_min,
  c.lag3 as delay_lag3_min, l.d0_min - c.lag3 as delta_last3_min, c.lag5 as delay_lag5_min, l.d0_min - c.lag5 as delta_last5_min, 10 * (l.d0_min - c.lag3) / nullif(c.gap3, 0) as trend3_per10min,
  10 * (l.d0_min - c.lag5) / nullif(c.gap5, 0) as trend5_per10min, c.max_prev_delay_min, c.n_observed_prev, (t.run_before - c.run_before) + (t.dwell_before - c.dwell_before - c.dr) as slack_to_target_min,
  t.run_before - c.run_before as run_reserve_to_target_min, t.dwell_before - c.dwell_before - c.dr as dwell_reserve_to_target_min, l.sched_gap_min, l.target_seq - l.stop_seq as n_stops_to_target,
  c.n_stops - l.stop_seq as stops_remaining, l.stop_seq / c.n_stops as frac_journey, c.minutes_since_origin, c.dwell_plan as planned_dwell_now_min, l.hour, isodow(l.operating_day) as weekday, l.day_type, l.category,
  l.operator_abbr, c.enters_from_abroad, c.is_extra_trip from lab l join st2 c on c.trip_key = l.trip_key and c.stop_seq = l.stop_seq join st2 t on t.trip_key = l.trip_key and t.stop_seq = l.target_seq
  left join prior p on p.trip_key = l.trip_key and p.stop_seq = l.stop_seq and p.horizon_min = l.horizon_min left join flags f on f.operating_day = l.operating_day""",
}
NET = {
    "ne": f"select operating_day::varchar || '|' || trip_id as trip_key, station_id, arr_planned, dep_planned, arr_actual, dep_actual, {_delay('arr_status', 'arr_planned', 'arr_actual')} as arr_d, "
    f"{_delay('dep_status', 'dep_planned', 'dep_actual')} as dep_d from trains where station_id // 100000 = {C.country_prefix}",
    "dp0": "select station_id as from_station_id, lead(station_id) over w as to_station_id, epoch(dep_actual)::bigint as dep_s, dep_d, lead(arr_d) over w as arr_d, epoch(lead(arr_actual) over w)::bigint as nx from ne "
    "window w as (partition by trip_key order by coalesce(arr_planned, dep_planned), coalesce(dep_planned, arr_planned), station_id, arr_planned, dep_planned, arr_actual, dep_actual, arr_d, dep_d)",
    "dp": "select from_station_id, to_station_id, dep_s, dep_d, if(arr_d is null, null, nx) as arr_s, arr_d from dp0 where dep_d is not null and to_station_id is not null",
    "ms": f"select station_id, minute, count(*) as n, sum(d) as s, count_if(d > {C.late_min})::bigint as l from (select station_id, epoch(arr_actual)::bigint // 60 as minute, arr_d as d from ne where arr_d is not null "
    "union all select station_id, epoch(dep_actual)::bigint // 60, dep_d from ne where dep_d is not null) group by all",
    "mg": "select from_station_id, to_station_id, arr_s // 60 as minute, count(*) as n, sum(arr_d - dep_d) as s from dp where arr_s is not null group by all",
    "mn": "select minute, sum(n)::bigint as n, sum(s) as s, sum(l)::bigint as l from ms group by all",
    "nxt": "select trip_key, stop_seq, station_id as cur_station_id, lead(station_id) over (partition by trip_key order by stop_seq) as next_station_id from journeys",
    "pts": f"select l.trip_key, l.stop_seq, l.horizon_min, t_pred, target_seq, target_station_id, cur_station_id, next_station_id, (epoch(t_pred)::bigint - {60 * C.lag_min}) // 60 - 1 as m_end, (m_end + 1) * 60 as cut_s "
    "from labels_ l join nxt using (trip_key, stop_seq) where label_status = 'ok'",
}
K = "trip_key, stop_seq, horizon_min"


def window_sql(column: str, width: int) -> str:
    """Sums of a point's station over the last minutes, event by event."""
    return f"select p.trip_key, p.stop_seq, p.horizon_min, coalesce(sum(n), 0)::bigint as n, sum(s) as s, sum(l) as l from pts p left join ms on ms.station_id = p.{column} and minute > m_end - {width} and minute <= m_end group by all"


def q(name: str, sql: str, extra: dict, f, upto: str = "labels_") -> None:
    query(name, oracle(sql, upto, extra) if sql else None)(f)


def rounded(df, digits: int = R):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def unsigned(df, digits: int = R, tie: float = 0.0):
    """Rounded, and no zero negative. Means over powers of two lie on ties, which the order of a sum would decide; ``tie`` is added to both sides."""
    return df.select(*[(F.round(F.col(c) + tie, digits) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


#: Far above the error of a sum of delays, far below the last digit compared.
TIE = 1e-9


def r_sql(columns: str, source: str, doubles: str) -> str:
    return f"select {columns}, " + ", ".join(f"round({c}, {R}) as {c}" for c in doubles.split(", ")) + f" from {source}"


def lab(s, d):
    return bl.labelled(labels(s, d), C)


def flags(s, d):
    return bl.flag_disruption_days(bl.daily_stats(journeys(s, d)), C)


def prior(s, d):
    """Points with their baselines; calibration, its rolling form and the intervals of one replay each read it."""

    def make():
        x = lab(s, d)
        return bl.historical_median(x, bl.fit_medians(x, C))

    return shared(s, d, "prior", make)


def states(s, d):
    j = journeys(s, d)
    return ft.stop_states(j, ft.segment_reference(j, C), ft.dwell_reference(j, C))


def features(s, d):
    days = F.broadcast(flags(s, d).select("operating_day", "is_disruption_day"))
    return ft.train_features(labels(s, d), states(s, d), prior(s, d).join(days, "operating_day", "left"), C)


def events(s, d):
    return nw.network_events(trains(s, d), C)


def points(s, d):
    return shared(s, d, "points", lambda: nw.prediction_points(journeys(s, d), labels(s, d), C))


def stations(s, d):
    return shared(s, d, "station_minutes", lambda: nw.station_minutes(events(s, d), C))


def segments(s, d):
    return shared(s, d, "segment_minutes", lambda: nw.segment_minutes(nw.segment_departures(events(s, d))))


DAY_D = "mean_delay_min, p90_delay_min, cancelled_runs_share"
q("K08_daily_stats", r_sql("operating_day, runs, prediction_points", "days", DAY_D), DAYS, lambda s, d: rounded(bl.daily_stats(journeys(s, d))))
q("K09_disruption_days", r_sql("operating_day, is_disruption_day", "flags", "disruption_score, disruption_threshold"), DAYS, lambda s, d: rounded(flags(s, d).select("operating_day", "is_disruption_day", "disruption_score", "disruption_threshold")))
q("K10_simple_baselines", r_sql(K, "prior", "pred_persistence, pred_offset"), DAYS, lambda s, d: rounded(prior(s, d).select("trip_key", "stop_seq", "horizon_min", "pred_persistence", "pred_offset")))
q("K11_historical_median", r_sql(f"{K}, hist_level", "prior", "pred_historical"), DAYS, lambda s, d: rounded(prior(s, d).select("trip_key", "stop_seq", "horizon_min", "hist_level", "pred_historical")))
q("C09_cascade", "select hist_level, count(*) as n from prior group by all", DAYS, lambda s, d: prior(s, d).groupBy("hist_level").agg(F.count("*").alias("n")))
q("D10_group_medians", " union all ".join(f"select {i} as level, count(*) as groups, sum(n)::bigint as n, round(avg(value), 6) as mean_value from h{i}" for i in range(5)), DAYS,
  lambda s, d: reduce(lambda a, b: a.union(b), [t.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.lit(i).alias("level"), "groups", "n", "mean_value") for i, t in enumerate(bl.fit_medians(lab(s, d), C))]))
q("K12_segment_reference", r_sql("from_station_id, to_station_id, n", "segref", "planned_run_median_min, run_ref_min"), FEATURES, lambda s, d: rounded(ft.segment_reference(journeys(s, d), C)))
q("K13_dwell_reference", r_sql("station_id, category, n", "dwellref", "dwell_ref_min"), FEATURES, lambda s, d: rounded(ft.dwell_reference(journeys(s, d), C)))
FEAT = {
    "K14_timetable_slack": ("", "slack_to_target_min, run_reserve_to_target_min, dwell_reserve_to_target_min"),
    "K15_history_features": ("n_observed_prev", "delay_lag1_min, delta_last1_min, delay_lag3_min, delta_last3_min, delay_lag5_min, delta_last5_min, trend3_per10min, trend5_per10min, max_prev_delay_min"),
    "K16_timetable_features": ("n_stops_to_target, stops_remaining", "sched_gap_min, frac_journey, minutes_since_origin, planned_dwell_now_min"),
    "K17_context_features": ("hour, weekday, day_type, category, operator_abbr, enters_from_abroad, is_extra_trip", ""),
    "K18_current_features": ("", "d0_min, arr_delay_now_min, dwell_excess_now_min"),
}
for _name, (_plain, _doubles) in FEAT.items():
    _all = [c for c in f"{_plain}, {_doubles}".replace(" ", "").split(",") if c]
    _cols = f"{K}, {_plain}" if _plain else K
    q(_name, r_sql(_cols, "feat", _doubles) if _doubles else f"select {_cols} from feat", FEATURES, lambda s, d, cols=_all: rounded(features(s, d).select("trip_key", "stop_seq", "horizon_min", *cols)))
FEAT_D = "delta_min, pred_historical, d0_min, arr_delay_now_min, dwell_excess_now_min, delay_lag1_min, delta_last1_min, delay_lag3_min, delta_last3_min, delay_lag5_min, delta_last5_min, trend3_per10min, trend5_per10min, max_prev_delay_min, " \
    "slack_to_target_min, run_reserve_to_target_min, dwell_reserve_to_target_min, sched_gap_min, frac_journey, minutes_since_origin, planned_dwell_now_min"  # fmt: skip
q("K19_train_features", f"select * replace ({', '.join(f'round({c}, {R}) as {c}' for c in FEAT_D.split(', '))}) from feat", FEATURES, lambda s, d: rounded(features(s, d)))
q("K20_network_events", r_sql("trip_key, station_id, arr_actual, dep_actual", "ne", "arr_d, dep_d"), NET, lambda s, d: rounded(events(s, d).select("trip_key", "station_id", "arr_actual", "dep_actual", "arr_d", "dep_d")))
q("K21_segment_departures", r_sql("from_station_id, to_station_id, dep_s, arr_s", "dp", "dep_d, arr_d"), NET, lambda s, d: rounded(nw.segment_departures(events(s, d))))
q("K22_minute_tables", "select 'station' as what, count(*) as minutes, sum(n)::bigint as n, round(sum(s), 5) as s from ms union all select 'segment', count(*), sum(n)::bigint, round(sum(s), 5) from mg union all select 'all', count(*), sum(n)::bigint, round(sum(s), 5) from mn", NET,
  lambda s, d: reduce(lambda a, b: a.union(b), [t.agg(F.count("*").alias("minutes"), F.sum("n").alias("n"), F.round(F.sum("s"), 5).alias("s")).select(F.lit(k).alias("what"), "minutes", "n", "s")
      for k, t in (("station", stations(s, d)), ("segment", segments(s, d)), ("all", nw.network_minutes(stations(s, d))))]))
q("D11_minute_counts", "select station_id, minute, n, round(s, 6) as s, l from ms", NET, lambda s, d: rounded(stations(s, d)))
q("K23_prediction_points", f"select {K}, cur_station_id, next_station_id, target_station_id, target_seq from pts", NET, lambda s, d: points(s, d).select(*nw.KEYS, "cur_station_id", "next_station_id", "target_station_id", "target_seq"))
q("K24_cutoff", f"select {K}, m_end, cut_s from pts", NET, lambda s, d: points(s, d).select(*nw.KEYS, "m_end", "cut_s"))
WIN = NET | {f"w_{p}_{w}": window_sql(c, w) for p, c in (("cur", "cur_station_id"), ("next", "next_station_id"), ("tgt", "target_station_id")) for w in (10, 30, 60)}
WIN |= {f"g_{w}": f"select p.trip_key, p.stop_seq, p.horizon_min, coalesce(sum(n), 0)::bigint as n, sum(s) as s from pts p left join mg on from_station_id = cur_station_id and to_station_id = next_station_id and minute > m_end - {w} and minute <= m_end group by all" for w in (10, 30)}
WIN |= {"ends": "select distinct m_end from pts"} | {f"a_{w}": f"select m_end, coalesce(sum(n), 0)::bigint as n, sum(s) as s, sum(l) as l from ends left join mn on minute > m_end - {w} and minute <= m_end group by all" for w in (10, 30, 60)}
WIN |= {
    "along": "select p.trip_key, p.stop_seq, p.horizon_min, m_end, r.stop_seq as k, r.station_id, q.station_id as prev_id from pts p join journeys r on r.trip_key = p.trip_key and r.stop_seq > p.stop_seq and r.stop_seq <= p.target_seq join journeys q on q.trip_key = r.trip_key and q.stop_seq = r.stop_seq - 1",
    "cs": f"select {K}, coalesce(sum(n), 0)::bigint as n, sum(s) as s, sum(l) as l from along left join ms on ms.station_id = along.station_id and minute > m_end - 30 and minute <= m_end group by {K}",
    "cg0": f"select {K}, k, coalesce(sum(n), 0) as n, sum(s) as s from along left join mg on from_station_id = prev_id and to_station_id = along.station_id and minute > m_end - 30 and minute <= m_end group by {K}, k",
    "cg": f"select {K}, sum(n)::bigint as gn, sum(s) as gs, sum(s / nullif(n, 0)) as gain_sum, avg((n > 0)::double) as coverage from cg0 group by {K}",
    "near": f"select p.trip_key, p.stop_seq, p.horizon_min, max(struct_pack(a := dep_s, b := dep_d, c := coalesce(arr_s, -1), d := arr_d)) as x from pts p join dp on from_station_id = cur_station_id and to_station_id = next_station_id and dep_s < cut_s and dep_s > cut_s - {60 * C.ahead_max_min} group by all",
    "ahead": f"select {K}, (epoch(t_pred) - x.a) / 60.0 as net_ahead_headway_min, x.b as net_ahead_dep_delay, if(x.c >= 0 and x.c < cut_s, x.d - x.b, null) as net_ahead_seg_gain from pts left join near using ({K}) where next_station_id is not null",
}
WIN |= {
    f"f_{p}": f"select {K}, a.n as net_{p}_n, a.s / nullif(a.n, 0) as net_{p}_mean_delay, a.l / nullif(a.n, 0) as net_{p}_share_late, b.n as net_{p}_n_10, b.s / nullif(b.n, 0) as net_{p}_mean_delay_10, c.s / nullif(c.n, 0) as net_{p}_mean_delay_60 "
    f"from w_{p}_30 a join w_{p}_10 b using ({K}) join w_{p}_60 c using ({K})"
    for p in ("cur", "next", "tgt")
}
WIN |= {
    "f_seg": f"select {K}, a.n as net_seg_n, a.s / nullif(a.n, 0) as net_seg_mean_gain, b.n as net_seg_n_10, b.s / nullif(b.n, 0) as net_seg_mean_gain_10 from g_30 a join g_10 b using ({K})",
    "f_all": f"select {K}, a.s / nullif(a.n, 0) as net_all_mean_delay, a.l / nullif(a.n, 0) as net_all_share_late, b.s / nullif(b.n, 0) as net_all_mean_delay_10, b.l / nullif(b.n, 0) as net_all_share_late_10, c.s / nullif(c.n, 0) as net_all_mean_delay_60 from pts join a_30 a using (m_end) join a_10 b using (m_end) join a_60 c using (m_end)",
    "f_cor": f"select {K}, n as net_cor_n, s / nullif(n, 0) as net_cor_mean_delay, l / nullif(n, 0) as net_cor_share_late, gn as net_cor_seg_n, gs / nullif(gn, 0) as net_cor_seg_mean_gain, gain_sum as net_cor_gain_sum, coverage as net_cor_seg_coverage from cs join cg using ({K})",
}
CUR_D = "net_cur_mean_delay, net_cur_share_late, net_cur_mean_delay_10, net_cur_mean_delay_60"
NEXT_D = "net_next_mean_delay, net_next_share_late, net_next_mean_delay_10"
TGT_D = "net_tgt_mean_delay, net_tgt_share_late"
SEG_D = "net_seg_mean_gain, net_seg_mean_gain_10"
ALL_D = "net_all_mean_delay, net_all_share_late, net_all_mean_delay_10, net_all_share_late_10, net_all_mean_delay_60"
COR_D = "net_cor_mean_delay, net_cor_share_late, net_cor_seg_mean_gain, net_cor_gain_sum, net_cor_seg_coverage"
AHEAD_D = "net_ahead_headway_min, net_ahead_dep_delay, net_ahead_seg_gain"
q("K25_station_state", r_sql(f"{K}, net_cur_n, net_next_n, net_tgt_n", f"f_cur join f_next using ({K}) join f_tgt using ({K})", "net_cur_mean_delay, net_cur_share_late, net_next_mean_delay, net_next_share_late, " + TGT_D), WIN,
  lambda s, d: rounded(nw.station_state(stations(s, d), points(s, d), "cur", "cur_station_id").join(nw.station_state(stations(s, d), points(s, d), "next", "next_station_id"), nw.KEYS).join(
      nw.station_state(stations(s, d), points(s, d), "tgt", "target_station_id"), nw.KEYS).drop("net_cur_n_10", "net_cur_mean_delay_10", "net_cur_mean_delay_60", "net_next_n_10", "net_next_mean_delay_10")))
q("K26_segment_state", r_sql(f"{K}, net_seg_n", "f_seg", "net_seg_mean_gain"), WIN, lambda s, d: rounded(nw.segment_state(segments(s, d), points(s, d)).drop("net_seg_n_10", "net_seg_mean_gain_10")))
q("K27_network_state", r_sql(K, "f_all", ALL_D).replace(f", {R}) as", f" + {TIE}, {R}) + 0 as"), WIN, lambda s, d: unsigned(tie=TIE, df=nw.network_state(nw.network_minutes(stations(s, d)), points(s, d))))
q("K28_trend_state", r_sql(f"{K}, net_cur_n_10", "f_cur", "net_cur_mean_delay_10, net_cur_mean_delay_60"), WIN, lambda s, d: rounded(nw.station_state(stations(s, d), points(s, d), "cur", "cur_station_id").drop("net_cur_n", "net_cur_mean_delay", "net_cur_share_late")))
q("E08_trailing_sums", f"select {K}, n as n_30, round(coalesce(s, 0), 6) as s_30 from w_cur_30", WIN, lambda s, d: nw.trailing_sums(stations(s, d), points(s, d), {"station_id": "cur_station_id"}, nw.KEYS, (10, 30, 60)).select(*nw.KEYS, F.col("n_30").cast("long").alias("n_30"), F.round("s_30", 6).alias("s_30")))
q("C07_as_of_totals", f"select {K}, n as n_60 from w_next_60", WIN, lambda s, d: nw.trailing_sums(stations(s, d), points(s, d), {"station_id": "next_station_id"}, nw.KEYS, (60,)).select(*nw.KEYS, F.col("n_60").cast("long").alias("n_60")))
q("K29_corridor_state", r_sql(f"{K}, net_cor_n, net_cor_seg_n", "f_cor", COR_D), WIN, lambda s, d: rounded(nw.corridor_state(stations(s, d), segments(s, d), points(s, d), journeys(s, d))))
q("K30_train_ahead", r_sql(K, "ahead", AHEAD_D), WIN, lambda s, d: rounded(nw.last_before(nw.segment_departures(events(s, d)), points(s, d), C)))
q("C08_as_of_strict", f"select {K}, round(net_ahead_headway_min, 6) as headway from ahead where net_ahead_headway_min is not null", WIN,
  lambda s, d: nw.last_before(nw.segment_departures(events(s, d)), points(s, d), C).where("net_ahead_headway_min is not null").select(*nw.KEYS, F.round("net_ahead_headway_min", 6).alias("headway")))
q("K31_network_features", r_sql(f"{K}, net_cur_n, net_cur_n_10, net_next_n, net_next_n_10, net_tgt_n, net_seg_n, net_seg_n_10, net_cor_n, net_cor_seg_n",
  f"f_cur join f_next using ({K}) join f_tgt using ({K}) join f_seg using ({K}) join f_all using ({K}) left join f_cor using ({K}) left join ahead using ({K})", ", ".join([CUR_D, NEXT_D, TGT_D, SEG_D, ALL_D, COR_D, AHEAD_D])).replace(f", {R}) as", f" + {TIE}, {R}) + 0 as"), WIN,
  lambda s, d: unsigned(tie=TIE, df=nw.features_of(stations(s, d), segments(s, d), nw.segment_departures(events(s, d)), points(s, d), journeys(s, d), C)))
