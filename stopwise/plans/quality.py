"""Queries of evaluation, calibration and monitoring, on the historical median with fixed spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.operators import calibrate as cb
from stopwise.operators import evaluate as ev
from stopwise.operators import monitor as mo
from stopwise.operators import network as nw
from stopwise.plans.core import shared
from stopwise.plans.domain import DAYS, NET, K, flags, points, prior, q, rounded, stations, unsigned, window_sql

BUCKET = "case when d0_min < 1 then '<1' when d0_min < 3 then '1-3' when d0_min < 10 then '3-10' else '>10' end"
PRED = DAYS | {"pred": f"select {K}, operating_day, split, d0_min, delta_min as y, pred_historical as p50, pred_offset as base, pred_historical - 3 as q10, pred_historical + 3 as q90, {BUCKET} as d0_bucket from prior"}
DRAWS = 1000


def pred(s, d, *more: str):
    return prior(s, d).select(
        "trip_key", "stop_seq", "horizon_min", "operating_day", "split", "d0_min", F.col("delta_min").alias("y"), F.col("pred_historical").alias("p50"), F.col("pred_offset").alias("base"),
        (F.col("pred_historical") - 3).alias("q10"), (F.col("pred_historical") + 3).alias("q90"), *more,
    )


def boot(err: str, by: str, where: str = "true", source: str = "pred") -> dict[str, str]:
    """Expressions of the day-clustered interval."""
    return PRED | {
        "ds": f"select {by}, operating_day, sum({err}) as err, count(*) as n from {source} where {err} is not null and {where} group by all",
        "ix": f"select *, row_number() over (partition by {by} order by operating_day) - 1 as i, count(*) over (partition by {by}) as days_ from ds",
        "dr": f"select {by}, b, j, ('0x' || substr(md5('1|' || b || '|' || j), 1, 8))::bigint % days_ as i from ix, unnest(range({DRAWS})) as t(b), lateral (select ix.i as j) where true",
        "bm": f"select {by}, b, sum(err) / sum(n) as m from dr join ix using ({by}, i) group by all",
        "ci": f"select {by}, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bm group by all",
        "tot": f"select {by}, sum(n)::bigint as n, sum(err) / sum(n) as value from ds group by all",
    }


CI = "n, round(value, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi"
q("M01_day_sums", "select horizon_min, operating_day, round(sum(abs(y - p50)), 6) as err, count(*) as n from pred where p50 is not null group by all", PRED, lambda s, d: rounded(ev.day_sums(pred(s, d), F.abs(F.col("y") - F.col("p50")), ["horizon_min"])))
q("M02_bootstrap_ci", f"select horizon_min, {CI} from tot join ci using (horizon_min)", boot("abs(y - base)", "horizon_min"), lambda s, d: rounded(ev.bootstrap_ci(ev.day_sums(pred(s, d), F.abs(F.col("y") - F.col("base")), ["horizon_min"]), ["horizon_min"], draws=DRAWS)))
q("M03_mae_ci", f"select horizon_min, {CI} from tot join ci using (horizon_min)", boot("abs(y - p50)", "horizon_min"), lambda s, d: rounded(ev.mae_ci(pred(s, d), "y", "p50", ["horizon_min"], draws=DRAWS)))
q("M04_mae_diff_ci", f"select horizon_min, {CI}, lo > 0 or hi < 0 as significant from tot join ci using (horizon_min)", boot("abs(y - p50) - abs(y - base)", "horizon_min"), lambda s, d: rounded(ev.mae_diff_ci(pred(s, d), "y", "p50", "base", ["horizon_min"], draws=DRAWS)))
LONG = {"longp": "select horizon_min, operating_day, y, 'p50' as model, p50 as v from pred where p50 is not null union all select horizon_min, operating_day, y, 'base', base from pred where base is not null"}
_b5 = boot("abs(y - v)", "horizon_min, model", source="longp")
_b5 = PRED | LONG | {k: v for k, v in _b5.items() if k not in PRED} | {"ex": "select horizon_min, model, count(distinct operating_day) as days, quantile_cont(abs(y - v), 0.9) as p90 from longp group by all"}
q("M05_evaluate", f"select horizon_min, model, {CI}, days, round(p90, 6) as p90 from tot join ci using (horizon_min, model) join ex using (horizon_min, model)", _b5, lambda s, d: rounded(ev.evaluate(pred(s, d), "y", ["p50", "base"], ["horizon_min"], draws=DRAWS)))
q("M06_stratified_diff", f"select d0_bucket, {CI}, lo > 0 or hi < 0 as significant from tot join ci using (d0_bucket)", boot("abs(y - p50) - abs(y - base)", "d0_bucket"),
  lambda s, d: rounded(ev.mae_diff_ci(pred(s, d).withColumn("d0_bucket", ev.d0_bucket("d0_min", C)), "y", "p50", "base", ["d0_bucket"], draws=DRAWS)))
IM = "count(*) as n, round(avg((y between q10 and q90)::int), 8) as coverage, round(avg((y < q10)::int), 8) as below, round(avg((y > q90)::int), 8) as above, round(avg(q90 - q10), 8) as width_mean, round(median(q90 - q10), 8) as width_median, " \
    "round(avg((q10 > q90)::int), 8) as crossing, round(avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))), 8) as pinball_lo, round(avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))), 8) as pinball_hi"  # fmt: skip
q("M07_interval_metrics", f"select horizon_min, {IM} from pred where p50 is not null group by all", PRED, lambda s, d: rounded(ev.interval_metrics(pred(s, d).where("p50 is not null"), "y", "q10", "q90", ["horizon_min"]), 8))
q("M08_interval_report", f"select horizon_min, d0_bucket, {IM} from (select * from pred where p50 is not null union all select * replace ('all' as d0_bucket) from pred where p50 is not null) group by all", PRED,
  lambda s, d: rounded(ev.interval_report(pred(s, d).where("p50 is not null"), "y", "q10", "q90", C), 8))


def hq(x: str, c: float, by: str, source: str = "pred") -> str:
    """Order statistic of each group, by sorted lists."""
    n = "count(*) filter (where x is not null)"
    return f"select {by}, {n} as n, list(x order by x) filter (where x is not null) as xs, xs[ceil((n - 1) * least(1.0, ceil((n + 1) * {c}::double) / n))::int + 1] as v from (select *, {x} as x from {source}) group by {by} having {n} > 0"


RES = "greatest(q10 - y, y - q90)"
q("M09_higher_quantile", "select horizon_min, n, round(v, 6) as v from hq", PRED | {"hq": hq("abs(y - p50)", 0.9, "horizon_min")}, lambda s, d: rounded(cb.higher_quantile(pred(s, d), F.abs(F.col("y") - F.col("p50")), 0.9, ["horizon_min"], "v")))
q("M10_conformal_offset", "select horizon_min, n, round(v, 6) as off from hq".replace("off", '"offset"'), PRED | {"hq": hq(RES, 0.8, "horizon_min")}, lambda s, d: rounded(cb.conformal_offset(pred(s, d), "y", "q10", "q90", ["horizon_min"])))
CAL = PRED | {"own": hq(RES, 0.8, "horizon_min, d0_bucket", "(select * from pred where split <> 'train')"), "pool": hq(RES, 0.8, "horizon_min", "(select * from pred where split <> 'train')"),
              "cal": "select p.horizon_min, b.b as d0_bucket, coalesce(o.n, 0) as n, if(coalesce(o.n, 0) >= 200, o.v, p.v) as off from pool p cross join (values ('<1'), ('1-3'), ('3-10'), ('>10')) b(b) left join own o on o.horizon_min = p.horizon_min and o.d0_bucket = b.b"}
held = lambda s, d: pred(s, d).where("split <> 'train'")
q("M11_calibrate", 'select horizon_min, d0_bucket, n, round(off, 6) as "offset" from cal', CAL, lambda s, d: rounded(cb.calibrate(held(s, d), "y", "q10", "q90", C)))
q("M12_tail_offsets", "select horizon_min, round(a.v, 6) as lo_offset, b.n, round(b.v, 6) as hi_offset from ta a join tb b using (horizon_min)", PRED | {"ta": hq("q10 - y", 0.9, "horizon_min"), "tb": hq("y - q90", 0.9, "horizon_min")},
  lambda s, d: rounded(cb.tail_offsets(pred(s, d), "y", "q10", "q90", ["horizon_min"])))
#: As the service does it: a queue of the last 14 scored days, used from 7 on; buckets of less than 200 points take the offsets of their horizon.
BINS = "(values ('<1'), ('1-3'), ('3-10'), ('>10')) k(b)"
ROLL = {
    "dd": "select operating_day, dense_rank() over (order by operating_day) as r from (select distinct operating_day from pred)",
    "tr": "select f.operating_day as for_day, f.r, p.* from pred p join dd e on e.operating_day = p.operating_day join dd f on f.r > e.r and f.r <= e.r + 14",
    "tb": "select *, d0_bucket as b from tr union all select *, 'all' from tr",
    "ro": hq(RES, 0.8, "for_day, r, horizon_min, b", "tb"),
    "rl": hq("q10 - y", 0.9, "for_day, r, horizon_min, b", "tb"),
    "rh": hq("y - q90", 0.9, "for_day, r, horizon_min, b", "tb"),
    "rx": "select for_day, r, horizon_min, b, ro.n, ro.v as o, rl.v as l, rh.v as h from ro join rl using (for_day, r, horizon_min, b) join rh using (for_day, r, horizon_min, b)",
    "roll": "select p.for_day, p.horizon_min, k.b as d0_bucket, least(p.r - 1, 14) as days, coalesce(x.n, 0) as n, if(coalesce(x.n, 0) >= 200, x.o, p.o) as off, "
    "if(coalesce(x.n, 0) >= 200, x.l, p.l) as lo_offset, if(coalesce(x.n, 0) >= 200, x.h, p.h) as hi_offset "
    f"from rx p cross join {BINS} left join rx x on x.for_day = p.for_day and x.horizon_min = p.horizon_min and x.b = k.b where p.b = 'all' and p.r > 7",
}
ROLLED = 'days, n, round(off, 6) as "offset", round(lo_offset, 6) as lo_offset, round(hi_offset, 6) as hi_offset'
q(
    "M13_rolling_offsets", f"select for_day, horizon_min, d0_bucket, {ROLLED} from roll", PRED | ROLL,
    lambda s, d: rounded(cb.rolling_offsets(pred(s, d), "y", "q10", "q90", C)),
)
q("E12_trailing_days", "select for_day, horizon_min, count(*) as n, count(distinct operating_day) as days from tr group by all", PRED | ROLL, lambda s, d: cb.trailing_days(pred(s, d), 14).groupBy("for_day", "horizon_min").agg(F.count("*").alias("n"), F.count_distinct("operating_day").alias("days")))


def bound_sql(name: str, down: str, up: str) -> str:
    """Both ends of one strategy, sorted with the median."""
    three = f"list_sort([q10 - {down}, p50, q90 + {up}])"
    return f"{three}[1] as lo_{name}, {three}[3] as hi_{name}"


BOUNDS = ", ".join([
    bound_sql("static", "coalesce(c.off, 0)", "coalesce(c.off, 0)"),
    bound_sql("rolling", "coalesce(r.off, c.off, 0)", "coalesce(r.off, c.off, 0)"),
    bound_sql("rolling_tails", "coalesce(r.lo_offset, c.off, 0)", "coalesce(r.hi_offset, c.off, 0)"),
])
REPLAY = CAL | ROLL | {
    "iv": f"select p.*, {BOUNDS} from pred p left join cal c on c.horizon_min = p.horizon_min and c.d0_bucket = p.d0_bucket "
    "left join roll r on r.for_day = p.operating_day and r.horizon_min = p.horizon_min and r.d0_bucket = p.d0_bucket where p50 is not null",
}
ENDS = [f"{e}_{n}" for n in cb.STRATEGIES for e in ("lo", "hi")]


def bounded(s, d, rows=None):
    """The points of the replay with the bounds of all strategies."""
    rows = pred(s, d).where("p50 is not null") if rows is None else rows
    return cb.intervals(rows, cb.calibrate(held(s, d), "y", "q10", "q90", C), cb.rolling_offsets(pred(s, d), "y", "q10", "q90", C), "p50", "q10", "q90", C)


q(
    "M14_intervals", f"select trip_key, stop_seq, horizon_min, {', '.join(f'round({c}, 6) as {c}' for c in ENDS)} from iv", REPLAY,
    lambda s, d: rounded(bounded(s, d).select("trip_key", "stop_seq", "horizon_min", *ENDS)),
)
DRIFT = PRED | {
    "ed": "select list_sort(list_distinct(quantile_cont(d0_min, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as edges, count(*) as n, count(d0_min) as known from pred where split = 'train'",
    "rb": "select len(list_filter(edges, lambda e: e <= d0_min)) as bin, count(*) / any_value(known) as share from pred, ed where split = 'train' group by all",
    "rs": "select i as bin, coalesce(share, 0) as e from ed, unnest(range(len(edges) + 1)) t(i) left join rb on rb.bin = t.i",
    "ab": "select operating_day, horizon_min, len(list_filter(edges, lambda e: e <= d0_min)) as bin, count(*) as c from pred, ed group by all",
    "an": "select operating_day, horizon_min, sum(c) as n from ab group by all",
    "psi": "select operating_day, horizon_min, sum((greatest(coalesce(c, 0) / n, 1e-4) - greatest(e, 1e-4)) * ln(greatest(coalesce(c, 0) / n, 1e-4) / greatest(e, 1e-4))) as psi from an cross join rs left join ab using (operating_day, horizon_min, bin) group by all",
}
ref = lambda s, d: mo.drift_reference(pred(s, d).where("split = 'train'"), "d0_min")
q("M15_drift_reference", "select bin::int as bin, round(e, 6) as share from rs", DRIFT, lambda s, d: ref(s, d).select(F.posexplode("shares").alias("bin", "share")).select("bin", F.round("share", 6).alias("share")))
q("M16_psi", "select operating_day, horizon_min, round(psi, 6) as psi from psi", DRIFT, lambda s, d: rounded(mo.psi(pred(s, d), "d0_min", ref(s, d), ["operating_day", "horizon_min"])))
#: The replay's daily row for each horizon, column by column as the service publishes it.
FEATURES = ["d0_min", "hour", "net_cur_n"]
KEY = "trip_key, stop_seq, horizon_min"
BY_STRATEGY = ", ".join(
    f"avg((y between lo_{n} and hi_{n})::int) as coverage_{n}, avg((y < lo_{n})::int) as below_{n}, avg((y > hi_{n})::int) as above_{n}, median(hi_{n} - lo_{n}) as width_{n}" for n in cb.STRATEGIES
)
SCORE = REPLAY | NET | {
    "cn": window_sql("cur_station_id", 30),
    "rows_": f"select iv.*, l.hour, cn.n as net_cur_n from iv join lab l using ({KEY}) join cn using ({KEY})",
    "fx": " union all ".join(f"select operating_day, horizon_min, split, '{f}' as feature, {f}::double as x from rows_" for f in FEATURES),
    "fe": "select horizon_min, feature, list_sort(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as edges, count(x) as known from fx where split = 'train' group by all",
    "fb": "select horizon_min, feature, len(list_filter(edges, lambda e: e <= x)) as bin, count(*) as c from fx join fe using (horizon_min, feature) where split = 'train' and x is not null group by all",
    "fs": "select fe.horizon_min, fe.feature, i as bin, greatest(coalesce(c, 0) / known, 1e-4) as e from fe, unnest(range(len(edges) + 1)) t(i) "
    "left join fb on fb.horizon_min = fe.horizon_min and fb.feature = fe.feature and fb.bin = i",
    "fa": "select operating_day, horizon_min, feature, len(list_filter(edges, lambda e: e <= x)) as bin, count(*) as c from fx join fe using (horizon_min, feature) where x is not null group by all",
    "fn": "select operating_day, horizon_min, feature, sum(c) as n from fa group by all",
    "fp": "select operating_day, horizon_min, feature, sum((greatest(coalesce(c, 0) / n, 1e-4) - e) * ln(greatest(coalesce(c, 0) / n, 1e-4) / e)) as psi "
    "from fn join fs using (horizon_min, feature) left join fa using (operating_day, horizon_min, feature, bin) group by all",
    "dayno": "select operating_day, least(row_number() over (order by operating_day) - 1, 14) as rolling_window_days from (select distinct operating_day from rows_)",
    "score0": "select operating_day, horizon_min, count(*) as n, avg(abs(y - p50)) as mae, quantile_cont(abs(y - p50), 0.9) as p90_abs_err, avg(abs(y - base)) as mae_historical, "
    f"1 - avg(abs(y - p50)) / avg(abs(y - base)) as skill_vs_historical, {BY_STRATEGY} from rows_ group by all",
    "score": "select s.*, rolling_window_days, coalesce(is_disruption_day, false) as is_disruption_day, "
    + ", ".join(f"(select psi from fp where fp.operating_day = s.operating_day and fp.horizon_min = s.horizon_min and feature = '{f}') as psi_{f}" for f in FEATURES)
    + " from score0 s join dayno using (operating_day) left join flags using (operating_day)",
    "past": "select *, list_sort(list(mae) over (partition by horizon_min order by operating_day rows between 14 preceding and 1 preceding)) as before from score",
    "alerted": "select *, concat_ws(',', " + ", ".join(f"if(psi_{f} > 0.25, 'drift:{f}', null)" for f in FEATURES) + ", if(coverage_rolling_tails < 0.7, 'low_coverage', null), "
    "if(len(before) >= 7 and mae > 1.25 * (before[(len(before) - 1) // 2 + 1] + before[len(before) // 2 + 1]) / 2, 'mae_jump', null)) as alerts from past",
}
MEASURES = ["mae", "p90_abs_err", "mae_historical", "skill_vs_historical", *[f"{k}_{n}" for n in cb.STRATEGIES for k in ("coverage", "below", "above", "width")], *[f"psi_{f}" for f in FEATURES]]
SC = "n, rolling_window_days, is_disruption_day, " + ", ".join(f"round({c}, 6) + 0 as {c}" for c in MEASURES)


def replay_rows(s, d):
    """Points with the bounds of all strategies and the features watched for drift."""
    keys = ["trip_key", "stop_seq", "horizon_min"]
    seen = nw.station_state(stations(s, d), points(s, d), "cur", "cur_station_id").select(*keys, "net_cur_n")
    return bounded(s, d, pred(s, d, "hour").where("p50 is not null")).join(seen, keys)


def scores(s, d):
    """The replay's daily table; queries of one session share it."""

    def make():
        rows = shared(s, d, "replay_rows", lambda: replay_rows(s, d))
        refs = mo.drift_references(rows.where("split = 'train'"), FEATURES, ["horizon_min"])
        daily = mo.with_window_days(mo.daily_scores(rows, "y", "p50", "base", cb.STRATEGIES))
        days = F.broadcast(flags(s, d).select("operating_day", "is_disruption_day"))
        flagged = daily.join(days, "operating_day", "left").withColumn("is_disruption_day", F.coalesce("is_disruption_day", F.lit(False)))
        return flagged.join(mo.drift(rows, FEATURES, refs, ["horizon_min"]), ["operating_day", "horizon_min"], "left")

    return shared(s, d, "daily_scores", make)


DAILY = ["operating_day", "horizon_min", "n", "rolling_window_days", "is_disruption_day", *MEASURES]
q("M17_daily_scores", f"select operating_day, horizon_min, {SC} from score", SCORE, lambda s, d: unsigned(scores(s, d).select(*DAILY)))
q("M18_alerts", "select operating_day, horizon_min, alerts from alerted", SCORE, lambda s, d: mo.alerts(scores(s, d)).select("operating_day", "horizon_min", "alerts"))
q(
    "E11_trailing_median",
    "select operating_day, horizon_min, len(coalesce(before, []))::int as n_before, "
    "round(if(len(before) >= 7, (before[(len(before) - 1) // 2 + 1] + before[len(before) // 2 + 1]) / 2, null), 6) as median_before from past",
    SCORE, lambda s, d: rounded(mo.trailing_median(scores(s, d), "mae")),
)
W4 = ", ".join(f"round(sum(n * {c}) / sum(n), 6) + 0 as {c}" for c in ("mae", "mae_historical", *[f"{k}_{n}" for n in cb.STRATEGIES for k in ("coverage", "above")]))
q(
    "M19_replay_summary", f"select horizon_min, is_disruption_day, count(*) as days, sum(n)::bigint as points, {W4} from score group by all", SCORE,
    lambda s, d: unsigned(mo.replay_summary(scores(s, d), ["horizon_min", "is_disruption_day"], cb.STRATEGIES)),
)
q(
    "M20_metrics_query", f"select operating_day, horizon_min, {SC} from score where horizon_min = 30 and operating_day between date '2024-01-10' and date '2024-01-20'", SCORE,
    lambda s, d: unsigned(mo.metrics_between(scores(s, d), 30, "2024-01-10", "2024-01-20").select(*DAILY)),
)
q(
    "M21_monthly_skill", "select strftime(operating_day, '%Y-%m') as month, horizon_min, sum(n)::bigint as n, round(sum(n * skill_vs_historical) / sum(n), 6) + 0 as skill from score group by all", SCORE,
    lambda s, d: unsigned(mo.monthly_skill(scores(s, d))),
)
q(
    "M21_skill_trend", "select horizon_min, round(30 * regr_slope(skill_vs_historical, date_diff('day', date '1970-01-01', operating_day)), 6) + 0 as trend_30d from score group by all", SCORE,
    lambda s, d: unsigned(mo.skill_trend(scores(s, d))),
)
q("L12_weight_sweep", "select w, round(avg(abs(y - (w / 10.0 * p50 + (1 - w / 10.0) * base))), 6) as mae from pred, unnest(range(11)) t(w) where p50 is not null group by all", PRED,
  lambda s, d: pred(s, d).where("p50 is not null").select("y", "p50", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("w")).groupBy("w").agg(
      F.round(F.avg(F.abs(F.col("y") - (F.col("w") / 10 * F.col("p50") + (1 - F.col("w") / 10) * F.col("base")))), 6).alias("mae")))
