"""Queries that fit Spark ML models on the features of ``events``, one model a horizon."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.config import EVENTS
from stopwise.operators import boost as bo
from stopwise.operators import calibrate as cb
from stopwise.operators import learn as ln
from stopwise.plans.core import shared, source_state
from stopwise.plans.domain import FEATURES, features
from stopwise.plans.oracles import oracle
from stopwise.plans.registry import query
from stopwise.sources.shared import shared_folder, stored

NOW = ["d0_min", "arr_delay_now_min", "dwell_excess_now_min"]
HISTORY = ["delay_lag1_min", "delta_last1_min", "delay_lag3_min", "delta_last3_min", "delay_lag5_min", "delta_last5_min", "trend3_per10min", "trend5_per10min", "max_prev_delay_min", "n_observed_prev"]
TIMETABLE = ["n_stops_to_target", "stops_remaining", "sched_gap_min", "frac_journey", "minutes_since_origin", "planned_dwell_now_min"]
SLACK = ["slack_to_target_min", "run_reserve_to_target_min", "dwell_reserve_to_target_min"]
NUMBERS = [*NOW, *HISTORY, *TIMETABLE, *SLACK]
NAMES = ["hour", "weekday", "day_type", "category", "operator_abbr", "enters_from_abroad", "is_extra_trip"]
#: Feature sets of the ablation: each adds a group or leaves one out.
SETS = {
    "now": (NOW, []), "now_history": (NOW + HISTORY, []), "now_timetable": (NOW + TIMETABLE, []), "now_slack": (NOW + SLACK, []), "now_context": (NOW, NAMES),
    "no_history": (NOW + TIMETABLE + SLACK, NAMES), "no_slack": (NOW + HISTORY + TIMETABLE, NAMES), "all": (NUMBERS, NAMES),
}
GROUPS = {c: g for g, cs in (("now", NOW), ("history", HISTORY), ("timetable", TIMETABLE), ("slack", SLACK), ("context", NAMES)) for c in cs}
KEYS = ["trip_key", "stop_seq", "horizon_min"]
HORIZONS = EVENTS.horizons
#: Boosting: an upper bound that the tuning days' loss stops well before, and how long it may fail to improve.
MOST, PATIENCE = 400, 6
ALPHAS = {"p50": 0.5, "q10": 0.1, "q90": 0.9}
FEATURES_ = [*NUMBERS, *NAMES]


def rows(s, d) -> DataFrame:
    """Labelled points with their features, rare categories folded as on the training days; stored by horizon and split, as every fit reads its own."""

    def make() -> DataFrame:
        f = features(s, d)
        f = f.select(*KEYS, "split", "delta_min", *[F.col(c).cast("double").alias(c) for c in NUMBERS], *[F.col(c).cast("string").alias(c) for c in NAMES])
        return f.where("delta_min is not null")

    f = shared(s, d, "model_features", make, ("horizon_min", "split"))
    return ln.folded(f, ln.common_names(f.where("split = 'train'"), NAMES))


def parts(f: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = f.where(F.col("horizon_min") == horizon)
    return h.where("split = 'train'"), h.where("split = 'valid'"), h.where("split = 'test'")


def each(jobs: list, run) -> list:
    """``run`` of all jobs, a few at a time, as Spark's own model search does."""
    with ThreadPoolExecutor(3) as pool:
        return list(pool.map(lambda job: run(*job), jobs))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def predicted(s, d, fit) -> DataFrame:
    f = rows(s, d)

    def one(horizon: int) -> DataFrame:
        a, b, t = parts(f, horizon)
        model, chosen = fit(a, b)
        return model.transform(ln.flagged(t, NUMBERS)).select(*KEYS, F.lit(float(chosen)).alias("chosen"), F.round("prediction", 6).alias("prediction"))

    return union(each([(h,) for h in HORIZONS], one))


def ridge(a, b, numbers=NUMBERS, names=NAMES):
    return ln.fit_ridge(a, b, "delta_min", numbers, names)


def boost_table(s, d) -> DataFrame:
    """The binned rows that all boosted models read; bins are those of the training days."""

    def make() -> DataFrame:
        f = rows(s, d)
        part = F.when(F.col("split") == "train", bo.FIT).when(F.col("split") == "valid", bo.TUNE).otherwise(bo.OTHER)
        b = bo.binning(f.where("split = 'train'"), NUMBERS, NAMES)
        return bo.prepare(f.where("split in ('train', 'valid', 'test')"), b, "horizon_min", "delta_min", part, KEYS)

    return shared(s, d, "boost_table", make)


def fitted(s, d, name: str, make) -> list[bo.Model]:
    """Models fitted once a session, kept as a table of their stages with losses and gains beside it."""
    key = (s.sparkContext.applicationId, *source_state(s, d), name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


#: Models by application, input and name: some thousand numbers each.
_fitted: dict[tuple, list[bo.Model]] = {}


def tuned(s, d) -> list[bo.Model]:
    """Median and quantile models of all horizons, stopped on the tuning days."""
    every = list(range(len(FEATURES_)))
    models = [bo.Model(f"{n}|{h}", h, a, every) for n, a in ALPHAS.items() for h in HORIZONS]
    return fitted(s, d, "tuned", lambda: bo.fit(boost_table(s, d), models, len(FEATURES_), MOST, PATIENCE))


def final(s, d) -> list[bo.Model]:
    """The second step: fitted again on training and tuning days, a tenth more trees each."""
    return fitted(s, d, "final", lambda: bo.refitted(boost_table(s, d), tuned(s, d), len(FEATURES_), MOST))


def test_rows(s, d) -> DataFrame:
    return boost_table(s, d).where(F.col("part") == bo.OTHER)


def boosted(s, d) -> DataFrame:
    """The second step's medians on the test days, and how many trees the tuning days chose."""
    chosen = F.create_map(*[F.lit(x) for m in tuned(s, d) if m.name.startswith("p50") for x in (m.group, float(m.best))])
    p = bo.predict(test_rows(s, d), [m for m in final(s, d) if m.name.startswith("p50")], KEYS)
    return p.select(*KEYS, chosen[F.col("horizon_min")].alias("chosen"), F.round("p50", 6).alias("prediction"))


def errors(s, d, models: list[bo.Model], name: str = "test_loss") -> DataFrame:
    """``(horizon_min, model, name)``: the pinball loss on the test days, twice which is the absolute error of a median."""
    names = list(dict.fromkeys(m.name.split("|")[0] for m in models))
    alpha = {m.name.split("|")[0]: m.alpha for m in models}
    p = bo.predict(test_rows(s, d), models, KEYS)
    loss = [F.avg(F.greatest(F.lit(alpha[n]) * (F.col("y") - F.col(n)), F.lit(alpha[n] - 1) * (F.col("y") - F.col(n)))).alias(n) for n in names]
    return p.groupBy("horizon_min").agg(*loss).unpivot(["horizon_min"], names, "model", name)


def refit(s, d) -> DataFrame:
    """Of each horizon and model the trees that the tuning days choose, a tenth more in the second step, and the test losses of both steps."""
    a, b = tuned(s, d), final(s, d)
    sizes = s.createDataFrame([(x.group, x.name.split("|")[0], x.best, len(y.trees), MOST) for x, y in zip(a, b, strict=True)], "horizon_min int, model string, chosen int, trees int, bound int")
    both = errors(s, d, a, "first_loss").join(errors(s, d, b, "second_loss"), ["horizon_min", "model"])
    return sizes.join(both, ["horizon_min", "model"])


def ablation(s, d) -> DataFrame:
    """Absolute error on the test days of each horizon, feature set and model: 24 boosted models grown together, and 24 ridges."""
    sets = {n: [FEATURES_.index(c) for c in [*numbers, *names]] for n, (numbers, names) in SETS.items()}
    models = [bo.Model(f"{n}|{h}", h, 0.5, ix) for n, ix in sets.items() for h in HORIZONS]
    made = fitted(s, d, "ablation", lambda: bo.fit(boost_table(s, d), models, len(FEATURES_), MOST, PATIENCE))
    trees_ = errors(s, d, made, "loss").select("horizon_min", F.col("model").alias("feature_set"), F.lit("trees").alias("model"), (2 * F.col("loss")).alias("test_mae"))
    f = rows(s, d)

    def one(horizon: int, name: str) -> tuple:
        a, b, t = parts(f, horizon)
        numbers, names = SETS[name]
        model, _ = ln.fit_ridge(a, b, "delta_min", numbers, names, (10.0,))
        return horizon, name, "ridge", ln.mae(model.transform(ln.flagged(t, numbers)), "delta_min")

    linear = s.createDataFrame(each([(h, n) for h in HORIZONS for n in SETS], one), "horizon_min int, feature_set string, model string, test_mae double")
    counts = test_rows(s, d).groupBy("horizon_min").agg(F.count("y").alias("n"))
    return trees_.unionByName(linear).join(counts, "horizon_min")


def first_stage(s, d) -> DataFrame:
    """Base and value after one stage of the 90th percentile, without features to split on."""
    models = bo.fit(boost_table(s, d), [bo.Model(f"q90|{h}", h, 0.9, []) for h in HORIZONS], len(FEATURES_), 1, share=1.0)
    first = [(m.group, m.base, m.base + 0.3 * float(m.trees[0].value[0])) for m in models]
    return s.createDataFrame(first, "horizon_min int, base double, first double").select("horizon_min", F.round("base", 6).alias("base"), F.round("first", 6).alias("first"))


def quantiles(s, d) -> DataFrame:
    """10th and 90th percentiles on the test days, by boosting on the pinball loss, in order."""
    p = bo.predict(test_rows(s, d), [m for m in final(s, d) if m.alpha != 0.5], KEYS)
    return p.select(*KEYS, F.least("q10", "q90").alias("q10"), F.greatest("q10", "q90").alias("q90"))


def importance(s, d) -> DataFrame:
    """Share of the boosted medians' gain of each group of features."""
    models = [m for m in final(s, d) if m.name.startswith("p50")]
    gains = [(m.group, GROUPS[FEATURES_[f]], v / sum(m.gain.values())) for m in models for f, v in m.gain.items()]
    gains += [(h, g, 0.0) for h in HORIZONS for g in dict.fromkeys(GROUPS.values())]
    return s.createDataFrame(gains, "horizon_min int, feature_group string, v double").groupBy("horizon_min", "feature_group").agg(F.round(F.sum("v"), 6).alias("share"))


def scored(s, d) -> DataFrame:
    """The frozen scorer: boosted median and quantiles, and offsets calibrated on the tuning days from models that have not learned from these."""
    first = bo.predict(boost_table(s, d).where(F.col("part") == bo.TUNE), [m for m in tuned(s, d) if m.alpha != 0.5], KEYS).withColumnRenamed("y", "delta_min")
    offsets = cb.conformal_offset(first, "delta_min", "q10", "q90", ["horizon_min"])
    p = bo.predict(test_rows(s, d), final(s, d), KEYS).drop("y")
    d0 = rows(s, d).where("split = 'test'").select(*KEYS, "d0_min")
    return ln.bounded(d0.join(p, KEYS), offsets).select(*KEYS, "d0_min", "p50", "q10", "q90", "lo", "hi")


def reloaded(s, d) -> DataFrame:
    """Largest difference of predictions after saving and loading, of ridges and of the boosted models' table of stages."""
    f = rows(s, d)

    def one(horizon: int) -> tuple:
        a, b, t = parts(f, horizon)
        most = ln.verify_reload(ridge(a, b)[0], shared_folder(s, "model"), t, NUMBERS)
        return horizon, "ridge", most, most <= 1e-3

    linear = s.createDataFrame(each([(h,) for h in HORIZONS], one), "horizon_min int, model string, largest_difference double, same boolean")
    models = final(s, d)
    back = bo.from_stages(stored(bo.stages(s, models), "stages"))
    again = [replace(m, name=f"again_{m.name}") for m in back]
    apart = F.greatest(*[F.abs(F.col(n) - F.col(f"again_{n}")) for n in ALPHAS])
    trees_ = bo.predict(test_rows(s, d), [*models, *again], KEYS).groupBy("horizon_min").agg(F.max(apart).alias("largest_difference"))
    return linear.unionByName(trees_.select("horizon_min", F.lit("boosted").alias("model"), "largest_difference", (F.col("largest_difference") <= 1e-3).alias("same")))


def answered(s, d) -> DataFrame:
    """Requests, some with an unknown horizon or without a delay, against the scorer: answers and rejections in one table."""
    known = stored(scored(s, d), "scored")
    odd = F.pmod(F.xxhash64("trip_key", "stop_seq"), F.lit(50))
    asked = known.select("trip_key", "stop_seq", F.when(odd == 0, 45).otherwise(F.col("horizon_min")).alias("horizon_min"), F.when(odd != 1, F.col("d0_min")).alias("d0_min"))
    good, bad = ln.predict_requests(asked, known.drop("d0_min"), ["d0_min"], HORIZONS)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select(*KEYS, "reason"), allowMissingColumns=True)


def prepared(s, d) -> DataFrame:
    """What the linear models see, by feature: rows, how many are missing or rare, and the mean after filling in the median."""
    f = rows(s, d)
    a = f.where("split = 'train'")
    filled = {r["name"]: r["median"] for r in ln.number_stats(a, NUMBERS).collect()}
    x = ln.flagged(a, NUMBERS).na.fill({c: v for c, v in filled.items() if v is not None})
    wide = x.agg(F.count("*").alias("n"), *[F.struct(F.sum(f"{c}_missing").cast("long").alias("marked"), F.round(F.avg(c), 6).alias("mean")).alias(c) for c in NUMBERS],
                 *[F.struct(F.count_if(F.col(c) == "infrequent").alias("marked"), F.lit(None).cast("double").alias("mean")).alias(c) for c in NAMES])
    return wide.unpivot(["n"], [*NUMBERS, *NAMES], "feature", "v").select("feature", "n", "v.*")


def coded(s, d) -> DataFrame:
    """Test rows in the form for networks: clipped deviations from training medians, and category codes."""
    f = rows(s, d)
    a, numbers, names = f.where("split = 'train'"), NOW + SLACK, ["category", "operator_abbr"]
    x = ln.coded(f.where("split = 'test'"), ln.number_stats(a, numbers), ln.category_codes(a, names), numbers, names)
    return x.select(*KEYS, *[(F.round(c, 6) + 0.0).alias(c) for c in numbers], *names)


_known = FEATURES | {"lf": "select * from feat where delta_min is not null", "tr": "select * from lf where split = 'train'"}
_filled = " union all ".join(
    [f"select '{c}' as feature, count(*) as n, count_if({c} is null)::bigint as marked, round(avg(coalesce({c}, (select median({c}) from tr))), 6) as mean from tr" for c in NUMBERS]
    + [f"select '{c}', sum(c), coalesce(sum(c) filter (where c < 100 and v is not null), 0)::bigint, null from (select {c}::varchar as v, count(*) as c from tr group by all)" for c in NAMES]
)
query("L01_preparation", oracle(_filled, "labels_", _known))(prepared)
_z = lambda c: f"round(coalesce(greatest(-10, least(10, ({c} - (select median({c}) from tr)) / (select if(stddev_pop({c}) > 0, stddev_pop({c}), 1) from tr))), 0), 6) + 0 as {c}"
_fold = lambda c: f"if({c} in (select {c} from tr group by all having count(*) >= 100), {c}, if({c} is null, null, 'infrequent'))"
_code = lambda c: f"coalesce((select r from (select v, row_number() over (order by v) as r from (select distinct {_fold(c)} as v from tr) where v is not null) where v = {_fold('t.' + c).replace('select t.', 'select ')}), 0)::int as {c}"
query("L02_codes", oracle(f"select trip_key, stop_seq, horizon_min, {', '.join(map(_z, NOW + SLACK))}, {_code('category')}, {_code('operator_abbr')} from lf t where split = 'test'", "labels_", _known))(coded)
query("L03_ridge")(lambda s, d: predicted(s, d, ridge))
query("L04_boosted_trees")(boosted)
query("L05_refit")(refit)
query("L06_ablation")(ablation)
query("L07_leaf_quantiles")(quantiles)
#: One stage of a model without sampling or features: the base and the one leaf of each horizon are quantiles of the training days.
query(
    "L07_first_stage",
    oracle(
        "select horizon_min, round(q, 6) as base, round(q + 0.3 * quantile_disc(delta_min - q, 0.9), 6) as first from tr join (select horizon_min, quantile_disc(delta_min, 0.9) as q from tr group by all) using (horizon_min) group by horizon_min, q",
        "labels_", _known,
    ),
)(first_stage)
query("L08_importance")(importance)
query("L09_scorer")(scored)
query("L10_reload")(reloaded)
query("L11_predict")(answered)
