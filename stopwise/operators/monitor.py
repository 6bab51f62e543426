"""Drift, daily scores, alerts and summaries of a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.columns import ratio


def drift_reference(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """One row: the distinct inner quantiles of x as edges, the share of each bin, and the share of nulls. A value on an edge belongs above it."""
    levels = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = df.agg(F.array_distinct(F.percentile(x, levels)).alias("edges"), F.count("*").alias("n"), F.count(x).alias("known"))
    binned = df.where(F.col(x).isNotNull()).join(F.broadcast(edges)).groupBy(F.size(F.filter("edges", lambda e: e <= F.col(x))).alias("bin"), "known").agg(F.count("*").alias("c"))
    shares = binned.agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("c") / F.col("known")))).alias("m"))
    spread = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return edges.join(F.broadcast(shares)).select("edges", spread.alias("shares"), (1 - F.col("known") / F.col("n")).alias("missing_share"))


def psi(df: DataFrame, x: str, reference: DataFrame, by: list[str], least: float = 1e-4) -> DataFrame:
    """Population stability index of x in each group against a reference row; null where a group knows no x."""
    r = F.broadcast(reference.select("edges", "shares"))
    binned = df.where(F.col(x).isNotNull()).join(r).groupBy(*by, F.size(F.filter("edges", lambda e: e <= F.col(x))).alias("bin")).agg(F.count("*").alias("c"))
    held = binned.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("n"))
    expected = held.join(r).select(*by, "n", "m", F.posexplode("shares").alias("bin", "e"))
    a = F.greatest(F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)) / F.col("n"), F.lit(least))
    e = F.greatest("e", F.lit(least))
    return expected.groupBy(*by).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def drift_references(df: DataFrame, features: list[str], by: list[str], bins: int = 10) -> DataFrame:
    """``(by, feature, edges, shares, missing_share)`` of all features in one pass: a row for each group and feature.

    Edges are the distinct inner quantiles of the known values, and a value on an edge belongs above it.
    """
    x = _stacked(df, features, by)
    levels = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = x.groupBy(*by, "feature").agg(F.array_distinct(F.percentile("x", levels)).alias("edges"), F.count("*").alias("n"), F.count("x").alias("known"))
    counts = _binned(x, edges, by).groupBy(*by, "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    share = lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("known")
    shares = F.transform(F.sequence(F.lit(0), F.size("edges")), share)
    return edges.join(counts, [*by, "feature"]).select(*by, "feature", "edges", shares.alias("shares"), (1 - F.col("known") / F.col("n")).alias("missing_share"))


def _stacked(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """``(by, feature, x)``: the values of all features below one another."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*by, F.explode(each).alias("_f")).select(*by, "_f.*")


def _binned(x: DataFrame, references: DataFrame, by: list[str], more: list[str] | None = None) -> DataFrame:
    """``(more, by, feature, bin, c)``: how many known values lie in each bin. The references, a row for each group and feature, are broadcast."""
    r = F.broadcast(references.select(*by, "feature", "edges"))
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin")
    return x.where("x is not null").join(r, [*by, "feature"]).groupBy(*(more or []), *by, "feature", bin_).agg(F.count("*").alias("c"))


def drift(df: DataFrame, features: list[str], references: DataFrame, by: list[str], over: str = "operating_day", least: float = 1e-4) -> DataFrame:
    """``(over, by, psi_...)``: the population stability index of every feature in every group, in one pass; null where no value is known."""
    binned = _binned(_stacked(df, features, [over, *by]), references, by, [over])
    held = binned.groupBy(over, *by, "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("n"))
    met = held.join(F.broadcast(references.select(*by, "feature", "shares")), [*by, "feature"])
    a = lambda i: F.greatest(F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("n"), F.lit(least))
    e = lambda x: F.greatest(x, F.lit(least))
    terms = F.transform("shares", lambda x, i: (a(i) - e(x)) * F.log(a(i) / e(x)))
    psi_ = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    found = met.select(over, *by, "feature", psi_.alias("psi"))
    return found.groupBy(over, *by).agg(*[F.max(F.when(F.col("feature") == f, F.col("psi"))).alias(f"psi_{f}") for f in features])


def daily_scores(df: DataFrame, y: str, pred: str, base: str, strategies: list[str]) -> DataFrame:
    """Of each day and horizon: rows, MAE, 90th percentile, skill against the base prediction, and each strategy's coverage, tails and median width.

    One aggregation of the rows of ``intervals``, which are neither copied nor read again by strategy.
    """
    err, ref, v = F.abs(F.col(y) - F.col(pred)), F.abs(F.col(y) - F.col(base)), F.col(y)
    share = lambda c: F.avg(c.cast("int"))
    parts = []
    for s in strategies:
        lo, hi = F.col(f"lo_{s}"), F.col(f"hi_{s}")
        parts += [share(v.between(lo, hi)).alias(f"coverage_{s}"), share(v < lo).alias(f"below_{s}"), share(v > hi).alias(f"above_{s}"), F.median(hi - lo).alias(f"width_{s}")]
    out = df.groupBy("operating_day", "horizon_min").agg(F.count("*").alias("n"), F.avg(err).alias("mae"), F.percentile(err, 0.9).alias("p90_abs_err"), F.avg(ref).alias("mae_historical"), *parts)
    return out.withColumn("skill_vs_historical", 1 - ratio("mae", "mae_historical"))


def with_window_days(scores: DataFrame, window: int = 14) -> DataFrame:
    """``rolling_window_days``: how many of the last ``window`` days had been scored before each day. There is one row a day."""
    days = scores.select("operating_day").distinct()
    ranked = days.withColumn("rolling_window_days", F.least(F.row_number().over(Window.orderBy("operating_day")) - 1, F.lit(window)))
    return scores.join(F.broadcast(ranked), "operating_day")


def trailing_median(scores: DataFrame, value: str, window: int = 14, least: int = 7) -> DataFrame:
    """``(operating_day, horizon_min, n_before, median_before)``: how many days of the last ``window`` are known, and their median if ``least`` are."""
    w = Window.partitionBy("horizon_min").orderBy("operating_day").rowsBetween(-window, -1)
    past = scores.select("operating_day", "horizon_min", F.array_sort(F.collect_list(value).over(w)).alias("_past"))
    n = F.size("_past")
    middle = (F.get("_past", F.floor((n - 1) / 2).cast("int")) + F.get("_past", F.floor(n / 2).cast("int"))) / 2
    return past.select("operating_day", "horizon_min", n.alias("n_before"), F.when(n >= least, middle).alias("median_before"))


def alerts(scores: DataFrame, psi_limit: float = 0.25, coverage_limit: float = 0.7, jump: float = 1.25, window: int = 14, least: int = 7) -> DataFrame:
    """Scores with ``alerts``: each drifting feature, low coverage by tails, and a MAE far above the median of the days before."""
    before = trailing_median(scores, "mae", window, least)
    x = scores.join(before, ["operating_day", "horizon_min"], "left")
    drifted = [F.when(F.col(c) > psi_limit, F.lit(f"drift:{c[4:]}")) for c in scores.columns if c.startswith("psi_")]
    low = F.when(F.col("coverage_rolling_tails") < coverage_limit, F.lit("low_coverage"))
    parts = [*drifted, low, F.when(F.col("mae") > jump * F.col("median_before"), F.lit("mae_jump"))]
    return x.withColumn("alerts", F.concat_ws(",", *parts)).drop("n_before", "median_before")


def replay_summary(scores: DataFrame, by: list[str], strategies: list[str]) -> DataFrame:
    """Metrics of groups of days, weighted by points."""
    w = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    return scores.groupBy(*by).agg(F.count("*").alias("days"), F.sum("n").alias("points"), w("mae"), w("mae_historical"), *[w(f"{k}_{s}") for s in strategies for k in ("coverage", "above")])


def metrics_between(scores: DataFrame, horizon: int, start: str, end: str) -> DataFrame:
    return scores.where((F.col("horizon_min") == horizon) & F.col("operating_day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def monthly_skill(scores: DataFrame) -> DataFrame:
    """Weighted skill of each month and horizon."""
    m = scores.withColumn("month", F.date_format("operating_day", "yyyy-MM"))
    return m.groupBy("month", "horizon_min").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("skill_vs_historical")) / F.sum("n")).alias("skill"))


def skill_trend(scores: DataFrame) -> DataFrame:
    """Least-squares change of the daily skill over 30 days."""
    x = F.date_diff("operating_day", F.lit("1970-01-01").cast("date"))
    return scores.withColumn("_x", x).groupBy("horizon_min").agg((30 * F.regr_slope("skill_vs_historical", "_x")).alias("trend_30d"))
