"""Errors, day-clustered confidence intervals and interval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import d0_bucket, pinball


def day_sums(df: DataFrame, error: Column, by: list[str], day: str = "operating_day") -> DataFrame:
    """Sum of errors and number of rows of each group and day."""
    return df.where(error.isNotNull()).groupBy(*by, day).agg(F.sum(error).alias("err"), F.count("*").alias("n"))


def bootstrap_ci(days: DataFrame, by: list[str], draws: int = 1000, level: float = 0.95, seed: int = 1, day: str = "operating_day") -> DataFrame:
    """Ratio of sums of each group, with the interval from resampling whole days.

    Draw b, place j of a group with D days takes day md5(seed|b|j) mod D, in order of the days. Only
    day sums are drawn from, so its size is draws times days, whatever the number of points.
    """
    days = days.withColumn("_d", F.struct(day, "err", "n"))
    packed = days.groupBy(*by).agg(F.sort_array(F.collect_list("_d")).alias("_days"), F.sum("err").alias("_e"), F.sum("n").alias("_n"))
    packed = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = packed.withColumn("_j", F.explode(F.sequence(F.lit(0), F.size("_days") - 1)))
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_b").cast("string"), F.col("_j").cast("string")).cast("binary"))
    at = (F.conv(F.substring(code, 1, 8), 16, 10).cast("long") % F.size("_days")).cast("int")
    one = drawn.withColumn("_p", F.get("_days", at))
    means = one.groupBy(*by, "_e", "_n", "_b").agg((F.sum("_p.err") / F.sum("_p.n")).alias("_m"))
    tail = (1 - level) / 2
    found = means.groupBy(*by, "_e", "_n").agg(F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    return found.select(*by, F.col("_n").alias("n"), (F.col("_e") / F.col("_n")).alias("value"), F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"))


def mae_ci(df: DataFrame, y: str, pred: str, by: list[str], **kw) -> DataFrame:
    return bootstrap_ci(day_sums(df, F.abs(F.col(y) - F.col(pred)), by), by, **kw)


def mae_diff_ci(df: DataFrame, y: str, a: str, b: str, by: list[str], **kw) -> DataFrame:
    """MAE of a minus MAE of b on the same rows; significant if the interval leaves out 0."""
    diff = bootstrap_ci(day_sums(df, F.abs(F.col(y) - F.col(a)) - F.abs(F.col(y) - F.col(b)), by), by, **kw)
    return diff.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def evaluate(df: DataFrame, y: str, preds: list[str], by: list[str], **kw) -> DataFrame:
    """For each group and prediction: rows, days, MAE with interval, and the 90th percentile of the absolute error."""
    long = df.select(*by, "operating_day", y, *preds).unpivot([*by, "operating_day", y], preds, "model", "pred").where(f"pred is not null and {y} is not null")
    keys = [*by, "model"]
    err = F.abs(F.col(y) - F.col("pred"))
    plain = long.groupBy(*keys).agg(F.count_distinct("operating_day").alias("days"), F.percentile(err, 0.9).alias("p90"))
    return bootstrap_ci(day_sums(long, err, keys), keys, **kw).join(plain, keys)


def interval_metrics(df: DataFrame, y: str, lo: str, hi: str, by: list[str]) -> DataFrame:
    """Coverage, share below and above, width, crossing share and pinball losses at 0.1 and 0.9."""
    y_, a, b = F.col(y), F.col(lo), F.col(hi)
    share = lambda c: F.avg(c.cast("int"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), share((y_ >= a) & (y_ <= b)).alias("coverage"), share(y_ < a).alias("below"), share(y_ > b).alias("above"), F.avg(b - a).alias("width_mean"),
        F.median(b - a).alias("width_median"), share(a > b).alias("crossing"), F.avg(pinball(y, lo, 0.1)).alias("pinball_lo"), F.avg(pinball(y, hi, 0.9)).alias("pinball_hi"),
    )


def interval_report(df: DataFrame, y: str, lo: str, hi: str, cfg: Config) -> DataFrame:
    """Interval metrics of each horizon, by delay bucket and over all."""
    b = df.withColumn("d0_bucket", d0_bucket("d0_min", cfg))
    return interval_metrics(b.unionByName(b.withColumn("d0_bucket", F.lit("all"))), y, lo, hi, ["horizon_min", "d0_bucket"])
