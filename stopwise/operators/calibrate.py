"""Split-conformal offsets, fixed and rolling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import d0_bucket
from stopwise.operators.ranks import conformal_rank, order_statistics, trailing_order_statistics


def higher_quantile(df: DataFrame, x: Column, coverage: float, by: list[str], name: str = "offset") -> DataFrame:
    """Of each group the order statistic at rank ceil((n - 1) * level), level = min(1, ceil((n + 1) * coverage) / n), and n."""
    return order_statistics(df, by, {name: (x, conformal_rank(coverage))}).select(*by, "n", F.col("value").alias(name))


def residual(y: str, lo: str, hi: str) -> Column:
    """How far y lies outside the interval; negative inside."""
    return F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))


def conformal_offset(df: DataFrame, y: str, lo: str, hi: str, by: list[str], coverage: float = 0.8) -> DataFrame:
    return higher_quantile(df, residual(y, lo, hi), coverage, by)


BUCKETS = ["<1", "1-3", "3-10", ">10"]
POOLED = "all"


def with_pool(df: DataFrame, cfg: Config) -> DataFrame:
    """Each row once under its delay bucket and once under ``POOLED``."""
    return df.withColumn("d0_bucket", F.explode(F.array(d0_bucket("d0_min", cfg), F.lit(POOLED))))


def spread(found: DataFrame, by: list[str], names: list[str], min_points: int) -> DataFrame:
    """``(by, d0_bucket, n, names)`` with all buckets: one with fewer than ``min_points`` takes the pooled values. n counts the bucket's own."""
    pooled = found.where(F.col("d0_bucket") == POOLED).select(*by, *[F.col(c).alias(f"_{c}") for c in names], F.explode(F.array(*map(F.lit, BUCKETS))).alias("d0_bucket"))
    full = pooled.join(found, [*by, "d0_bucket"], "left")
    own = F.coalesce("n", F.lit(0)) >= min_points
    return full.select(*by, "d0_bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[F.when(own, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names])


def calibrate(df: DataFrame, y: str, lo: str, hi: str, cfg: Config, min_points: int = 200) -> DataFrame:
    """Offset of each horizon and delay bucket; a bucket with few points takes the pooled one. All buckets are there."""
    by = ["horizon_min", "d0_bucket"]
    found = by_name(order_statistics(with_pool(df, cfg), by, both_values(y, lo, hi)), by, ["offset"])
    return spread(found, ["horizon_min"], ["offset"], min_points)


def tail_values(y: str, lo: str, hi: str, tail: float = 0.1) -> dict:
    """What the offsets of the two tails are order statistics of."""
    return {"lo_offset": (F.col(lo) - F.col(y), conformal_rank(1 - tail)), "hi_offset": (F.col(y) - F.col(hi), conformal_rank(1 - tail))}


def both_values(y: str, lo: str, hi: str, coverage: float = 0.8) -> dict:
    """The same for one offset of both sides."""
    return {"offset": (residual(y, lo, hi), conformal_rank(coverage))}


def by_name(found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The order statistics as columns, of groups that have all of them; n is that of the last."""
    out = found.groupBy(*by).agg(*[F.max(F.when(F.col("stat") == n, F.col("value"))).alias(n) for n in names], F.max(F.when(F.col("stat") == names[-1], F.col("n"))).alias("n"))
    return out.dropna(subset=names)


def tail_offsets(df: DataFrame, y: str, lo: str, hi: str, by: list[str], tail: float = 0.1) -> DataFrame:
    """One offset for each tail."""
    return by_name(order_statistics(df, by, tail_values(y, lo, hi, tail)), by, ["lo_offset", "hi_offset"]).select(*by, "lo_offset", "n", "hi_offset")


def trailing_days(df: DataFrame, days: int, day: str = "operating_day") -> DataFrame:
    """Each row once for each of the next ``days`` days that occur, as ``for_day``: what that day may learn from.

    Days are ranked, so missing dates are skipped. The list of days is small and broadcast.
    """
    ranked = df.select(day).distinct().withColumn("_r", F.dense_rank().over(Window.orderBy(day)))
    later = ranked.select(F.col(day).alias("for_day"), F.col("_r").alias("_rank"))
    out = df.join(F.broadcast(ranked), day).withColumn("_rank", F.explode(F.sequence(F.col("_r") + 1, F.col("_r") + days)))
    return out.join(F.broadcast(later), "_rank").drop("_r", "_rank")


OFFSETS = ["offset", "lo_offset", "hi_offset"]


def offsets_of(df: DataFrame, y: str, lo: str, hi: str, cfg: Config, least: int = 7, min_points: int = 200) -> DataFrame:
    """``(horizon_min, d0_bucket, n, offset, lo_offset, hi_offset)`` from all rows given; none if they are of less than ``least`` days."""
    by = ["horizon_min", "d0_bucket"]
    enough = df.agg((F.count_distinct("operating_day") >= least).alias("enough"))
    found = by_name(order_statistics(with_pool(df, cfg), by, both_values(y, lo, hi) | tail_values(y, lo, hi)), by, OFFSETS)
    return spread(found, ["horizon_min"], OFFSETS, min_points).join(F.broadcast(enough.where("enough")), how="left_semi")


def rolling_offsets(df: DataFrame, y: str, lo: str, hi: str, cfg: Config, window: int = 14, least: int = 7, min_points: int = 200) -> DataFrame:
    """``(for_day, horizon_min, d0_bucket, days, n, offset, lo_offset, hi_offset)`` from the days before each day: both sides together, and by tail.

    Days with too little history have none; a bucket with few points takes the values of its horizon.
    """
    by = ["for_day", "horizon_min", "d0_bucket", "days"]
    stats = trailing_order_statistics(with_pool(df, cfg), ["horizon_min", "d0_bucket"], both_values(y, lo, hi) | tail_values(y, lo, hi), window, least)
    return spread(by_name(stats, by, OFFSETS), ["for_day", "horizon_min", "days"], OFFSETS, min_points)


STRATEGIES = ["static", "rolling", "rolling_tails"]


def intervals(df: DataFrame, static: DataFrame, rolling: DataFrame, p50: str, lo: str, hi: str, cfg: Config) -> DataFrame:
    """``df`` with ``lo_`` and ``hi_`` of each of ``STRATEGIES``: bounds under the fixed, rolling and by-tail offsets, sorted with the median; fixed ones where there is no history."""
    s = static.select("horizon_min", "d0_bucket", F.col("offset").alias("_s"))
    r = rolling.select(F.col("for_day").alias("operating_day"), "horizon_min", "d0_bucket", F.col("offset").alias("_o"), F.col("lo_offset").alias("_lo"), F.col("hi_offset").alias("_hi"))
    own = [c for c in df.columns if c != "d0_bucket"]
    x = df.select(*own).withColumn("d0_bucket", d0_bucket("d0_min", cfg)).join(F.broadcast(s), ["horizon_min", "d0_bucket"], "left")
    x = x.join(F.broadcast(r), ["operating_day", "horizon_min", "d0_bucket"], "left")

    def bounds(name: str, down: Column, up: Column) -> list[Column]:
        three = F.array_sort(F.array(F.col(lo) - down, F.col(p50), F.col(hi) + up))
        return [F.get(three, F.lit(0)).alias(f"lo_{name}"), F.get(three, F.lit(2)).alias(f"hi_{name}")]

    fixed = F.coalesce("_s", F.lit(0.0))
    shifts = {"static": (fixed, fixed), "rolling": (F.coalesce("_o", fixed),) * 2, "rolling_tails": (F.coalesce("_lo", fixed), F.coalesce("_hi", fixed))}
    return x.select(*own, "d0_bucket", *[c for name in STRATEGIES for c in bounds(name, *shifts[name])])


def by_strategy(df: DataFrame) -> DataFrame:
    """The rows of ``intervals`` in long form: ``strategy``, ``lo`` and ``hi`` in place of a pair of columns each."""
    pairs = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"lo_{s}").alias("lo"), F.col(f"hi_{s}").alias("hi")) for s in STRATEGIES])
    kept = [c for c in df.columns if c not in {f"{e}_{s}" for e in ("lo", "hi") for s in STRATEGIES}]
    return df.select(*kept, F.explode(pairs).alias("_p")).select(*kept, "_p.*")
