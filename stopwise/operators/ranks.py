"""Positions in an order, and values at a position, without a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.sources.shared import stored

#: Pieces that the distinct values of a group are cut in.
PIECES = 256


def numbered(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``name``: the place of each row, from 0, in ``order``; equal rows follow one another in any order.

    Rows are dealt by ranges and sorted, and stored with their number within their partition. The
    sizes are then counted on what has been stored, and ranges are put in order by it, so that
    neither a second run of the shuffle nor the way that AQE reads it can shift a number. A salt
    lets many rows of equal ``order`` be dealt to several ranges. ``df`` is read twice (ranges are
    sampled first); store it if it is costly.
    """
    keys = [*order, F.col("_salt")]
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(keep or df.columns))
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition, whatever the rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", before.alias("_base"))
    return kept.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + within).drop("_part", "_base", "_at")


def conformal_rank(coverage: float) -> Callable[[Column], Column]:
    """The rank, from 1, among n values: ceil((n - 1) * level) + 1 at the level min(1, ceil((n + 1) * coverage) / n)."""

    def rank(n: Column) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(coverage)) / n)
        return F.ceil((n - 1) * level) + 1

    return rank


def _pieces(counts: DataFrame, pieces: int) -> DataFrame:
    """Counts with ``_piece``: how many of the inner cut points of its group a value reaches. Cut points are about even in distinct values."""
    levels = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    edges = counts.groupBy("_g").agg(F.percentile_approx("_x", levels, F.lit(10 * pieces)).alias("_edges"))
    return counts.join(edges, "_g").withColumn("_piece", F.size(F.filter("_edges", lambda e: e <= F.col("_x")))).drop("_edges")


def _running(by: list[str], order: str) -> Column:
    """The sum of ``_n`` before this row."""
    return F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def order_statistics(df: DataFrame, by: list[str], values: dict[str, tuple[Column, Callable[[Column], Column]]], pieces: int = PIECES) -> DataFrame:
    """``(by, stat, n, value)``: of each group and each named value the one at its rank, and how many are known.

    ``values`` names a column and a function from the number of values to the rank, from 1. Values
    are counted first, before the shuffle. Counts by piece tell in which piece of a group the rank
    lies, and only the distinct values of that piece are put in order. Null values are ignored, null
    keys are a group, and a group without values has no row. Values at ranks beyond the ends have none.
    """
    stacked = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), x.cast("double").alias("_x")) for k, (x, _) in values.items()])).alias("_v"))
    g = F.struct(*by, F.col("_v.stat").alias("stat")).alias("_g")
    counts = stored(stacked.select(g, F.col("_v._x").alias("_x")).where("_x is not null").groupBy("_g", "_x").agg(F.count("*").alias("_n")), "counts")
    cut = _pieces(counts, pieces)
    sums = cut.groupBy("_g", "_piece").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("_g"))
    ranks = F.lit(None).cast("long")
    for k, (_, rank) in values.items():
        ranks = F.when(F.col("_g.stat") == k, rank(F.col("_total"))).otherwise(ranks)
    placed = sums.withColumn("_total", total).withColumn("_base", _running(["_g"], "_piece")).withColumn("_rank", ranks)
    chosen = placed.where("_base < _rank and _rank <= _base + _n").select("_g", "_piece", "_total", F.col("_rank") - F.col("_base")).toDF("_g", "_piece", "_total", "_left")
    within = cut.join(chosen, ["_g", "_piece"]).withColumn("_before", _running(["_g", "_piece"], "_x"))
    return within.where("_before < _left and _left <= _before + _n").select(*[F.col("_g")[c].alias(c) for c in by], F.col("_g.stat").alias("stat"), F.col("_total").alias("n"), F.col("_x").alias("value"))


def trailing_order_statistics(
    df: DataFrame, by: list[str], values: dict[str, tuple[Column, Callable[[Column], Column]]], window: int, least: int, day: str = "operating_day", pieces: int = PIECES
) -> DataFrame:
    """``(for_day, by, days, stat, n, value)``: the same of each day's ``window`` days before, if there are ``least`` of them.

    Days that occur in ``df`` are ranked, so missing dates are skipped, and days counts those that
    a day looks back on. Values are counted once by day. Of the counts by
    piece and day the trailing sums are taken, a table that does not grow with the rows, and only
    the pieces in which a rank lies are looked into for several days.
    """
    stacked = df.select(day, *by, F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), x.cast("double").alias("_x")) for k, (x, _) in values.items()])).alias("_v"))
    g = F.struct(*by, F.col("_v.stat").alias("stat")).alias("_g")
    counts = stored(stacked.select(F.col(day).alias("_day"), g, F.col("_v._x").alias("_x")).groupBy("_day", "_g", "_x").agg(F.count("*").alias("_n")), "counts")
    ranked = counts.select("_day").distinct().withColumn("_r", F.dense_rank().over(Window.orderBy("_day")))  # one row a day
    later = ranked.where(F.col("_r") > least).select(F.col("_day").alias("for_day"), F.col("_r").alias("_of"), F.least(F.col("_r") - 1, F.lit(window)).alias("days"))
    ahead = F.broadcast(ranked.select("_day", F.explode(F.sequence(F.col("_r") + 1, F.col("_r") + window)).alias("_of")).join(later, "_of").select("_day", "for_day"))
    cut = _pieces(counts.where("_x is not null"), pieces)
    sums = cut.groupBy("_day", "_g", "_piece").agg(F.sum("_n").alias("_n")).join(ahead, "_day").groupBy("for_day", "_g", "_piece").agg(F.sum("_n").alias("_n"))
    ranks = F.lit(None).cast("long")
    for k, (_, rank) in values.items():
        ranks = F.when(F.col("_g.stat") == k, rank(F.col("_total"))).otherwise(ranks)
    own = ["for_day", "_g"]
    placed = sums.withColumn("_total", F.sum("_n").over(Window.partitionBy(*own))).withColumn("_base", _running(own, "_piece")).withColumn("_rank", ranks)
    chosen = placed.where("_base < _rank and _rank <= _base + _n").withColumn("_left", F.col("_rank") - F.col("_base")).select(*own, "_piece", "_total", "_left")
    asked = chosen.join(ahead, "for_day")
    near = cut.join(asked, ["_g", "_piece", "_day"]).groupBy(*own, "_total", "_left", "_x").agg(F.sum("_n").alias("_n"))
    found = near.withColumn("_before", _running(own, "_x")).where("_before < _left and _left <= _before + _n")
    return found.join(F.broadcast(later), "for_day").select("for_day", *[F.col("_g")[c].alias(c) for c in by], "days", F.col("_g.stat").alias("stat"), F.col("_total").alias("n"), F.col("_x").alias("value"))
