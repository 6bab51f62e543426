"""Structured Streaming forms of the time-window and day-by-day operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise.config import Config
from stopwise.operators.calibrate import offsets_of
from stopwise.sources import snapshots


def minute_counts(events: DataFrame, key: str, late_min: float, delay: str = "2 minutes") -> DataFrame:
    """Count, delay sum and late count by key and minute of ``event_time``; late rows beyond the watermark are dropped."""
    w = events.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 minute"), key)
    return w.agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.count_if(F.col("d") > late_min).alias("l")).select(F.col("window.start").alias("minute"), key, "n", "s", "l")


def sliding_state(events: DataFrame, key: str, width: str = "30 minutes", slide: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Trailing count and delay sum by key at each slide, from panes of one slide.

    Two aggregations in a row: events become one row a key and pane, and only closed panes are
    dealt to the windows over them, by the time that ``window_time`` gives them. State holds the
    open panes, and the windows of panes, however many events these have.
    """
    panes = events.withWatermark("event_time", delay).groupBy(F.window("event_time", slide), key).agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    w = panes.select(F.window_time("window").alias("pane"), key, "n", "s").groupBy(F.window("pane", width, slide), key)
    return w.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(F.col("window.end").alias("at"), key, "n", "s")


def sliding_states(events: DataFrame, key: str, widths: tuple[int, ...], span: int = 60, delay: str = "2 minutes") -> DataFrame:
    """``(width, at, key, n, s)``: trailing count and delay sum by key at each minute, over several widths in minutes of up to ``span`` each.

    Two aggregations in a row, as in ``sliding_state``, but a pane of a minute goes to two windows
    of twice the span, and not to one for every minute of each width: all that the minutes of a
    window's second half look back at lies in it. They are summed up in the row that holds its panes,
    once it closes, of which there are as many as keys and spans whatever the number of events.
    """
    panes = events.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 minute"), key).agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    panes = panes.select(F.window_time("window").alias("pane"), F.floor(F.unix_timestamp("window.start") / 60).alias("minute"), key, "n", "s")
    w = panes.groupBy(F.window("pane", f"{2 * span} minutes", f"{span} minutes"), key).agg(F.sort_array(F.collect_list(F.struct("minute", "n", "s"))).alias("panes"))
    half = F.floor(F.unix_timestamp("window.start") / 60) + span
    at = w.select(key, "panes", F.explode(F.sequence(half + 1, half + span)).alias("minute"))
    at = at.select("*", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    near = F.filter("panes", lambda p: (p["minute"] >= F.col("minute") - F.col("width")) & (p["minute"] < F.col("minute")))
    at = at.withColumn("near", near).where(F.size("near") > 0)
    total = lambda f, zero: F.aggregate("near", zero, lambda acc, p: acc + p[f]).alias(f)
    return at.select("width", F.timestamp_seconds(F.col("minute") * 60).alias("at"), key, total("n", F.lit(0).cast("long")), total("s", F.lit(0.0)))


def train_ahead(departures: DataFrame, points: DataFrame, most: str = "60 minutes", delay: str = "2 minutes", grain: str = "1 microsecond") -> DataFrame:
    """``(point_id, cut_time, dep_time, dep_d, gain)``: the latest departure on a point's segment before its cutoff, up to ``most`` old; nulls where there is none.

    Departures become panes of one ``grain``, of which the latest departure is kept, and panes go to
    windows of twice ``most``, in the second half of which all that a point looks back at lies. A
    left outer join of two streams by segment and window then finds one row for each point, however
    many departures there are, whose points without a match come out once the watermark has passed
    their window, and behind it the latest departure of each point. All states are bounded by
    the watermarks. Cutoffs must be whole numbers of ``grain``, which any time is by default.
    ``gain`` is null unless the arrival was known before the cutoff. Departures of one second go
    by delay, then arrival. Late rows on either side are dropped.
    """
    span, step = (departures.sparkSession.sql(f"select unix_micros(timestamp_micros(0) + interval {x})").first()[0] for x in (most, grain))
    if span % step:
        raise ValueError(f"{most} is not a whole number of {grain}")
    windows = lambda at: F.window(at, f"{2 * span} microseconds", f"{span} microseconds")
    one = F.struct("dep_time", "dep_d", F.coalesce("arr_time", F.timestamp_seconds(F.lit(0))).alias("arr_time"), "arr_d")
    panes = departures.withWatermark("dep_time", delay).groupBy(F.window("dep_time", f"{step} microseconds"), "segment").agg(F.max(one).alias("last"))
    panes = panes.select(F.window_time("window").alias("pane"), F.col("segment").alias("d_segment"), "last")
    d = panes.groupBy(windows("pane").alias("d_window"), "d_segment").agg(F.sort_array(F.collect_list("last")).alias("lasts"))
    cut = F.unix_micros("cut_time")
    cut = F.when(F.pmod(cut, F.lit(step)) == 0, cut).otherwise(F.raise_error(F.lit(f"a cutoff is not a whole number of {grain}")))
    p = points.withWatermark("cut_time", delay).select("point_id", "segment", windows("cut_time").alias("window"), cut.alias("cut"))
    p = p.where(F.col("cut") >= F.unix_micros("window.start") + span)
    met = p.join(d, F.expr("segment = d_segment and window = d_window"), "left_outer")
    near = F.filter("lasts", lambda x: F.unix_micros(x["dep_time"]).between(F.col("cut") - span + 1, F.col("cut") - 1))
    last = met.select("window", "point_id", "cut", F.try_element_at(near, F.lit(-1)).alias("last")).groupBy("window", "point_id", "cut").agg(F.max("last").alias("last"))
    known = (F.col("last.arr_d").isNotNull()) & (F.unix_micros("last.arr_time") < F.col("cut"))
    return last.select(
        "point_id", F.timestamp_micros("cut").alias("cut_time"), F.col("last.dep_time").alias("dep_time"), F.col("last.dep_d").alias("dep_d"), F.when(known, F.col("last.arr_d") - F.col("last.dep_d")).alias("gain")
    )


PUBLISHED = "horizon_min int, d0_bucket string, n long, offset double, lo_offset double, hi_offset double, operating_day date"
#: What a replay keeps of each day, as parts of one snapshot table.
STATE, SCORES, OFFSETS = "state", "scores", "offsets"


def part(kind: str, day: object) -> str:
    return f"{kind} {day}"


def days_of(snap: snapshots.Snapshot, kind: str) -> list[str]:
    """The days that a snapshot holds of a kind, in order."""
    return sorted(n.split(" ", 1)[1] for n in snap.parts if n.startswith(f"{kind} "))


def replay_table(spark: SparkSession, root: str, kind: str, schema) -> DataFrame:
    """All rows of a kind in the last snapshot of a replay."""
    snap = snapshots.snapshot(spark, root)
    return snapshots.read(spark, root, schema, [part(kind, d) for d in days_of(snap, kind)], snap.version or None)


def daily_replay(
    days: DataFrame, root: str, checkpoint: str, score: Callable[[DataFrame, DataFrame], DataFrame], cfg: Config, window: int = 14, least: int = 7, min_points: int = 200, keep: int = 2
) -> StreamingQuery:
    """Score each day with offsets of the days before, then add it to the state and publish the offsets for the next day.

    ``days`` streams rows with y, q10, q90, d0_min, horizon_min and operating_day. The table at
    ``root`` holds, of each day, its scores and the offsets published after it, and of the last
    ``window`` days the rows. A day's scores, offsets and rows and the expiry of older rows are one
    commit (see ``snapshots``), so a batch that is killed anywhere and run again gives the same
    result: before the commit nothing has changed, and after it the day is replaced by itself,
    learning from the days before it alone. With less than ``least`` days there are no offsets.
    """

    def one_day(rows: DataFrame, day: object) -> None:
        spark = rows.sparkSession
        snap = snapshots.snapshot(spark, root)
        before = [d for d in days_of(snap, STATE) if d < str(day)]
        # what was published after the day before is what this day is scored with
        last = [part(OFFSETS, d) for d in days_of(snap, OFFSETS) if d < str(day)][-1:]
        offsets = snapshots.read(spark, root, PUBLISHED, last, snap.version or None)
        kept = snapshots.read(spark, root, rows.schema, [part(STATE, d) for d in before[-(window - 1) :]], snap.version or None)
        after = offsets_of(kept.unionByName(rows), "y", "q10", "q90", cfg, least, min_points)
        new = {part(SCORES, day): score(rows, offsets), part(OFFSETS, day): after.withColumn("operating_day", F.lit(day)), part(STATE, day): rows}
        expired = [part(STATE, d) for d in days_of(snap, STATE) if d < str(day) and d not in before[-(window - 1) :]]
        snapshots.publish(spark, root, new, expired)

    def batch(df: DataFrame, _: int) -> None:
        rows = df.select("horizon_min", "d0_min", "y", "q10", "q90", "operating_day").persist()
        for day in sorted(r[0] for r in rows.select("operating_day").distinct().collect()):
            one_day(rows.where(F.col("operating_day") == F.lit(day)), day)
        rows.unpersist()
        snapshots.vacuum(df.sparkSession, root, keep)

    return days.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
