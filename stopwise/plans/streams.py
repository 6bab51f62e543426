"""Queries that replay ``events`` as streams; each must agree with its batch twin in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.config import EVENTS as C
from stopwise.functions.columns import d0_bucket
from stopwise.operators import network as nw
from stopwise.plans.core import shared, source_state
from stopwise.plans.domain import NET, WIN, events, points, q, rounded, unsigned
from stopwise.plans.quality import PRED, ROLL, pred
from stopwise.sources.shared import shared_folder, stored
from stopwise.streaming import replay as rp

#: Files that a replay is dealt over in order of time; one is read in each trigger.
FILES = 3


#: Rows of a file, about, and the most files of a trigger.
FILE_ROWS, MOST_FILES = 250_000, 64


def stream(df: DataFrame, time: str, files: int = FILES, late: DataFrame | None = None, until: datetime.datetime | None = None) -> DataFrame:
    """``df`` as a stream, in order of ``time``, a part of its days a trigger, and at last the rows ``late``.

    A part is written and read as one file, or as equally many files by as many tasks where it is
    large. A last file holds one row a day later, and after ``until``, so that all windows before it close. Its text
    columns are empty, as a join would not let a null pass to where the watermark is taken; the
    others are null.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "stream")
    df = stored(df, "streamed")
    low, high = df.agg(F.min(time), F.max(time)).first()
    step = (high - low) / files + datetime.timedelta(seconds=1)
    ranges = [(F.col(time) >= F.lit(low + i * step)) & (F.col(time) < F.lit(low + (i + 1) * step)) for i in range(files)]
    least = min(df.agg(*[F.count_if(r) for r in ranges]).first())
    width = max(1, min(MOST_FILES, least // FILE_ROWS))

    def add(part: DataFrame, width: int = 1) -> None:
        (part.repartition(width) if width > 1 else part.coalesce(1)).write.mode("append").parquet(path)

    for r in ranges:
        add(df.where(r), width)
    last = spark.createDataFrame([(max(high, until or high) + datetime.timedelta(days=1),)], "t timestamp").select(
        *[(F.col("t") if c == time else F.lit("" if kind == "string" else None)).cast(df.schema[c].dataType).alias(c) for c, kind in df.dtypes]
    )
    add(last)
    if late is not None:
        add(late, width)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


def drained(out: DataFrame) -> DataFrame:
    """All rows that a stream appends until its input is used up."""
    spark = out.sparkSession
    path, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def station_events(s, d) -> DataFrame:
    """Arrivals and departures at stations as they are measured, stored, as several streams are made of them."""
    of = lambda k: F.when(F.col(f"{k}_d").isNotNull(), F.struct("station_id", F.col(f"{k}_actual").cast("timestamp").alias("event_time"), F.col(f"{k}_d").alias("d")))
    both = F.filter(F.array(of("arr"), of("dep")), lambda x: x.isNotNull())
    return shared(s, d, "station_events", lambda: events(s, d).select(F.explode(both).alias("e")).select("e.*"))


def minutes(out: DataFrame) -> DataFrame:
    return out.where("station_id is not null").select("station_id", F.floor(F.unix_timestamp("minute") / 60).alias("minute"), "n", F.round("s", 6).alias("s"), "l")


def tumbling(s, d):
    return minutes(drained(rp.minute_counts(stream(station_events(s, d), "event_time"), "station_id", 3.0)))


def late(s, d):
    """The rows of the first day come a second time in the last file, far behind the watermark, and are dropped."""
    e = station_events(s, d)
    first = e.agg(F.min(F.to_date("event_time"))).first()[0]
    again = e.where(F.to_date("event_time") == F.lit(first))
    return minutes(drained(rp.minute_counts(stream(e, "event_time", late=again), "station_id", 3.0)))


WIDTHS = (10, 30, 60)


def sliding(s, d):
    """The state over three widths, by one stream."""
    out = drained(rp.sliding_states(stream(station_events(s, d), "event_time"), "station_id", WIDTHS)).where("station_id is not null")
    return out.select("width", "station_id", F.floor(F.unix_timestamp("at") / 60).alias("minute"), "n", F.round("s", 6).alias("s"))


def ahead(s, d):
    """The departure ahead of each point, found by streams; null where there is none."""
    segment = lambda a, b: F.concat_ws("-", a, b).alias("segment")
    dep = nw.segment_departures(events(s, d)).select(
        segment("from_station_id", "to_station_id"), F.timestamp_seconds("dep_s").alias("dep_time"), "dep_d", F.timestamp_seconds("arr_s").alias("arr_time"), "arr_d"
    )
    p = points(s, d).where("next_station_id is not null").select("trip_key", "stop_seq", "t_pred", "cut_s", segment("cur_station_id", "next_station_id")).distinct()
    p = p.select(F.struct("trip_key", "stop_seq", "t_pred").alias("point_id"), "segment", F.timestamp_seconds("cut_s").alias("cut_time"))
    until = p.agg(F.max("cut_time")).first()[0]  # the windows of all points close, also of those after the last departure
    met = drained(rp.train_ahead(stream(dep, "dep_time", until=until), stream(p, "cut_time"), f"{C.ahead_max_min} minutes", grain="1 minute")).where("point_id is not null")
    minutes_ = (F.unix_timestamp(F.col("point_id.t_pred").cast("timestamp")) - F.unix_timestamp("dep_time")) / 60
    return unsigned(met.select("point_id.trip_key", "point_id.stop_seq", minutes_.alias("net_ahead_headway_min"), F.col("dep_d").alias("net_ahead_dep_delay"), F.col("gain").alias("net_ahead_seg_gain")))


def replayed(s, d) -> str:
    """Folder of a replay over all days, one a trigger."""
    rows = pred(s, d).where("y is not null and p50 is not null").select("operating_day", "horizon_min", "d0_min", "y", "q10", "q90")
    path, out = shared_folder(s, "days"), shared_folder(s, "replay")
    rows.repartition("operating_day").write.partitionBy("operating_day").parquet(f"{path}/all")
    for r in s.read.parquet(f"{path}/all").select("operating_day").distinct().orderBy("operating_day").collect():
        s.read.parquet(f"{path}/all").where(F.col("operating_day") == F.lit(r[0])).coalesce(1).write.mode("append").parquet(f"{path}/days")
    days = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/days")

    def score(x: DataFrame, offsets: DataFrame) -> DataFrame:
        known = x.withColumn("d0_bucket", d0_bucket("d0_min", C)).join(F.broadcast(offsets.drop("operating_day")), ["horizon_min", "d0_bucket"], "left")
        off = F.coalesce("offset", F.lit(0.0))
        return known.select(*SCORED.split(", "), F.col("y").between(F.col("q10") - off, F.col("q90") + off).alias("covered"))

    rp.daily_replay(days, out, f"{out}-checkpoint", score, C).awaitTermination()
    return out


SCORED = "operating_day, horizon_min, d0_bucket, offset"
_types = "operating_day date, horizon_min int"


def replay_root(s, d) -> str:
    """One replay a session, for the queries of its scores, state and offsets."""
    key = (s.sparkContext.applicationId, *source_state(s, d))
    if key not in _replays or not rp.snapshots.versions(s, _replays[key]):
        _replays[key] = replayed(s, d)
    return _replays[key]


_replays: dict = {}


def scored_days(s, d):
    x = rp.replay_table(s, replay_root(s, d), rp.SCORES, f"{_types}, d0_bucket string, offset double, covered boolean")
    return x.groupBy("operating_day", "horizon_min").agg(F.count("*").alias("n"), F.count("offset").alias("with_offset"), F.count_if("covered").alias("covered"))


def state_days(s, d):
    return rp.replay_table(s, replay_root(s, d), rp.STATE, "operating_day date").groupBy("operating_day").agg(F.count("*").alias("n"))


def published(s, d):
    x = rp.replay_table(s, replay_root(s, d), rp.OFFSETS, f"{_types}, d0_bucket string, n long, offset double, lo_offset double, hi_offset double")
    return rounded(x.select(F.col("operating_day").alias("after_day"), "horizon_min", "d0_bucket", "n", "offset", "lo_offset", "hi_offset"))


_ms = "select station_id, minute, n, round(s, 6) as s, l from ms"
q("I01_tumbling_minutes", _ms, NET, tumbling)
q(
    "I02_sliding_state",
    "select width, station_id, minute + k as minute, sum(n)::bigint as n, round(sum(s), 6) as s from ms, (values (10), (30), (60)) v(width), unnest(range(1, width + 1)) t(k) group by all",
    NET, sliding,
)
q("I03_late_rows", _ms, NET, late)
AHEAD = ["net_ahead_headway_min", "net_ahead_dep_delay", "net_ahead_seg_gain"]
q("I04_stream_join", f"select distinct trip_key, stop_seq, {', '.join(f'round({c}, 6) + 0 as {c}' for c in AHEAD)} from ahead", WIN, ahead)
_REPLAY = PRED | {"pred1": "select * from pred where y is not null and p50 is not null"} | {k: v.replace("from pred", "from pred1") for k, v in ROLL.items()}
q(
    "I05_daily_replay",
    "select p.operating_day, p.horizon_min, count(*) as n, count(off) as with_offset, count_if(y between q10 - coalesce(off, 0) and q90 + coalesce(off, 0))::bigint as covered "
    "from pred1 p left join roll r on r.for_day = p.operating_day and r.horizon_min = p.horizon_min and r.d0_bucket = p.d0_bucket group by all",
    _REPLAY, scored_days,
)
q("I06_bounded_state", "select operating_day, count(*) as n from pred1 group by all order by operating_day desc limit 14", _REPLAY, state_days)
# what is published after a day learns from that day too, so it is looked up from the day after
_after = _REPLAY | {"tr": "select f.operating_day as for_day, f.r + 1 as r, p.* from pred1 p join dd e on e.operating_day = p.operating_day join dd f on f.r >= e.r and f.r < e.r + 14"}
q(
    "I07_published_offsets",
    'select for_day as after_day, horizon_min, d0_bucket, n, round(off, 6) as "offset", round(lo_offset, 6) as lo_offset, round(hi_offset, 6) as hi_offset from roll',
    _after, published,
)
