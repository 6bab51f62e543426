"""Network state seen from prediction points: trailing sums of what other trains did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import epoch_s, in_country, minute_idx, ratio, trip_key, valid_delay

KEYS = ["trip_key", "stop_seq", "horizon_min"]
DAY = 1440


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    For tables with rows for each point or stop: written as files they are a tenth of what they are
    in memory, so going by the files' size Spark would build them in the driver.
    """
    return df.hint("merge")


def network_events(trains: DataFrame, cfg: Config) -> DataFrame:
    """Stops of all trains at home stations with their valid measured delays."""
    return trains.where(in_country("station_id", cfg.country_prefix)).select(
        trip_key("operating_day", "trip_id").alias("trip_key"), "station_id", "arr_planned", "dep_planned", "arr_actual", "dep_actual",
        valid_delay("arr_status", "arr_planned", "arr_actual", cfg).alias("arr_d"), valid_delay("dep_status", "dep_planned", "dep_actual", cfg).alias("dep_d"),
    )


def segment_departures(events: DataFrame) -> DataFrame:
    """Measured departures towards a next stop, with its arrival if measured. Ties of planned times go by station, then by all other columns."""
    ties = ("station_id", "arr_planned", "dep_planned", "arr_actual", "dep_actual", "arr_d", "dep_d")
    w = Window.partitionBy("trip_key").orderBy(
        F.coalesce("arr_planned", "dep_planned").asc_nulls_last(), F.coalesce("dep_planned", "arr_planned").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]
    )
    o = events.select(
        F.col("station_id").alias("from_station_id"), F.lead("station_id").over(w).alias("to_station_id"), epoch_s("dep_actual").alias("dep_s"), "dep_d",
        F.lead("arr_d").over(w).alias("arr_d"), epoch_s(F.lead("arr_actual").over(w)).alias("next_s"),
    )
    return o.where("dep_d is not null and to_station_id is not null").select(
        "from_station_id", "to_station_id", "dep_s", "dep_d", F.when(F.col("arr_d").isNotNull(), F.col("next_s")).alias("arr_s"), "arr_d"
    )


def station_minutes(events: DataFrame, cfg: Config) -> DataFrame:
    """Count, delay sum and late count of each station and minute. A stop gives its arrival and its departure, so events are read once."""
    both = F.array(*[F.struct(minute_idx(f"{x}_actual").alias("minute"), F.col(f"{x}_d").alias("d")) for x in ("arr", "dep")])
    measured = events.select("station_id", F.explode(both).alias("_m")).select("station_id", "_m.*").where("d is not null")
    return measured.groupBy("station_id", "minute").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.count_if(F.col("d") > cfg.late_min).alias("l"))


def segment_minutes(departures: DataFrame) -> DataFrame:
    """Count and sum of gained delay of each segment and arrival minute."""
    d = departures.where("arr_s is not null").withColumn("minute", F.floor(F.col("arr_s") / 60).cast("long"))
    return d.groupBy("from_station_id", "to_station_id", "minute").agg(F.count("*").alias("n"), F.sum(F.col("arr_d") - F.col("dep_d")).alias("s"))


def network_minutes(stations: DataFrame) -> DataFrame:
    return stations.groupBy("minute").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("l").alias("l"))


def prediction_points(journeys: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """Labelled points with their stations, the last minute they may see, and the second before which events count."""
    w = Window.partitionBy("trip_key").orderBy("stop_seq")
    now = journeys.select("trip_key", "stop_seq", F.col("station_id").alias("cur_station_id"), F.lead("station_id").over(w).alias("next_station_id"))
    p = labels.where("label_status = 'ok'").select(*KEYS, "t_pred", "target_seq", "target_station_id").join(shuffled(now), ["trip_key", "stop_seq"])
    m_end = F.floor((epoch_s("t_pred") - 60 * cfg.lag_min) / 60).cast("long") - 1
    return p.withColumn("m_end", m_end).withColumn("cut_s", (F.col("m_end") + 1) * 60)


def trailing_sums(minutes: DataFrame, points: DataFrame, on: dict[str, str], keys: list[str], widths: tuple[int, ...], values: tuple[str, ...] = ("n", "s", "l")) -> DataFrame:
    """``keys`` and, for each width w, ``{value}_{w}``: sums over the minutes m_end - w < minute <= m_end of the point's key.

    ``on`` names the point's column for each key of ``minutes``; without keys the sums are over the
    whole network. Points join the minutes as rows of zero, and one window a width adds up; all
    widths share one shuffle. The window runs within a day, into which the last hour of the day
    before is copied, so that neither a busy key nor the network as a whole falls to one task.
    Points with a null key get zeros.
    """
    span = max(widths)
    both = F.array_distinct(F.array(F.floor(F.col("minute") / DAY), F.floor((F.col("minute") + span - 1) / DAY)))
    a = minutes.select(*on, "minute", F.explode(both).alias("_day"), *[F.col(v).cast("double").alias(v) for v in values], *[F.lit(None).cast(points.schema[k].dataType).alias(f"_{k}") for k in keys], F.lit(False).alias("_point"))
    known = points
    for c in on.values():
        known = known.where(F.col(c).isNotNull())
    b = known.select(
        *[F.col(c).alias(k) for k, c in on.items()], F.col("m_end").alias("minute"), F.floor(F.col("m_end") / DAY).alias("_day"), *[F.lit(0.0).alias(v) for v in values],
        *[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_point"),
    )
    w = Window.partitionBy(*on, "_day").orderBy("minute")
    sums = [F.sum(v).over(w.rangeBetween(-(width - 1), 0)).alias(f"{v}_{width}") for width in widths for v in values]
    out = a.unionByName(b).select("_point", *[F.col(f"_{k}").alias(k) for k in keys], *sums).where("_point").drop("_point")
    if not on:
        return out
    missing = points.where(" or ".join(f"{c} is null" for c in on.values())).select(*keys, *[F.lit(0.0).alias(f"{v}_{width}") for width in widths for v in values])
    return out.unionByName(missing)


def last_before(departures: DataFrame, points: DataFrame, cfg: Config) -> DataFrame:
    """The latest departure on the point's next segment strictly before its cut-off and no older than allowed.

    Of departures in one second the one with the largest delay, then arrival, is taken. The latest of
    all before the cut-off is kept running, and it is dropped if it is too old: then all are. So a
    row costs the same however many departures an hour has. The window runs within a day, into
    which the last hour of the day before is copied.
    """
    age, on = 60 * cfg.ahead_max_min, ["from_station_id", "to_station_id"]
    day = lambda c: F.floor(c / (60 * DAY))
    a = departures.select(
        *on, F.col("dep_s").alias("at"), F.explode(F.array_distinct(F.array(day(F.col("dep_s")), day(F.col("dep_s") + age)))).alias("_day"),
        F.struct("dep_s", "dep_d", F.coalesce("arr_s", F.lit(-1)).alias("arr_s"), "arr_d").alias("d"), *[F.lit(None).cast(points.schema[k].dataType).alias(k) for k in KEYS],
        F.lit(None).cast("long").alias("cut_s"), F.lit(None).cast("long").alias("t_s"),
    )
    b = points.where("next_station_id is not null").select(
        F.col("cur_station_id").alias("from_station_id"), F.col("next_station_id").alias("to_station_id"), F.col("cut_s").alias("at"), day(F.col("cut_s")).alias("_day"),
        F.lit(None).cast(a.schema["d"].dataType).alias("d"), *KEYS, "cut_s", epoch_s("t_pred").alias("t_s"),
    )
    w = Window.partitionBy(*on, "_day").orderBy("at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = a.withColumn("_point", F.lit(1)).unionByName(b.withColumn("_point", F.lit(0)))  # a point stands before the departures of its second
    found = both.withColumn("d", F.max("d").over(w)).where("cut_s is not null")
    found = found.withColumn("d", F.when(F.col("d.dep_s") > F.col("cut_s") - age, F.col("d")))
    return found.select(
        *KEYS, ((F.col("t_s") - F.col("d.dep_s")) / F.lit(60.0)).alias("net_ahead_headway_min"), F.col("d.dep_d").alias("net_ahead_dep_delay"),
        F.when((F.col("d.arr_s") >= 0) & (F.col("d.arr_s") < F.col("cut_s")), F.col("d.arr_d") - F.col("d.dep_d")).alias("net_ahead_seg_gain"),
    )


def _state(sums: DataFrame, prefix: str, width: int, suffix: str = "", late: bool = True, count: bool = True, mean: str = "mean_delay") -> list:
    n = F.col(f"n_{width}")
    out = [n.cast("long").alias(f"net_{prefix}_n{suffix}")] if count else []
    out.append(ratio(f"s_{width}", n).alias(f"net_{prefix}_{mean}{suffix}"))
    return out + ([ratio(f"l_{width}", n).alias(f"net_{prefix}_share_late{suffix}")] if late else [])


def station_state(stations: DataFrame, points: DataFrame, prefix: str, column: str) -> DataFrame:
    """State of one of a point's stations over 10, 30 and 60 minutes."""
    sums = trailing_sums(stations, points, {"station_id": column}, KEYS, (10, 30, 60))
    short = _state(sums, prefix, 10, "_10", late=False) if prefix != "tgt" else []
    long = _state(sums, prefix, 60, "_60", late=False, count=False) if prefix == "cur" else []
    return sums.select(*KEYS, *_state(sums, prefix, 30), *short, *long)


def segment_state(segments: DataFrame, points: DataFrame) -> DataFrame:
    sums = trailing_sums(segments, points, {"from_station_id": "cur_station_id", "to_station_id": "next_station_id"}, KEYS, (10, 30), ("n", "s"))
    return sums.select(*KEYS, *_state(sums, "seg", 30, late=False, mean="mean_gain"), *_state(sums, "seg", 10, "_10", late=False, mean="mean_gain"))


def network_state(network: DataFrame, points: DataFrame) -> DataFrame:
    """State of the whole network: computed once for each distinct last minute."""
    sums = trailing_sums(network, points.select("m_end").distinct(), {}, ["m_end"], (10, 30, 60))
    state = sums.select("m_end", *_state(sums, "all", 30, count=False), *_state(sums, "all", 10, "_10", count=False), *_state(sums, "all", 60, "_60", late=False, count=False))
    return points.select(*KEYS, "m_end").join(state, "m_end").drop("m_end")


def corridor_state(stations: DataFrame, segments: DataFrame, points: DataFrame, journeys: DataFrame) -> DataFrame:
    """State along the stops from the next to the target."""
    at = journeys.select("trip_key", F.col("stop_seq").alias("k"), "station_id", F.lag("station_id").over(Window.partitionBy("trip_key").orderBy("stop_seq")).alias("prev_station_id"))
    route = points.select(*KEYS, "m_end", F.explode(F.sequence(F.col("stop_seq") + 1, F.col("target_seq"))).alias("k")).join(shuffled(at), ["trip_key", "k"])
    st = trailing_sums(stations, route, {"station_id": "station_id"}, [*KEYS, "k"], (30,)).groupBy(*KEYS).agg(*[F.sum(f"{v}_30").alias(f"{v}_30") for v in "nsl"])
    sg = trailing_sums(segments, route, {"from_station_id": "prev_station_id", "to_station_id": "station_id"}, [*KEYS, "k"], (30,), ("n", "s"))
    sg = sg.groupBy(*KEYS).agg(
        F.sum("n_30").alias("gn"), F.sum("s_30").alias("gs"), F.sum(ratio("s_30", "n_30")).alias("net_cor_gain_sum"), F.avg((F.col("n_30") > 0).cast("double")).alias("net_cor_seg_coverage")
    )
    out = st.join(shuffled(sg), KEYS)
    return out.select(*KEYS, *_state(st, "cor", 30), F.col("gn").cast("long").alias("net_cor_seg_n"), ratio("gs", "gn").alias("net_cor_seg_mean_gain"), "net_cor_gain_sum", "net_cor_seg_coverage")


def reaches(points: DataFrame, journeys: DataFrame) -> DataFrame:
    """``(trip_key, stop_seq, m_end, k, station_id, prev_station_id)``: the stops from each departure to the farthest target of its horizons, the departure's own included.

    Horizons of one departure look at the same stops, so what they ask for is listed once.
    """
    at = journeys.select("trip_key", F.col("stop_seq").alias("k"), "station_id", F.lag("station_id").over(Window.partitionBy("trip_key").orderBy("stop_seq")).alias("prev_station_id"))
    far = points.groupBy("trip_key", "stop_seq", "m_end").agg(F.max("target_seq").alias("far"))
    return far.select("trip_key", "stop_seq", "m_end", F.explode(F.sequence("stop_seq", "far")).alias("k")).join(shuffled(at), ["trip_key", "k"])


def features_of(stations: DataFrame, segments: DataFrame, departures: DataFrame, points: DataFrame, journeys: DataFrame, cfg: Config) -> DataFrame:
    """All 33 network features of each labelled point, from the minute tables.

    A departure's stops are probed once for all horizons, roles and widths: one trailing pass over
    the stations and one over the segments. Their answers are gathered in the order of the stops, so
    the current, next and target station, the next segment and the corridor are places and
    stretches of one list.
    """
    own, reach = ["trip_key", "stop_seq"], reaches(points, journeys)
    keys = [*own, "k"]
    st = trailing_sums(stations, reach, {"station_id": "station_id"}, keys, (10, 30, 60))
    along = reach.where(F.col("k") > F.col("stop_seq"))
    sg = trailing_sums(segments, along, {"from_station_id": "prev_station_id", "to_station_id": "station_id"}, keys, (10, 30), ("n", "s"))
    at_stop = F.struct("k", *[f"{v}_{w}" for w in (10, 30, 60) for v in "nsl"])
    at_run = F.struct("k", *[f"{v}_{w}" for w in (10, 30) for v in "ns"])
    rows = st.select(*own, at_stop.alias("stop")).unionByName(sg.select(*own, at_run.alias("run")), allowMissingColumns=True)
    lists = rows.groupBy(*own).agg(F.sort_array(F.collect_list("stop")).alias("stops"), F.sort_array(F.collect_list("run")).alias("runs"))
    p = points.join(shuffled(lists), own)
    steps = (F.col("target_seq") - F.col("stop_seq")).cast("int")
    stop = lambda i: F.get("stops", F.lit(i) if isinstance(i, int) else i)
    run = F.get("runs", F.lit(0))
    p = p.select(*KEYS, "m_end", stop(0).alias("cur"), stop(1).alias("next"), stop(steps).alias("tgt"), run.alias("seg"), F.slice("stops", F.lit(2), steps).alias("route"), F.slice("runs", F.lit(1), steps).alias("runs"))
    total = lambda items, v: F.aggregate(F.transform(items, lambda x: x[v]), F.lit(0.0), lambda a, x: a + x)
    gains = F.filter(F.transform("runs", lambda x: ratio(x["s_30"], x["n_30"])), lambda g: g.isNotNull())
    mean = lambda r, v, w: ratio(F.col(f"{r}.{v}_{w}"), F.col(f"{r}.n_{w}"))
    count = lambda r, w: F.col(f"{r}.n_{w}").cast("long")
    out = p.select(
        *KEYS, "m_end",
        *[c for r in ("cur", "next", "tgt") for c in (count(r, 30).alias(f"net_{r}_n"), mean(r, "s", 30).alias(f"net_{r}_mean_delay"), mean(r, "l", 30).alias(f"net_{r}_share_late"))],
        *[c for r in ("cur", "next") for c in (count(r, 10).alias(f"net_{r}_n_10"), mean(r, "s", 10).alias(f"net_{r}_mean_delay_10"))],
        mean("cur", "s", 60).alias("net_cur_mean_delay_60"),
        count("seg", 30).alias("net_seg_n"), mean("seg", "s", 30).alias("net_seg_mean_gain"), count("seg", 10).alias("net_seg_n_10"), mean("seg", "s", 10).alias("net_seg_mean_gain_10"),
        total("route", "n_30").cast("long").alias("net_cor_n"), ratio(total("route", "s_30"), total("route", "n_30")).alias("net_cor_mean_delay"), ratio(total("route", "l_30"), total("route", "n_30")).alias("net_cor_share_late"),
        total("runs", "n_30").cast("long").alias("net_cor_seg_n"), ratio(total("runs", "s_30"), total("runs", "n_30")).alias("net_cor_seg_mean_gain"),
        F.when(F.size(gains) > 0, F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)).alias("net_cor_gain_sum"),
        (F.size(F.filter("runs", lambda x: x["n_30"] > 0)) / F.size("runs")).alias("net_cor_seg_coverage"),
    )
    once = points.dropDuplicates(own)
    ahead = last_before(departures, once, cfg).drop("horizon_min")
    whole = network_state(network_minutes(stations), once.select(*KEYS, "m_end")).drop("horizon_min")
    return out.drop("m_end").join(shuffled(whole), own).join(shuffled(ahead), own, "left")


def network_features(trains: DataFrame, journeys: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """All 33 network features of each labelled point."""
    events = network_events(trains, cfg)
    departures = segment_departures(events)
    return features_of(station_minutes(events, cfg), segment_minutes(departures), departures, prediction_points(journeys, labels, cfg), journeys, cfg)
