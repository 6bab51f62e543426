"""General DataFrame operators that the analyses are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import register_sql
from stopwise.operators.ranks import numbered


def project_sets(df: DataFrame, chosen: list[str], sets: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Keys and the columns of the chosen named sets, in order and each once."""
    return df.select(*dict.fromkeys([*keys, *(c for name in chosen for c in sets[name])]))


def load(df: DataFrame, where: str, columns: list[str], other: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Filtered rows and the wanted columns; ``other`` is joined only if one of its columns is wanted."""
    if other is not None and set(columns) - set(df.columns):
        df = df.join(other, on, "left")
    return df.where(where).select(*columns)


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` keys with the smallest MD5: a sample that any engine can repeat."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.select(*keys).orderBy(F.md5(text.cast("binary")), *keys).limit(most)


def flags_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else c for c, t in df.dtypes])


def explode_route(points: DataFrame) -> DataFrame:
    """A row for each stop after the point up to its target."""
    return points.where("target_seq is not null").withColumn("route_seq", F.explode(F.sequence(F.col("stop_seq") + 1, F.col("target_seq"))))


def route_stops(points: DataFrame, journeys: DataFrame) -> DataFrame:
    """The stations from a point's next stop to its target; output grows with the routes, not with pairs of stops."""
    stops = journeys.select("trip_key", F.col("stop_seq").alias("route_seq"), F.col("station_id"))
    return explode_route(points.select("trip_key", "stop_seq", "horizon_min", "target_seq")).join(stops, ["trip_key", "route_seq"]).select("trip_key", "stop_seq", "horizon_min", "route_seq", "station_id")


def stops_of_points(points: DataFrame, journeys: DataFrame) -> DataFrame:
    """The current and the target stop beside each point."""
    now = journeys.select("trip_key", "stop_seq", F.col("dep_planned").alias("now_dep"))
    then = journeys.select("trip_key", F.col("stop_seq").alias("target_seq"), F.col("arr_planned").alias("then_arr"), F.col("station_id").alias("then_station"))
    p = points.select("trip_key", "stop_seq", "horizon_min", "target_seq")
    return p.join(now, ["trip_key", "stop_seq"]).join(then, ["trip_key", "target_seq"]).select("trip_key", "stop_seq", "horizon_min", "now_dep", "then_arr", "then_station")


def adjacency(ordered: DataFrame) -> DataFrame:
    """Each pair of neighbouring stations in both directions, once."""
    e = ordered.where("next_station_id is not null").select(F.col("station_id").alias("a"), F.col("next_station_id").alias("b"))
    return e.union(e.select("b", "a")).distinct()


def neighbours(places: DataFrame, ordered: DataFrame) -> DataFrame:
    """Stations next to any station of a trip."""
    near = adjacency(ordered).select(F.col("a").alias("station_id"), "b")
    return places.distinct().join(near, "station_id").select("trip_key", F.col("b").alias("station_id")).distinct()


def induced_edges(places: DataFrame, ordered: DataFrame) -> DataFrame:
    """Directed neighbour pairs with both ends among a trip's stations."""
    e = ordered.where("next_station_id is not null").select(F.col("station_id").alias("a"), F.col("next_station_id").alias("b")).distinct()
    v = places.distinct()
    return v.withColumnRenamed("station_id", "a").join(e, "a").join(v.withColumnRenamed("station_id", "b"), ["trip_key", "b"]).select("trip_key", "a", "b")


def across_horizons(labels: DataFrame) -> DataFrame:
    """Values of three horizons of each point in one row."""
    keys = ["trip_key", "stop_seq"]
    part = lambda h, c, name: labels.where(F.col("horizon_min") == h).select(*keys, F.col(c).alias(name))
    return part(15, "d0_min", "x").join(labels.where("horizon_min = 15 and in_common_subset").select(*keys), keys, "left_semi").join(part(30, "delta_min", "y"), keys).join(part(60, "delta_min", "z"), keys)


def complete_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with their match; fails if a key of ``right`` repeats or a left row has no match."""
    if right.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {on} are not unique")
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    if joined.where("_there is null").limit(1).count():
        raise ValueError(f"rows without a match on {on}")
    return joined.drop("_there")


def quantiles(df: DataFrame, by: list[str], x: str, named: dict[str, float]) -> DataFrame:
    """Exact continuous quantiles in one pass."""
    found = df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, named.values()))).alias("_q"))
    return found.select(*by, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(named)])


def zscore(df: DataFrame, x: str, reference: Column, name: str) -> DataFrame:
    """Distance of x from the mean of the reference rows in their population deviations. One row of statistics is broadcast."""
    stats = df.where(reference).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.join(F.broadcast(stats)).withColumn(name, F.when(F.col("_s") != 0, (F.col(x) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def weighted_mean(df: DataFrame, by: list[str], x: str, weight: str) -> DataFrame:
    """Mean of x by weight over rows where x is known, as ``m``."""
    w = F.when(F.col(x).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg((F.sum(w * F.col(x)) / F.sum(w)).alias("m"))


def clipped_histogram(df: DataFrame, x: str, lo: int, hi: int) -> DataFrame:
    """Counts by whole number of x, the ends gathering what lies beyond."""
    return df.where(F.col(x).isNotNull()).groupBy(F.greatest(F.least(F.floor(x), F.lit(hi)), F.lit(lo)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, x: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return df.agg(
        F.count(x).alias("n"), r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("lo"), r(F.percentile(x, 0.25)).alias("q1"),
        r(F.median(x)).alias("q2"), r(F.percentile(x, 0.75)).alias("q3"), r(F.max(x)).alias("hi"),
    )


def complete_groups(df: DataFrame, by: list[str], member: str, n: int) -> DataFrame:
    """Rows of groups that have all n members."""
    return df.withColumn("_n", F.size(F.collect_set(member).over(Window.partitionBy(*by)))).where(F.col("_n") == n).drop("_n")


def shares(df: DataFrame, by: list[str], within: list[str], name: str) -> DataFrame:
    """Group counts, their share of all rows and of the rows of ``within``. The total comes from the grouped rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    part = n.groupBy(*within).agg(F.sum("n").alias("_part"))
    return n.join(F.broadcast(total)).join(part, within).select(*by, "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("n") / F.col("_part")).alias(name))


def capped(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """All rows with their rank and whether it is within the cap."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("kept", F.col("rank") <= most)


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys numbered from 0 in order; see ``numbered``."""
    return numbered(df.select(key), [F.col(key)], "idx")


def arrivals_and_departures(journeys: DataFrame) -> DataFrame:
    """One row for each measured arrival and departure."""
    arr = journeys.where("arr_delay_min is not null").select("station_id", F.col("arr_actual").alias("t"), F.col("arr_delay_min").alias("delay"))
    dep = journeys.where("dep_delay_min is not null").select("station_id", F.col("dep_actual").alias("t"), F.col("dep_delay_min").alias("delay"))
    return arr.unionByName(dep)


def packed(df: DataFrame, by: list[str], order: str, x: str, size: int) -> DataFrame:
    """The first values of each group as an array filled up with zeros, and how many are real."""
    ranked = capped(df, by, [F.col(order)], size).where("kept")
    got = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(x).alias("v")))).alias("_v"))
    values = F.transform("_v", lambda s: s["v"])
    filled = F.slice(F.concat(values, F.array_repeat(F.lit(0), size)), 1, size)
    return got.select(*by, F.size("_v").alias("n"), filled.alias("ids"))


def quantile_buckets(df: DataFrame, x: str, levels: list[float], name: str) -> DataFrame:
    """Rows with the number of data quantiles at or below x. One row of edges is broadcast."""
    edges = df.agg(F.percentile(x, F.array(*map(F.lit, levels))).alias("_e"))
    return df.join(F.broadcast(edges)).withColumn(name, F.size(F.filter("_e", lambda e: e <= F.col(x)))).drop("_e")


def with_sql_functions(spark: SparkSession, journeys: DataFrame, cfg: Config) -> DataFrame:
    register_sql(spark, cfg)
    return spark.sql("select trip_key, stop_seq, sw_ratio(dep_delay_min, arr_delay_min) as r, sw_pinball(dep_delay_min, arr_delay_min, 0.9D) as loss from {j}", j=journeys)
