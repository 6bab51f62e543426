"""The station graph and the part of it around each prediction point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.config import Config
from stopwise.functions.columns import d0_bucket, elapsed_min, hash_bucket
from stopwise.operators.network import shuffled, trailing_sums

POINT = ["trip_key", "stop_seq"]


def static_edges(ordered: DataFrame, cfg: Config) -> DataFrame:
    """Directed planned edges that enough runs use, with their number and median planned running time."""
    run = elapsed_min("dep_planned", "next_arr_planned")
    e = ordered.where("next_station_id is not null").select(F.col("station_id").alias("from_station_id"), F.col("next_station_id").alias("to_station_id"), run.alias("run"))
    return e.groupBy("from_station_id", "to_station_id").agg(F.count("*").alias("n_runs"), F.median("run").alias("run_planned_min")).where(F.col("n_runs") >= cfg.min_edge_runs)


def static_stations(ordered: DataFrame) -> DataFrame:
    """Stations with their stops a day."""
    return ordered.groupBy("station_id").agg((F.count("*") / F.count_distinct("operating_day")).alias("daily_stops"))


def subgraph_nodes(points: DataFrame, journeys: DataFrame, edges: DataFrame, stations: DataFrame, cfg: Config) -> DataFrame:
    """Stations of each point: its route first (role 0 current, 1 between, 2 target), then neighbours of the route (role 3) by traffic, up to the cap.

    ``pos`` numbers them from 0, ``hop`` counts the stops from the current one and ``planned_min``
    the planned minutes to it, and ``found`` is how many there were before the cap. A point is
    ``(trip_key, stop_seq, target_seq)``. Edges and stations are broadcast if Spark finds them small.
    """
    at = journeys.select("trip_key", F.col("stop_seq").alias("k"), "station_id", F.coalesce("arr_planned", "dep_planned").alias("there"))
    now = journeys.select("trip_key", "stop_seq", F.col("dep_planned").alias("here"))
    p = points.select(*POINT, "target_seq").join(shuffled(now), POINT)
    route = p.withColumn("k", F.explode(F.sequence("stop_seq", "target_seq"))).join(shuffled(at), ["trip_key", "k"])
    role = F.when(F.col("k") == F.col("stop_seq"), 0).when(F.col("k") == F.col("target_seq"), 2).otherwise(1)
    ahead = F.when(F.col("k") == F.col("stop_seq"), F.lit(0.0)).otherwise(elapsed_min("here", "there"))
    route = route.select(*POINT, "station_id", role.alias("role"), (F.col("k") - F.col("stop_seq")).cast("int").alias("hop"), ahead.alias("planned_min"))
    near = edges.select(F.col("from_station_id").alias("station_id"), F.col("to_station_id").alias("other"))
    near = near.union(near.select("other", "station_id")).distinct()
    around = route.join(near, "station_id").select(*POINT, F.col("other").alias("station_id")).distinct().join(shuffled(route.select(*POINT, "station_id")), [*POINT, "station_id"], "left_anti")
    nodes = route.unionByName(around.select("*", F.lit(3).alias("role"), F.lit(None).cast("int").alias("hop"), F.lit(None).cast("double").alias("planned_min")))
    nodes = nodes.join(stations, "station_id", "left")
    order = [(F.col("role") == 3).cast("int"), F.col("hop").asc_nulls_last(), F.desc_nulls_last(F.round("daily_stops", 6)), F.col("station_id")]
    w = Window.partitionBy(*POINT)
    ranked = nodes.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("found", F.count("*").over(w))
    return ranked.where(F.col("pos") < cfg.max_nodes).select(*POINT, "pos", "station_id", "role", "hop", "planned_min", "daily_stops", "found")


def subgraph_edges(nodes: DataFrame, edges: DataFrame, cfg: Config) -> DataFrame:
    """Static edges between nodes of a point: those along the route first, then by runs, up to the cap."""
    a = nodes.select(*POINT, F.col("pos").alias("from_pos"), F.col("station_id").alias("from_station_id"), F.col("role").alias("ra"), F.col("hop").alias("ha"))
    b = nodes.select(*POINT, F.col("pos").alias("to_pos"), F.col("station_id").alias("to_station_id"), F.col("role").alias("rb"), F.col("hop").alias("hb"))
    e = a.join(edges, "from_station_id").join(shuffled(b), [*POINT, "to_station_id"])
    on_route = (F.col("ra") < 3) & (F.col("rb") < 3) & (F.col("hb") == F.col("ha") + 1)
    e = e.withColumn("on_route", F.coalesce(on_route, F.lit(False)))
    w = Window.partitionBy(*POINT)
    eid = F.row_number().over(w.orderBy(F.desc("on_route"), F.desc("n_runs"), "from_pos", "to_pos")) - 1
    ranked = e.withColumn("eid", eid).withColumn("found", F.count("*").over(w)).where(F.col("eid") < cfg.max_edges)
    return ranked.select(*POINT, "eid", "from_pos", "to_pos", "from_station_id", "to_station_id", "on_route", "n_runs", "run_planned_min", "found")


#: Roles of a node by number.
ROLES = ("current", "route", "target", "neighbour")
NODE_FEATURES = [f"{c}_{w}" for w in (10, 30, 60) for c in ("log_n", "mean_delay", "share_late")] + [f"is_{r}" for r in ROLES] + ["route_offset", "planned_min", "log_traffic"]
EDGE_FEATURES = ["log_runs", "run_planned_min", "on_route"] + [f"{c}_{w}" for w in (10, 30) for c in ("log_n", "mean_gain")]


def _share(part: str, of: str, name: str) -> Column:
    """A ratio in which nothing counts as 0."""
    return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(0.0).alias(name)


def node_features(nodes: DataFrame, points: DataFrame, stations: DataFrame) -> DataFrame:
    """The 16 features of each node: what happened there in the last 10, 30 and 60 minutes, its role and place, and its traffic."""
    keys = [*POINT, "pos"]
    n = nodes.join(shuffled(points.select(*POINT, "m_end")), POINT)
    s = trailing_sums(stations, n, {"station_id": "station_id"}, keys, (10, 30, 60), ("n", "s", "l"))
    seen = [c for w in (10, 30, 60) for c in (F.log1p(f"n_{w}").alias(f"log_n_{w}"), _share(f"s_{w}", f"n_{w}", f"mean_delay_{w}"), _share(f"l_{w}", f"n_{w}", f"share_late_{w}"))]
    own = [(F.col("role") == i).cast("double").alias(f"is_{r}") for i, r in enumerate(ROLES)]
    own += [F.coalesce("hop", F.lit(0)).cast("double").alias("route_offset"), F.coalesce("planned_min", F.lit(0.0)).alias("planned_min"), F.log1p("daily_stops").alias("log_traffic")]
    return s.select(*keys, *seen).join(shuffled(nodes.select(*keys, *own)), keys)


def edge_features(edges: DataFrame, points: DataFrame, segments: DataFrame) -> DataFrame:
    """The 7 features of each edge: its runs and planned time, whether it is on the route, and the delay gained there in the last 10 and 30 minutes."""
    keys = [*POINT, "eid"]
    e = edges.join(shuffled(points.select(*POINT, "m_end")), POINT)
    s = trailing_sums(segments, e, {"from_station_id": "from_station_id", "to_station_id": "to_station_id"}, keys, (10, 30), ("n", "s"))
    seen = [c for w in (10, 30) for c in (F.log1p(f"n_{w}").alias(f"log_n_{w}"), _share(f"s_{w}", f"n_{w}", f"mean_gain_{w}"))]
    own = [F.log1p("n_runs").alias("log_runs"), "run_planned_min", F.col("on_route").cast("double").alias("on_route")]
    return s.select(*keys, *seen).join(shuffled(edges.select(*keys, *own)), keys)


def pack_subgraphs(nodes: DataFrame, edges: DataFrame, node_x: DataFrame, edge_x: DataFrame, cfg: Config) -> DataFrame:
    """One row a point: stations, ends of edges and features in order, filled up to the caps, with how many are real and how many the caps dropped."""

    def filled(of: str, field: str, fill: Column, size: int) -> Column:
        return F.slice(F.concat(F.transform(of, lambda x: x[field]), F.array_repeat(fill, size)), 1, size).alias(f"{of}_{field}")

    nx = node_x.select(*POINT, "pos", F.array(*NODE_FEATURES).alias("x"))
    ex = edge_x.select(*POINT, "eid", F.array(*EDGE_FEATURES).alias("x"))
    n = nodes.join(shuffled(nx), [*POINT, "pos"]).groupBy(*POINT).agg(F.sort_array(F.collect_list(F.struct("pos", "station_id", "x"))).alias("node"), F.max("found").alias("node_found"))
    e = edges.join(shuffled(ex), [*POINT, "eid"]).groupBy(*POINT).agg(F.sort_array(F.collect_list(F.struct("eid", "from_pos", "to_pos", "x"))).alias("edge"), F.max("found").alias("edge_found"))
    both = n.join(shuffled(e), POINT, "left").withColumn("edge", F.coalesce("edge", F.array().cast(e.schema["edge"].dataType)))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return both.select(
        *POINT, F.size("node").alias("n_nodes"), F.size("edge").alias("n_edges"), (F.col("node_found") - F.size("node")).alias("dropped_nodes"),
        (F.coalesce("edge_found", F.lit(0)) - F.size("edge")).alias("dropped_edges"), filled("node", "station_id", F.lit(0), cfg.max_nodes), filled("edge", "from_pos", F.lit(-1), cfg.max_edges),
        filled("edge", "to_pos", F.lit(-1), cfg.max_edges), filled("node", "x", zeros(len(NODE_FEATURES)), cfg.max_nodes), filled("edge", "x", zeros(len(EDGE_FEATURES)), cfg.max_edges),
    )


def _hops(n: int, point: np.ndarray, a: np.ndarray, b: np.ndarray, points: int, most: int) -> np.ndarray:
    """``(points, n, n)`` bytes: the steps between the nodes of points with ``n`` each, whose edges are ``a`` to ``b`` of ``point``; bits of a number are the nodes reached."""
    inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
    beside = np.zeros((points, n, n), bool)
    beside[point[inside], a[inside], b[inside]] = beside[point[inside], b[inside], a[inside]] = True
    beside[:, range(n), range(n)] = True
    bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
    near = (beside * bits).sum(axis=2, dtype=np.uint64)
    reached, hops = np.broadcast_to(bits, (points, n)), np.zeros((points, n, n), np.uint8)
    for step in range(most + 1):
        hops += (reached[:, :, None] & bits) == 0
        if step < most:
            grown = reached.copy()
            for i in range(n):
                grown |= ((reached >> np.uint64(i)) & np.uint64(1)) * near[:, i, None]
            if (grown == reached).all():
                hops += ((reached[:, :, None] & bits) == 0) * np.uint8(most - step)
                break
            reached = grown
    return hops


def hop_matrix(nodes: DataFrame, edges: DataFrame, most: int = 6, block: int = 512) -> DataFrame:
    """``(trip_key, stop_seq, n, hops)``, a row a point: n x n bytes, row by row, the fewest undirected steps between its nodes; ``most`` + 1 if farther or not connected.

    A point's edges are gathered into one row, so there is one shuffle whatever the number of
    steps, and points with equally many nodes are stepped together, ``block`` at a time. A point
    may have up to 63 nodes, and ``most`` may be up to 14.
    """
    ends = edges.where("from_pos is not null and to_pos is not null").groupBy(*POINT).agg(F.collect_list(F.struct("from_pos", "to_pos")).alias("ends"))
    ends = ends.select(*POINT, *[F.col(f"ends.{c}").cast("array<int>").alias(c) for c in ("from_pos", "to_pos")])
    p = nodes.groupBy(*POINT).agg((F.max("pos") + 1).cast("int").alias("n")).join(shuffled(ends), POINT, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (batch.slice(at, block) for batch in batches for at in range(0, batch.num_rows, block)):
            sizes = rows.column("n").to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                some = rows.take(pa.array(np.flatnonzero(sizes == n)))
                lists = [some.column(c) for c in ("from_pos", "to_pos")]
                point = pc.list_parent_indices(lists[0]).to_numpy(zero_copy_only=False)
                hops = _hops(int(n), point, *[x.flatten().to_numpy(zero_copy_only=False) for x in lists], some.num_rows, most)
                cuts = pa.py_buffer(np.arange(some.num_rows + 1, dtype=np.int32) * np.int32(n * n))
                packed = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, cuts, pa.py_buffer(hops)])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in POINT), some.column("n"), packed], names=[*POINT, "n", "hops"])

    kinds = dict(nodes.dtypes)
    return p.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in POINT], "n int", "hops binary"]))


def hop_distances(nodes: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """``hop_matrix`` laid out: a row for each pair of a point's nodes."""
    digits = F.col("digits")
    pairs = hop_matrix(nodes, edges, most).select(*POINT, "n", F.hex("hops").alias("digits"))
    pairs = pairs.select(*POINT, "n", "digits", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1)).alias("at"))
    hops = F.conv(F.substring(digits, 2 * F.col("at") + 1, F.lit(2)), 16, 10).cast("int")
    return pairs.select(*POINT, F.floor(F.col("at") / F.col("n")).cast("int").alias("from_pos"), (F.col("at") % F.col("n")).cast("int").alias("to_pos"), hops.alias("hops"))


def rewire_edges(edges: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """A control: each edge between two nodes of its point drawn by a hash."""
    n = nodes.groupBy(*POINT).agg(F.count("*").alias("n"))
    key = lambda end: F.concat_ws("|", "trip_key", F.col("stop_seq").cast("string"), F.col("eid").cast("string"), F.lit(end))
    return edges.join(shuffled(n), POINT).select(*POINT, "eid", hash_bucket(key("a"), seed, F.col("n")).alias("from_pos"), hash_bucket(key("b"), seed, F.col("n")).alias("to_pos"))


def feature_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, mean, std)``: mean and population deviation, a millionth more, of each column over all rows."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-6).alias("std"))


def showcase(labels: DataFrame, journeys: DataFrame, predictions: DataFrame, cfg: Config, most: int = 5, seed: int = 9) -> DataFrame:
    """Example departures of each delay bucket, all of whose horizons are known: a row for each example and horizon.

    One departure a day and one a line of a bucket may be shown, the first by a hash, and ``most``
    of each bucket: a diverse pick without a sequential search.
    """
    known = labels.where("in_common_subset and line_name is not null")
    one = known.select("operating_day", "category", "line_name", *POINT, "d0_min").distinct().withColumn("d0_bucket", d0_bucket("d0_min", cfg))
    one = one.withColumn("_h", hash_bucket(F.concat_ws("|", "trip_key", F.col("stop_seq").cast("string")), seed, 1 << 30))
    for by in (["operating_day"], ["d0_bucket", "category", "line_name"], ["d0_bucket"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", *POINT))
        one = one.withColumn("_r", rank).where(F.col("_r") <= (most if by == ["d0_bucket"] else 1))
    names = journeys.groupBy("station_id").agg(F.mode("station_name", True).alias("name"))
    rows = one.select("d0_bucket", *POINT).join(known, POINT).join(predictions, [*POINT, "horizon_min"], "left")
    rows = rows.join(names.select("station_id", F.col("name").alias("origin")), "station_id", "left").join(names.select(F.col("station_id").alias("target_station_id"), F.col("name").alias("target")), "target_station_id", "left")
    return rows.select(
        "d0_bucket", *POINT, "horizon_min", F.concat_ws(" ", "category", "line_name").alias("train"), "train_number", F.date_format("operating_day", "EEEE").alias("weekday"), "origin",
        F.date_format("dep_planned", "HH:mm").alias("planned"), "d0_min", "target", F.date_format("target_arr_planned", "HH:mm").alias("target_planned"), "target_delay_min", "delta_min", "prediction",
    )
