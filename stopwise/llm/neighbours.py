"""Approximate nearest neighbours by inner product with cross-polytope hashing.

Unit vectors are rotated by rounds of random signs and a fast Hadamard transform; the signed axis
nearest to the result is a hash. A table's bucket is as many such hashes as keep buckets near
``FILL`` rows, so their number grows with the logarithm of the rows. Every row is in one bucket of
each table. A query looks into its nearest buckets of each table, those whose axes together lose
least, and the rows there are ranked by their exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.common import cut, measured

TABLES = 8
#: Queries of the sample on which the number of probes is chosen, and the recall to reach there.
SAMPLE, AIM = 256, 0.95
#: Rows of a bucket that one task holds; larger buckets are dealt over several tasks.
SPLIT = 100_000
#: Queries of a bucket that one task holds, about.
QUERIES = 20_000
ROUNDS = 3
#: Rows that a bucket holds on average at most.
FILL = 1000
#: Buckets of a table that are probed at most; if the aim needs more, a hash less is taken, and with one hash all buckets may be.
PROBES = 64


class Rotation:
    """Pseudo-rotations of one table; vectors are padded with zeros to a power of two."""

    def __init__(self, dims: int, table: int, part: int = 0, seed: int = 7):
        self.width = 1 << max(1, (dims - 1).bit_length())
        self.signs = np.random.default_rng([seed, table, part]).choice([-1.0, 1.0], (ROUNDS, self.width))

    def turn(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x
        for signs in self.signs:
            out = out * signs
            half = 1
            while half < self.width:
                pairs = out.reshape(len(out), -1, 2, half)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), self.width)
                half *= 2
            out /= np.sqrt(self.width)
        return out

    def axes(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest signed axes of each row, nearest first, and how much each loses to the first; axis i is i, its opposite ``width + i``."""
        turned = self.turn(x)
        both = np.concatenate([-turned, turned], axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :most]
        length = np.take_along_axis(both, order, axis=1)
        return order, length - length[:, :1]


class Table:
    """Hashes of one table: a bucket is the sequence of their axes, read as one number."""

    def __init__(self, dims: int, table: int, hashes: int):
        self.parts = [Rotation(dims, table, i) for i in range(hashes)]
        self.base = 2 * self.parts[0].width
        self.size = self.base**hashes

    def buckets(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """The nearest buckets of each row, nearest first: those whose axes lose least in all."""
        found, loss = self.parts[0].axes(x, probes)
        found = found.astype(np.int64)
        for part in self.parts[1:]:
            axes, more = part.axes(x, min(probes, self.base))
            # the best of all combinations with the best so far
            total = (loss[:, :, None] + more[:, None, :]).reshape(len(x), -1)
            order = np.argsort(total, axis=1, kind="stable")[:, :probes]
            loss = np.take_along_axis(total, order, axis=1)
            first, second = order // axes.shape[1], order % axes.shape[1]
            found = np.take_along_axis(found, first, axis=1) * self.base + np.take_along_axis(axes, second, axis=1)
        return found


def lifted(x: np.ndarray, longest: float, flat: bool, query: bool) -> np.ndarray:
    """Unit vectors whose cosine orders as the inner product does.

    Where lengths differ, a row gets one component that fills it up to the longest; a query gets 0.
    """
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if flat:
        return x / norm
    if query:
        return np.concatenate([x / norm, np.zeros((len(x), 1))], axis=1)
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow column of equal-length lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores; ties go to smaller ids."""
    if scores.shape[1] > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(scores >= floor)
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def nearest(df: DataFrame, is_query, k: int = 20, vector: str = "embedding", key: str = "vec_id", tables: int = TABLES, aim: float = AIM, hashes: int | None = None) -> DataFrame:
    """``(query_id, rank, key, score)``: for each row for which ``is_query(key column)`` holds, its k nearest others.

    Nearest first, ties to the smaller key; score is the inner product in double precision. Rows
    whose key or vector is null, whose vector is empty, zero or holds null or non-finite components,
    or is not of the most common length, take no part; rows that repeat a key and vector count once.
    Fewer than k others give fewer rows. Other columns are ignored; an empty table gives none.

    Equal vectors are one node with its k + 1 smallest keys, which is all that a result can name.
    ``aim`` is the recall to reach on a sample of ``SAMPLE`` queries against brute force; the number
    of buckets probed follows from it, up to all of them, so that recall does not rest on luck. A
    bucket beyond ``SPLIT`` rows or ``QUERIES`` queries is dealt over tasks and no candidate is left out.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
    )
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = cut(rows.where(whole))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    names = f"query_id long, rank int, {key} long, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], names)
    dims = common["n"]
    rows = rows.where(F.size("vec") == dims)
    firsts = rows.dropDuplicates(["id", "vec"]).withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("place") <= k + 1)
    asks = rows.groupBy("vec").agg(F.max(is_query(F.col("id")).cast("int")).alias("asks"))
    nodes = firsts.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asks, "vec")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    nodes = cut(nodes.select(F.get("ids", F.lit(0)).alias("node"), "ids", "vec", "asks", norm.alias("norm")))
    reach = nodes.agg(F.min("norm").alias("least"), F.max("norm").alias("most")).first()
    longest, flat = reach["most"], reach["least"] > reach["most"] * (1 - 1e-6)
    hashes = hashes_for(nodes.count(), dims + (not flat)) if hashes is None else hashes
    turns, probes = _probes(nodes, tables, hashes, dims + (not flat), k, longest, flat, aim)

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many queries of a batch probe each bucket."""
        for batch in batches:
            x = lifted(matrix(batch.column("vec")), longest, flat, True)
            if not len(x):
                continue
            for t, r in enumerate(turns):
                found = np.concatenate([r.buckets(x[lo : lo + 64], probes).ravel() for lo in range(0, len(x), 64)])
                bucket, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), t, np.int32)), pa.array(bucket), pa.array(n)], ["table", "bucket", "n"])

    def placed(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lifted(matrix(batch.column("vec")), longest, flat, query)
            if not len(x):
                continue
            n = probes if query else 1
            found = np.concatenate([np.concatenate([r.buckets(x[lo : lo + 64], n) for lo in range(0, len(x), 64)]) for r in turns], axis=1)
            width = found.shape[1]
            at = pa.array(np.repeat(np.arange(len(x)), width))
            table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), n), len(x))
            columns = [batch.column("node").take(at), batch.column("vec").take(at), pa.array(table), pa.array(found.ravel())]
            for lo in range(0, len(at), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 20_000) for c in columns], ["node", "vec", "table", "bucket"])

    kind = "node long, vec array<double>, table int, bucket long"
    data = nodes.select("node", "vec").mapInArrow(lambda b: placed(b, False), kind)
    asked = nodes.where("asks = 1").select("node", "vec").mapInArrow(lambda b: placed(b, True), kind)
    # a bucket is a grid of blocks: its rows and its queries are both dealt, and every block of rows meets every block of queries
    counts = nodes.where("asks = 1").select("vec").mapInArrow(asked_for, "table int, bucket long, n long")
    counts = counts.groupBy("table", "bucket").agg(F.ceil(F.sum("n") / QUERIES).cast("int").alias("turns"))
    sizes = data.groupBy("table", "bucket").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    sizes = cut(sizes.join(counts, ["table", "bucket"]))
    dealt = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    data = data.join(measured(sizes), ["table", "bucket"]).withColumn("part", dealt("parts")).withColumn("turn", every("turns"))
    asked = asked.join(measured(sizes.toDF(*sizes.columns)), ["table", "bucket"]).withColumn("turn", dealt("turns")).withColumn("part", every("parts"))

    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(queries):
            x, ids = matrix(rows.column("vec")), rows.column("node").to_numpy()
            q, own = matrix(queries.column("vec")), queries.column("node").to_numpy()
            step = max(1, 4_000_000 // len(x))
            for lo in range(0, len(q), step):
                scores = q[lo : lo + step] @ x.T
                row, col = best(scores, ids, k + 1)
                out.append((own[lo + row], ids[col], scores[row, col]))
        own, ids, scores = (np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(3))
        return pa.table({"query": pa.array(own, pa.int64()), "node": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    by = ["table", "bucket", "part", "turn"]
    pairs = data.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(rank, "query long, node long, score double")
    # several tables may find a pair; their sums may differ in the last bit, so one of them stands for it
    pairs = pairs.groupBy("query", "node").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    kept = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    named = kept.join(nodes.select("node", "ids"), "node").select("query", (-F.col("score")).alias("less"), F.explode("ids").alias("id"))
    lists = named.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("less", "id"))), 1, k + 1).alias("found"))
    # every query row takes its vector's list, without itself
    askers = rows.where(is_query(F.col("id"))).dropDuplicates(["id", "vec"]).join(nodes.select("node", "vec"), "vec").select("id", "node")
    each = askers.join(lists, F.col("node") == F.col("query"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    out = each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "at"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("at.id").alias(key), (-F.col("at.less")).alias("score"))


def hashes_for(rows: int, dims: int) -> int:
    """Hashes of a table that keep its buckets at ``FILL`` rows or less on average."""
    base = 2 << max(1, (dims - 1).bit_length())
    return max(1, math.ceil(math.log(max(1.0, rows / FILL), base)))


def _probes(nodes: DataFrame, tables: int, hashes: int, dims: int, k: int, longest: float, flat: bool, aim: float) -> tuple[list[Table], int]:
    """The tables, and the fewest buckets of each with which a sample of queries finds ``aim`` of its true neighbours.

    The sample is bounded; its true neighbours come from all rows, block by block. If no number
    within ``PROBES`` does, the tables get a hash less.
    """
    plain = [Table(dims, t, hashes) for t in range(tables)]
    sample = nodes.where("asks = 1").select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    if not sample:
        return plain, 1
    q, own = np.array([r["vec"] for r in sample]), np.array([r["node"] for r in sample])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column("vec")), batch.column("node").to_numpy()
            if len(x):
                scores = q @ x.T
                scores[own[:, None] == ids[None, :]] = -np.inf
                row, col = best(scores, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(scores[row, col]), pa.array(ids[col]), batch.column("vec").take(pa.array(col))], ["q", "score", "node", "vec"]
                )

    found = nodes.select("node", "vec").mapInArrow(top, "q long, score double, node long, vec array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    true = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where("score > double('-inf')").select("q", "vec").collect()
    if not true:
        return plain, 1
    x, of = lifted(np.array([r["vec"] for r in true]), longest, flat, False), np.array([r["q"] for r in true])
    asked = lifted(q, longest, flat, True)
    for h in range(hashes, 0, -1):
        turns = [Table(dims, t, h) for t in range(tables)]
        most = min(turns[0].size, PROBES if h > 1 else turns[0].size)
        needed = np.full(len(x), most + 1)
        for r in turns:
            theirs = r.buckets(x)
            # a sampled query at a time, as each has a long list of buckets
            for i in range(len(asked)):
                mine = np.flatnonzero(of == i)
                met = r.buckets(asked[i : i + 1], most)[0][None, :] == theirs[mine]
                needed[mine] = np.minimum(needed[mine], np.where(met.any(axis=1), met.argmax(axis=1) + 1, most + 1))
        fewest = int(np.sort(needed)[int(np.ceil(aim * len(needed))) - 1])
        if fewest <= most:
            return turns, fewest
    raise RuntimeError("one hash reaches every bucket")
