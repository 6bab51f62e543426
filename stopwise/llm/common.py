"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this many bytes.
BROADCAST_BYTES = 64 << 20
#: A key that holds one of so many rows, or more, is hot.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves in local mode only; on a cluster a
    machine-local folder would be read back incompletely, so that case is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file to the shared folder by Spark's own file systems; its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The plan of the result starts at the files: later steps neither recompute what came before nor
    depend on any executor that computed it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_size(df: DataFrame) -> int:
    """Bytes of all rows of ``df``, measured one by one: the fields written out, and 8 for each and 16 for the row."""
    fields = F.octet_length(F.to_json(F.struct("*"))) + F.lit(8 * len(df.columns) + 16)
    return df.agg(F.sum(fields.cast("long"))).first()[0] or 0


def measured(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its ``written_size`` is within ``most``.

    Beyond the bound the frame is returned unmarked, and Spark shuffles both sides. ``df`` should
    be cut, as it is read twice.
    """
    return F.broadcast(df) if written_size(df) <= most else df


def join_counted(big: DataFrame, counted: DataFrame, by: str, hot: int = HOT) -> DataFrame:
    """Inner join of ``big`` with ``counted``, which has one row a key and says in ``n`` how many rows of ``big`` hold it.

    Keys with a part of 1/``hot`` of all those rows or more, at most ``hot`` of them by
    arithmetic, are broadcast, so that no key's rows meet in one task; the rest is shuffled.
    ``counted`` should be cut.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(hot) >= F.lit(total)
    many, few = counted.where(often).drop("n"), counted.where(~often).drop("n")
    others = big.join(F.broadcast(many.select(by)), by, "left_anti").join(few, by)
    return big.join(F.broadcast(many), by).unionByName(others)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``column`` holds about ``most`` bytes, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Alternates large-star and small-star steps. Each step takes a minimum per node (combined before
    the shuffle) and joins it back, so no neighbour list is ever held, and a hub's rows may be
    split over tasks. Every round is written to the shared folder. Null ends are ignored; an empty
    input gives an empty result.
    """
    e = (
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("src is not null and dst is not null and u <> v")
        .distinct()
    )
    e = cut(e)
    count = None
    for _ in range(most_rounds):
        large = _star(e, large=True)
        small = cut(_star(large, large=False))
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if count == (now["n"], now["s"]):
            break
        e, count = small, (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step on edges with u > v."""
    if large:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.where("v = m").select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()
