"""Tables made of parts, changed by one rename.

Every publish writes new folders beside those that are there and then one manifest that names the
parts of the new snapshot. The manifest's rename is the commit: whatever fails before it leaves the
last snapshot as it was, and a reader follows one manifest, so it never sees half of a change.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@dataclass
class Snapshot:
    """A version (0: nothing yet), the folder of each part, and what is recorded of each."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    records: dict[str, dict] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions committed so far, in order."""
    files, at = _files(spark, root), f"{root}/manifests"
    if not files.exists(_path(spark, at)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, at))]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The last snapshot, or that of a version."""
    version = version or max(versions(spark, root), default=0)
    if not version:
        return Snapshot()
    text = spark.read.text(f"{root}/manifests/v{version:010d}.json", wholetext=True).first()[0]
    held = json.loads(text)
    return Snapshot(version, held["parts"], held["records"])


def commit(spark: SparkSession, root: str, parts: dict[str, str], records: dict[str, dict], base: int) -> int:
    """Make the snapshot after version ``base``; fails if another one has been made since."""
    files, at = _files(spark, root), f"{root}/manifests"
    files.mkdirs(_path(spark, at))
    aside = _path(spark, f"{at}/.{uuid.uuid4().hex}")
    out = files.create(aside)
    try:
        out.write(bytearray(json.dumps({"parts": parts, "records": records}, sort_keys=True).encode()))
    finally:
        out.close()
    to = _path(spark, f"{at}/v{base + 1:010d}.json")
    if files.exists(to) or not files.rename(aside, to):
        raise OSError(f"version {base + 1} of {root} is there already")
    return base + 1


def publish(spark: SparkSession, root: str, new: dict[str, DataFrame], drop: list[str] | None = None) -> Snapshot:
    """Write the parts ``new``, take out those to ``drop``, and commit both at once.

    What a snapshot no longer names stays until ``vacuum``.
    """
    last, parts = snapshot(spark, root), {}
    for name, df in new.items():
        parts[name] = f"{root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(parts[name])
    gone = {*(drop or []), *new}
    kept = {n: p for n, p in last.parts.items() if n not in gone} | parts
    records = {n: r for n, r in last.records.items() if n not in gone}
    return Snapshot(commit(spark, root, kept, records, last.version), kept, records)


def publish_by(df: DataFrame, root: str, column: str, names: list[str], check, records: dict[str, dict] | None = None) -> Snapshot:
    """Write the rows of ``df`` as the parts ``names`` of the values of ``column``, by one job, and commit all of them at once.

    ``check`` gets the number of rows by name as it is read from the new files, and raises if it is
    not right; then nothing has changed. A name without rows is no part any more.
    """
    spark = df.sparkSession
    last, path = snapshot(spark, root), f"{root}/data/{uuid.uuid4().hex}"
    df.where(F.col(column).isin(names)).withColumn("_part", F.col(column)).write.option("compression", "zstd").partitionBy("_part").parquet(path)
    written = spark.read.schema(StructType([*df.schema.fields, StructField("_part", StringType())])).parquet(path)
    counts = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()}
    check(counts)
    parts = {n: p for n, p in last.parts.items() if n not in names} | {n: f"{path}/_part={n}" for n in counts}
    kept = {n: r for n, r in last.records.items() if n not in names} | (records or {})
    return Snapshot(commit(spark, root, parts, kept, last.version), parts, kept)


def read(spark: SparkSession, root: str, schema, names: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The rows of all parts, or of those named, of one snapshot; none where there is no part."""
    parts = snapshot(spark, root, version).parts
    paths = [p for n, p in sorted(parts.items()) if names is None or n in names]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete folders and manifests that the last ``keep`` snapshots do not name; how many folders went. No writer may be at work."""
    files, known = _files(spark, root), versions(spark, root)
    named = {p for v in known[-keep:] for p in snapshot(spark, root, v).parts.values()}
    names = {p[len(f"{root}/data/") :].split("/")[0] for p in named}
    data = _path(spark, f"{root}/data")
    old = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in names] if files.exists(data) else []
    for v in known[:-keep]:
        files.delete(_path(spark, f"{root}/manifests/v{v:010d}.json"), False)
    for path in old:
        files.delete(path, True)
    return len(old)
