"""Daily CSV files of stop records: scan, typing, validation, audit and publishing."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stopwise.sources import snapshots

#: Columns of the files, their names here, and how each is typed.
COLUMNS = {
    "BETRIEBSTAG": ("operating_day", "day"), "FAHRT_BEZEICHNER": ("trip_id", "text"), "BETREIBER_ID": ("operator_id", "text"), "BETREIBER_ABK": ("operator_abbr", "text"),
    "BETREIBER_NAME": ("operator_name", "text"), "PRODUKT_ID": ("transport_mode", "text"), "LINIEN_ID": ("train_number", "text"), "LINIEN_TEXT": ("line_name", "text"),
    "UMLAUF_ID": ("rotation_id", "text"), "VERKEHRSMITTEL_TEXT": ("category", "text"), "ZUSATZFAHRT_TF": ("is_extra_trip", "flag"), "FAELLT_AUS_TF": ("is_cancelled", "flag"),
    "BPUIC": ("station_id", "int"), "HALTESTELLEN_NAME": ("station_name", "text"), "ANKUNFTSZEIT": ("arr_planned", "minute"), "AN_PROGNOSE": ("arr_actual", "second"),
    "AN_PROGNOSE_STATUS": ("arr_status", "text"), "ABFAHRTSZEIT": ("dep_planned", "minute"), "AB_PROGNOSE": ("dep_actual", "second"), "AB_PROGNOSE_STATUS": ("dep_status", "text"),
    "DURCHFAHRT_TF": ("is_pass_through", "flag"),
}
KNOWN_EXTRA = {"SLOID"}


def check_columns(found: list[str]) -> list[str]:
    """Unknown columns, sorted; a missing one is an error."""
    missing = sorted(set(COLUMNS) - set(found))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return sorted(set(found) - set(COLUMNS) - KNOWN_EXTRA)


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under a path by the columns that their first line names, in a fixed number of jobs.

    The first line of a file is the one that the split at its start reads first. Lines are read
    without a reader's own header handling, so that all files are inspected by one distributed scan; a
    partition keeps one line of each file, and the driver receives one row a file, of which it lists the names anyway.
    """
    lines = spark.read.text(path, recursiveFileLookup=True)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    firsts = placed.where("at = 0").withColumn("_n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "_n").alias("line"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(firsts.collect(), key=lambda r: r["file"]):
        names = next(csv.reader([r["line"].lstrip("\ufeff")], delimiter=";"))
        out.setdefault(tuple(names), []).append(r["file"])
    for names in out:
        check_columns(list(names))
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path as text, by column name, with the date in each file's path as ``file_date``.

    The header of every file is read and checked. Files of one header are scanned together, and
    what a file does not have is null, so that order and additional columns may change from day to day.
    """
    out = None
    for names, files in headers(spark, path).items():
        schema = StructType([StructField(n, StringType()) for n in names])
        raw = spark.read.schema(schema).option("sep", ";").option("header", True).csv(files)
        date = F.regexp_extract(F.col("_metadata.file_path"), r".*(\d{4}-\d{2}-\d{2})", 1)
        raw = raw.select("*", date.try_cast("date").alias("file_date"), F.lit(",".join(check_columns(list(names)))).alias("extra_columns"))
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files under {path}")
    return out


def _typed(raw: str, kind: str) -> Column:
    c = F.col(raw)
    if kind == "day":
        return F.try_to_timestamp(c, F.lit("d.M.yyyy")).cast("date")
    if kind in ("minute", "second"):
        return F.try_to_timestamp(c, F.lit("d.M.yyyy H:m" + (":s" if kind == "second" else ""))).cast("timestamp_ntz")
    if kind == "int":
        return c.try_cast("int")
    return F.lower(c) == "true" if kind == "flag" else c


def typed(raw: DataFrame, mode: str = "ZUG") -> DataFrame:
    """Rows of one mode, renamed and typed; what cannot be read is null."""
    rows = raw.where(F.upper("PRODUKT_ID") == mode)
    return rows.select(*[_typed(r, k).alias(n) for r, (n, k) in COLUMNS.items()], "file_date")


def unreadable(raw: DataFrame, mode: str = "ZUG") -> DataFrame:
    """``(column, n)``: values that are there but cannot be read, by column."""
    hard = {r: (n, k) for r, (n, k) in COLUMNS.items() if k in ("day", "minute", "second", "int")}
    rows = raw.where(F.upper("PRODUKT_ID") == mode)
    counts = rows.agg(*[F.count_if(F.nullif(F.trim(F.col(r)), F.lit("")).isNotNull() & _typed(r, k).isNull()).alias(n) for r, (n, k) in hard.items()])
    return counts.unpivot([], [n for n, _ in hard.values()], "column", "n").where("n > 0")


def validation_report(raw: DataFrame, month: str, mode: str = "ZUG") -> DataFrame:
    """``(problem, what, n)`` rows: unreadable values, days other than the file's, days outside the month, in several files, or missing."""
    t = typed(raw, mode)
    days = t.groupBy("operating_day", "file_date").agg(F.count("*").alias("n"))
    bad = unreadable(raw, mode).select(F.lit("unreadable").alias("problem"), F.col("column").alias("what"), "n")
    wrong = days.where(~F.col("operating_day").eqNullSafe(F.col("file_date"))).select(F.lit("wrong day"), F.col("operating_day").cast("string"), "n")
    outside = days.where(F.date_format("operating_day", "yyyy-MM") != month).select(F.lit("outside month"), F.col("operating_day").cast("string"), "n")
    several = days.groupBy("operating_day").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("several files"), F.col("operating_day").cast("string"), "n")
    first = F.lit(f"{month}-01").cast("date")
    calendar = raw.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("operating_day"))
    gone = calendar.join(days, "operating_day", "left_anti").select(F.lit("missing day"), F.col("operating_day").cast("string"), F.lit(0).cast("long"))
    return bad.union(wrong).union(outside).union(several).union(gone)


def audit(raw: DataFrame, mode: str = "ZUG") -> DataFrame:
    """Of each month its days, rows, rows of the mode, and rows by day."""
    day = _typed("BETRIEBSTAG", "day")
    days = raw.groupBy(day.alias("day")).agg(F.count("*").alias("raw_rows"), F.count_if(F.upper("PRODUKT_ID") == mode).alias("train_rows"))
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("days"), F.sum("raw_rows").alias("raw_rows"), F.sum("train_rows").alias("train_rows"), F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), "train_rows"))).alias("by_day")
    )


def months_to_build(requested: list[str], done: dict[str, dict], force: bool = False) -> list[str]:
    """Requested months, each once, that ``done`` does not record yet, or all of them."""
    return [m for m in dict.fromkeys(requested) if force or m not in done]


def publish(trains: DataFrame, root: str, expected: dict[str, int] | None = None, months: list[str] | None = None, records: dict[str, dict] | None = None) -> int:
    """Publish the given months of ``trains`` (by default all that it has) as one new snapshot, each in place of the one there, sorted within files of whole days; the number of rows.

    What has been written is counted by month, against ``expected``, or else against the rows that
    were observed on their way into the files, so ``trains`` is read once. If a month differs, or
    anything fails, the last snapshot stays what it was.
    """
    month = F.date_format("operating_day", "yyyy-MM")
    if months is None:
        months = sorted(r[0] for r in trains.select(month).distinct().collect() if r[0])
    seen, total = Observation(), []
    rows = trains.withColumn("_month", month).observe(seen, *[F.count_if(F.col("_month") == m).alias(m) for m in months])
    rows = rows.repartition("_month", "operating_day").sortWithinPartitions("operating_day", "trip_id")

    def check(written: dict[str, int]) -> None:
        given = {m: n for m, n in (seen.get if expected is None else expected).items() if n}
        if written != given:
            raise ValueError(f"rows differ: given {given}, written {written}")
        total.append(sum(written.values()))

    snapshots.publish_by(rows, root, "_month", months, check, records)
    return total[0]


def build(raw: DataFrame, root: str, requested: list[str], force: bool = False, require_full_month: bool = True, mode: str = "ZUG") -> dict[str, str]:
    """Build the requested months that the last snapshot lacks, in one commit; what became of each: built, skipped or absent.

    A month is validated first: with unreadable values, wrong, foreign or double days, or (if
    ``require_full_month``) missing ones, nothing is published and the error names all problems. Its
    audit (days, rows, rows of the mode, rows by day) is recorded with it, and its rows are counted against it.
    """
    spark = raw.sparkSession
    todo = months_to_build(requested, snapshots.snapshot(spark, root).records, force)
    out = {m: "skipped" for m in requested if m not in todo}
    if not todo:
        return out
    # by the file's date, so that a row of another day is found and not filtered out
    own = raw.where(F.date_format("file_date", "yyyy-MM").isin(todo))
    audits = {r["month"]: r.asDict() for r in audit(own, mode).where(F.col("month").isin(todo)).collect()}
    there = [m for m in todo if m in audits]
    errors = []
    for m in there:
        found = validation_report(own.where(F.date_format("file_date", "yyyy-MM") == m), m, mode).collect()
        errors += [f"{m}: {r['problem']} {r['what']} ({r['n']})" for r in found if require_full_month or r["problem"] != "missing day"]
    if errors:
        raise ValueError("failed validation: " + "; ".join(sorted(errors)))
    if there:
        publish(typed(own, mode), root, {m: audits[m]["train_rows"] for m in there}, there, {m: audits[m] for m in there})
    return out | {m: "built" if m in audits else "absent" for m in todo}


def read_months(spark: SparkSession, root: str, schema, months: list[str] | None = None) -> DataFrame:
    """Rows of the last snapshot with their ``month``."""
    return snapshots.read(spark, root, schema, months).withColumn("month", F.date_format("operating_day", "yyyy-MM"))


def write_report(df: DataFrame, path: str) -> None:
    """A small metric table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def day_files(trains: DataFrame, path: str) -> None:
    """Write stop records as daily CSV files in the form that ``scan`` reads, one folder a ``file_date``; text columns as they are."""
    shape = {"day": "dd.MM.yyyy", "minute": "dd.MM.yyyy HH:mm", "second": "dd.MM.yyyy HH:mm:ss"}

    def text(name: str, kind: str) -> Column:
        plain = kind not in shape or isinstance(trains.schema[name].dataType, StringType)
        return F.col(name).cast("string") if plain else F.date_format(name, shape[kind])

    raw = trains.select(*[(text(n, k) if n in trains.columns else F.lit(None).cast("string")).alias(r) for r, (n, k) in COLUMNS.items()], *[c for c in trains.columns if c in ("file_date", "NOTE")])
    if "NOTE" in raw.columns:  # an additional first column
        raw = raw.select("NOTE", *[c for c in raw.columns if c != "NOTE"])
    raw.write.mode("append").partitionBy("file_date").option("sep", ";").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str = "month string, days long, raw_rows long, train_rows long, by_day map<string, long>") -> DataFrame:
    return spark.read.schema(schema).json(path)
