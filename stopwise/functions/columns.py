"""Column helpers: scalar rules of the data model as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopwise.config import Config


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_s(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a time without zone; the session's zone plays no part."""
    t = _c(ts)
    days = F.date_diff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def minute_idx(ts: Column | str) -> Column:
    """Whole minutes since 1970."""
    return F.floor(epoch_s(ts) / 60).cast("long")


def elapsed_min(start: Column | str, end: Column | str) -> Column:
    """Minutes between two times, as a double."""
    return (epoch_s(end) - epoch_s(start)) / F.lit(60.0)


def plus_minutes(ts: Column | str, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return _c(ts) + F.make_dt_interval(mins=m)


def in_country(station: Column | str, prefix: int) -> Column:
    """Whether a station number is of this country; null is not."""
    return F.coalesce(F.floor(_c(station) / 100000) == prefix, F.lit(False))


def valid_delay(status: Column | str, planned: Column | str, actual: Column | str, cfg: Config) -> Column:
    """Delay in minutes where it was really observed and lies within the valid range, else null."""
    d = elapsed_min(planned, actual)
    return F.when((_c(status) == "REAL") & d.between(cfg.delay_min, cfg.delay_max), d)


def trip_key(day: Column | str, trip: Column | str) -> Column:
    return F.concat(_c(day).cast("string"), F.lit("|"), _c(trip))


def date_split(day: Column | str, cfg: Config, strict: bool = False) -> Column:
    """train, valid, test or production by date. If ``strict``, a date outside the period is an error, as is a missing one."""
    d = _c(day)
    bound = lambda x: F.lit(x).cast("date")
    split = F.when(d <= bound(cfg.train_end), "train").when(d <= bound(cfg.valid_end), "valid").when(d <= bound(cfg.test_end), "test").otherwise("production")
    if not strict:
        return split
    within = F.coalesce(d.between(bound(cfg.period_start), bound(cfg.period_end)), F.lit(False))
    outside = F.raise_error(F.concat(F.coalesce(d.cast("string"), F.lit("a missing date")), F.lit(" is outside the study period")))
    return F.when(within, split).otherwise(outside.cast("string"))


def day_type(day: Column | str) -> Column:
    n = F.dayofweek(_c(day))
    return F.when(n == 1, "sunday").when(n == 7, "saturday").otherwise("weekday")


def iso_weekday(day: Column | str) -> Column:
    return F.weekday(_c(day)) + 1


def bucket(x: Column | str, edges: list[float], right_closed: bool = False) -> Column:
    """Number of the interval between neighbouring edges that holds x; null outside. Left-closed unless said."""
    x, out = _c(x), F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges[:-1], edges[1:], strict=True)))):
        inside = (x > lo) & (x <= hi) if right_closed else (x >= lo) & (x < hi)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def d0_bucket(x: Column | str, cfg: Config) -> Column:
    """Name of the delay bucket at prediction time."""
    b = bucket(x, list(cfg.d0_edges))
    names = ["<1", "1-3", "3-10", ">10"]
    return F.get(F.array(*map(F.lit, names)), b)


def hash_bucket(key: Column | str, seed: int, of: int) -> Column:
    """A number below ``of`` from the MD5 of key and seed; other engines can compute the same."""
    text = F.concat(_c(key), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % of


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.when(_c(b) != 0, _c(a) / _c(b))


def pinball(y: Column | str, q: Column | str, alpha: float) -> Column:
    """Quantile loss of a prediction q of y."""
    e = _c(y) - _c(q)
    return F.greatest(F.lit(alpha) * e, F.lit(alpha - 1) * e)


def sorted_three(lo: Column | str, mid: Column | str, hi: Column | str) -> Column:
    """The three values as an ascending array."""
    return F.array_sort(F.array(_c(lo), _c(mid), _c(hi)))


def delay_text(minutes: Column | str) -> Column:
    """A delay as a label: ``on time``, ``+3 min`` or ``-2 min``."""
    m = F.round(_c(minutes)).cast("int")
    return F.when(m == 0, "on time").otherwise(F.concat(F.when(m > 0, "+").otherwise("-"), F.abs(m).cast("string"), F.lit(" min")))


def register_sql(spark, cfg: Config) -> None:
    """The scalar rules as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sw_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN b <> 0 THEN a / b END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sw_pinball(y DOUBLE, q DOUBLE, alpha DOUBLE) RETURNS DOUBLE RETURN greatest(alpha * (y - q), (alpha - 1) * (y - q))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sw_valid_delay(status STRING, d DOUBLE) RETURNS DOUBLE "
        f"RETURN CASE WHEN status = 'REAL' AND d BETWEEN {cfg.delay_min} AND {cfg.delay_max} THEN d END"
    )
