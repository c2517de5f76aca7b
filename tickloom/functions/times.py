"""Time expressions."""

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def hour_bucket(column: str | Column) -> Column:
    """Start of the UTC hour, whatever the session's zone."""
    return F.timestamp_micros(block_of(column, "1 hour"))


def utc_date(column: str | Column) -> Column:
    """The UTC date, whatever the session's zone."""
    days = block_of(column, "1 day") / F.lit(micros_of("1 day"))
    return F.date_from_unix_date(days.cast("int"))


def local_time(column: str | Column, zone: str) -> Column:
    """Wall-clock time in ``zone``, as a zoneless timestamp.

    Goes through the UTC wall clock, counted from the epoch, so the session's
    zone and its clock changes have no part in it.
    """
    seconds = F.unix_micros(_column(column)).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def instant(moment: datetime | date) -> Column:
    """A UTC time as a literal that does not pass through the process's zone.

    A time without a zone, or a date, is taken as UTC.
    """
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(since // timedelta(microseconds=1)).cast("bigint"))


def micros_of(interval: str) -> int:
    """Microseconds of an interval such as ``'90 seconds'`` or ``'2 days'``."""
    # Microseconds per unit.
    units = {
        "microsecond": 1,
        "millisecond": 1_000,
        "second": 1_000_000,
        "minute": 60_000_000,
        "hour": 3_600_000_000,
        "day": 86_400_000_000,
        "week": 604_800_000_000,
    }
    amount, unit = interval.split()
    return int(amount) * units[unit.lower().rstrip("s")]


def block_of(column: str | Column, block: str) -> Column:
    """Start, in epoch microseconds, of the ``block``-long stretch around a time."""
    at = F.unix_micros(_column(column))
    return at - F.pmod(at, F.lit(micros_of(block)))
