"""Time-zone expressions on zoneless timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone of the stamp in log-directory names, and the zone archives are filed under.
LOG_ZONE = "America/New_York"
ARCHIVE_ZONE = "America/Los_Angeles"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zoneless timestamp taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), ts)


def from_epoch_ms(ms: Column) -> Column:
    """Zoneless UTC timestamp of epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", ms, F.expr(_EPOCH))


def local_to_utc(local: Column, zone: str) -> Column:
    """UTC time of a wall-clock time. When clocks go back, the second pass of the hour is meant."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    second = first + F.expr("interval 1 hour")
    again = F.convert_timezone(F.lit("UTC"), F.lit(zone), second)
    return F.when(again == local, second).otherwise(first)


def utc_to_local(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def stamp_to_local(stamp: Column) -> Column:
    """Wall-clock time of a ``yyyyMMddHHmm`` stamp; out-of-range parts roll over, as in 13 months."""

    def part(start: int, length: int) -> Column:
        return F.substring(stamp, start, length).try_cast("int")

    year_start = F.make_date(part(1, 4), F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(year_start, part(5, 2) - 1), part(7, 2) - 1)
    minutes = part(9, 2) * 60 + part(11, 2)
    return F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz"))


def _archive_text(ms: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in the archive zone."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return utc_to_local(from_epoch_ms(c), ARCHIVE_ZONE).cast("string")


def archive_day(ms: str | Column) -> Column:
    """``yyyy/MM/dd`` of the archive zone."""
    return F.translate(F.substring(_archive_text(ms), 1, 10), "-", "/")


def archive_path(first_ms: str | Column, last_ms: str | Column, suffix: str = ".tar.xz") -> Column:
    """Day directory and file name (``yyyy_MM_ddTHHmm`` twice) of an archive over the two times."""

    def name(ms: str | Column) -> Column:
        text = _archive_text(ms)
        day = F.translate(F.substring(text, 1, 10), "-", "_")
        return F.concat(day, F.lit("T"), F.substring(text, 12, 2), F.substring(text, 15, 2))

    return F.concat(
        archive_day(first_ms), F.lit("/"), name(first_ms), F.lit("-"), name(last_ms), F.lit(suffix)
    )
