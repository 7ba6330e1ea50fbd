"""Date parsing and time-zone handling as column expressions.

Wall-clock values are TIMESTAMP_NTZ, instants are TIMESTAMP under a UTC session.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.schema import NO_DATE

# Fixed formats of camera metadata: without offset, +0200, +02:00 or Z.
_PLAIN = "yyyy:M:d H:m:s"
_OFFSETS = ("yyyy:M:d H:m:sZ", "yyyy:M:d H:m:sXXX")


def _ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def metadata_wall_time(text: Column) -> Column:
    """Wall-clock time of a metadata date without offset, null when it does not parse."""
    return _ntz(text, _PLAIN)


def log_time(day: Column, time: Column) -> Column:
    """Wall-clock time from the date and time cells of a field log."""
    return _ntz(F.concat_ws(" ", day, time), _PLAIN)


def iso_time(text: Column) -> Column:
    """ISO-8601 text with or without fraction and trailing Z, as wall-clock time; null if malformed."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$"
    return F.when(text.rlike(form), F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz"))


def recorded_text(original: Column, created: Column, modified: Column | None = None) -> Column:
    """The metadata date to use: original, else created, else the fallback when given."""

    def present(text: Column) -> Column:
        return F.when((text != "") & (text != NO_DATE), text)

    choices = [present(original), present(created)]
    return F.coalesce(*choices, *([] if modified is None else [modified]))


# Years for which standard time is known; outside them it is null.
FIRST_YEAR, LAST_YEAR = 1970, 2100


@lru_cache(maxsize=None)
def standard_offsets(zone: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple:
    """Steps (from wall time, seconds) of a zone's offset without daylight saving.

    The tz database is probed day by day on the driver and each change is narrowed to the minute, so
    rows need no Python. Zones have a handful of steps.
    """
    rules = ZoneInfo(zone)

    def offset(at: datetime) -> int:
        at = at.replace(tzinfo=rules)
        return int((at.utcoffset() - at.dst()).total_seconds())

    steps = []
    day, known = datetime(first_year, 1, 1), None
    while day.year <= last_year:
        if (now := offset(day)) != known:
            low, high = day - timedelta(days=1), day
            while known is not None and high - low > timedelta(minutes=1):
                middle = low + (high - low) / 2
                low, high = (low, middle) if offset(middle) != known else (middle, high)
            start = None if known is None else high.replace(second=0, microsecond=0)
            steps.append((start, now))
            known = now
        day += timedelta(days=1)
    return tuple(steps)


def standard_offset(wall: Column, zone: str) -> Column:
    """Seconds east of UTC of the zone's standard time at a wall-clock time; null outside the known years."""
    steps = standard_offsets(zone)
    value = F.lit(steps[0][1])
    for start, seconds in steps[1:]:
        value = F.when(wall >= F.lit(start.isoformat()).cast("timestamp_ntz"), seconds).otherwise(value)
    return F.when(F.year(wall).between(FIRST_YEAR, LAST_YEAR), value)


def _seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def shift(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("bigint"), moment)


def recorded_at(text: Column, zone: str, *, ignore_dst: bool = False) -> dict[str, Column]:
    """Instant, wall-clock time and UTC offset of a metadata date.

    Dates with an offset keep it. Others are taken in ``zone``, by its rules or, with ``ignore_dst``,
    always in its standard time. All three are null when the text does not parse.
    """
    plain = metadata_wall_time(text)
    instant_given = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in _OFFSETS])
    given = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 1)
    given_seconds = F.coalesce(
        (
            F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", 1).try_cast("int") * 3600
            + F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", 2).try_cast("int") * 60
        )
        * F.when(given == "-", -1).otherwise(1),
        F.lit(0),
    )
    if ignore_dst:
        offset = standard_offset(plain, zone)
        instant = shift(plain, -offset).cast("timestamp")
    else:
        instant = F.to_utc_timestamp(plain.cast("timestamp"), zone)
        offset = _seconds_between(plain, instant.cast("timestamp_ntz"))
    return {
        "instant": F.coalesce(instant, instant_given),
        "wall": F.coalesce(plain, shift(instant_given.cast("timestamp_ntz"), given_seconds)),
        "offset_seconds": F.when(plain.isNotNull(), offset)
        .when(instant_given.isNotNull(), given_seconds)
        .cast("bigint"),
    }


def offset_text(seconds: Column) -> Column:
    """Offset as ``+0100``."""
    size = F.abs(seconds)
    sign = F.when(seconds < 0, "-").otherwise("+")
    return F.concat(
        sign, F.format_string("%02d%02d", F.floor(size / 3600), F.floor(F.pmod(size, F.lit(3600)) / 60))
    )


def stamp_text(moment: Column, offset_seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS+ZZZZ``."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), offset_text(offset_seconds))
