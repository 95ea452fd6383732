"""Time columns. Zone-less timestamps are read as UTC, whatever the session zone is."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from .money import as_column

DAY_MICROS = 86_400_000_000


def _is_zoneless(type_name: str) -> bool:
    return type_name == "timestamp_ntz"


def instant_micros(column, type_name: str = "timestamp") -> Column:
    """Microseconds since 1970 UTC of a ``timestamp`` or ``timestamp_ntz`` column."""
    column = as_column(column)
    if _is_zoneless(type_name):
        column = F.convert_timezone(F.lit("UTC"), F.current_timezone(), column)
    return F.unix_micros(column.cast("timestamp"))


def literal_micros(moment: dt.datetime) -> int:
    """The same count for a Python datetime; a naive one is read as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (moment - epoch) // dt.timedelta(microseconds=1)


def moment(value: dt.datetime, type_name: str = "timestamp") -> Column:
    """A Python datetime (naive: UTC) as a constant of a column's type.

    Comparing the bare column with it is a filter that reaches the scan.
    """
    if _is_zoneless(type_name):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(literal_micros(value)))


def whole_days_between(earlier, now: dt.datetime, type_name: str = "timestamp") -> Column:
    """Whole 24-hour days from ``earlier`` to ``now``, rounded down."""
    return F.floor((F.lit(literal_micros(now)) - instant_micros(earlier, type_name)) / DAY_MICROS)


def target_arrival(as_of, zone: str = "Europe/London", at: dt.time = dt.time(9)) -> Column:
    """UTC wall time (``timestamp_ntz``) at which the next working day's commute must end.

    The next day in ``zone`` after ``as_of`` (UTC wall time), moved past Saturday and
    Sunday, at the local time ``at``. ``at`` carries no zone of its own: the zone is an
    argument, so a time without one cannot occur.
    """
    local_now = F.convert_timezone(F.lit("UTC"), F.lit(zone), as_column(as_of).cast("timestamp_ntz"))
    tomorrow = F.date_add(F.to_date(local_now), 1)
    # weekday(): Monday is 0, so Saturday moves two days on and Sunday one.
    working_day = F.date_add(tomorrow, F.greatest(F.lit(0), F.when(F.weekday(tomorrow) > 4, 7 - F.weekday(tomorrow)).otherwise(0)))
    local = F.concat_ws(" ", working_day.cast("string"), F.lit(at.isoformat(timespec="microseconds")))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))
