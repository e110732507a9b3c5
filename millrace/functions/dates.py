"""Date and time functions over timestamp Columns (no time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less time."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def truncate(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def floor_to(ts: Column, width_us: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(width_us)))


def ceil_to(ts: Column, width_us: int) -> Column:
    us = micros(ts)
    return from_micros(us + F.pmod(-us, F.lit(width_us)))


def round_to(ts: Column, width_us: int) -> Column:
    return floor_to(from_micros(micros(ts) + width_us // 2), width_us)


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def iso_day(ts: Column) -> Column:
    """Monday is 1."""
    return F.weekday(ts) + 1


def iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts)


def century(ts: Column) -> Column:
    return F.ceil(F.year(ts) / 100)


def millennium(ts: Column) -> Column:
    return F.ceil(F.year(ts) / 1000)


def decade(ts: Column) -> Column:
    return F.floor(F.year(ts) / 10)


def days_in_month(ts: Column) -> Column:
    return F.day(F.last_day(ts))


def is_leap_year(ts: Column) -> Column:
    y = F.year(ts)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_year(ts: Column) -> Column:
    return F.when(is_leap_year(ts), 366).otherwise(365)


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def quarter_start(ts: Column) -> Column:
    return F.trunc(ts, "quarter")


def quarter_end(ts: Column) -> Column:
    return F.date_sub(F.add_months(quarter_start(ts), 3), 1)


def year_start(ts: Column) -> Column:
    return F.trunc(ts, "year")


def year_end(ts: Column) -> Column:
    return F.make_date(F.year(ts), F.lit(12), F.lit(31))


def week_of_month(ts: Column) -> Column:
    """Weeks begin on Monday."""
    return F.ceil((F.day(ts) + F.weekday(month_start(ts))) / 7)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def units_between(a: Column, b: Column, unit: str) -> Column:
    """Whole units from a to b, toward zero."""
    d = micros(b) - micros(a)
    return F.when(d >= 0, F.floor(d / _US[unit])).otherwise(F.ceil(d / _US[unit])).cast("long")


def offset_months(ts: Column, months: int) -> Column:
    """The day is kept or is the month's last; the time stays."""
    return (ts + F.make_ym_interval(F.lit(0), F.lit(months))).cast("timestamp_ntz")


def offset(ts: Column, unit: str, n: int) -> Column:
    return from_micros(micros(ts) + n * _US[unit])


def time_of_day_us(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(_US["day"]))


def is_between_time(ts: Column, start: str, end: str) -> Column:
    """Inclusive clock times HH:MM; a start after the end wraps at midnight."""
    at = lambda s: (int(s[:2]) * 60 + int(s[3:5])) * 60_000_000
    t = time_of_day_us(ts)
    return t.between(at(start), at(end)) if at(start) <= at(end) else (t >= at(start)) | (t <= at(end))


def partition_years(ts: Column) -> Column:
    return F.year(ts) - 1970


def partition_months(ts: Column) -> Column:
    return (F.year(ts) - 1970) * 12 + F.month(ts) - 1


def partition_days(ts: Column) -> Column:
    return F.floor(micros(ts) / _US["day"]).cast("int")


def partition_hours(ts: Column) -> Column:
    return F.floor(micros(ts) / _US["hour"]).cast("int")


#: Strftime letters and the date patterns that they stand for.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh"}


def pattern_of(strftime: str) -> str:
    out, text, i = [], "", 0

    def flush():
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(c.isalpha() for c in text) else text.replace("'", "''"))
            text = ""

    while i < len(strftime):
        if strftime[i] == "%" and i + 1 < len(strftime):
            if strftime[i + 1] == "%":
                text += "%"
            else:
                flush()
                out.append(_LETTERS[strftime[i + 1]])
            i += 2
        else:
            text += strftime[i]
            i += 1
    flush()
    return "".join(out)


def strftime(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, pattern_of(fmt))


def to_datetime(c: Column, fmt: str) -> Column:
    """Null where the text doesn't fit."""
    return F.try_to_timestamp(c, F.lit(pattern_of(fmt))).cast("timestamp_ntz")
