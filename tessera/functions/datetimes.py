"""``Series.dt``: date and time members as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPRESSED = {}

#: Micros of the fixed frequencies, and the calendar ones by the unit that truncates to them.
FIXED = {"us": 1, "ms": 10**3, "s": 10**6, "min": 60 * 10**6, "t": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6}
CALENDAR = {"w": "week", "ms": "month", "me": "month", "m": "month", "qs": "quarter", "qe": "quarter", "q": "quarter", "ys": "year", "ye": "year", "y": "year", "a": "year"}
#: Format directives.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD"}


def frequency(rule: str) -> tuple[int, str]:
    """(count, unit) of a rule like ``15min``, ``2h``, ``D`` or ``MS``."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", rule)
    if not m:
        raise ValueError(f"unknown frequency {rule!r}")
    unit = m[2] if m[2] in ("MS", "ms") else m[2].lower()
    if unit == "MS":
        unit = "month"
    unit = {"minute": "min", "hour": "h", "day": "d", "second": "s"}.get(unit, unit)
    if unit not in FIXED and unit != "month" and unit not in CALENDAR:
        raise ValueError(f"unknown frequency {rule!r}")
    return int(m[1] or 1), unit


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")


def floor_to(c: Column, rule: str) -> Column:
    n, unit = frequency(rule)
    if unit in FIXED:
        step = n * FIXED[unit]
        return from_micros(F.floor(micros(c) / step) * step)
    if n != 1:
        raise NotImplementedError("only single calendar units")
    return F.date_trunc(CALENDAR.get(unit, unit), c).cast("timestamp_ntz")


def ceil_to(c: Column, rule: str) -> Column:
    n, unit = frequency(rule)
    if unit not in FIXED:
        raise NotImplementedError("only fixed frequencies")
    step = n * FIXED[unit]
    return from_micros(F.ceil(micros(c) / step) * step)


def round_to(c: Column, rule: str) -> Column:
    """Halves go to the even multiple."""
    n, unit = frequency(rule)
    step = n * FIXED[unit]
    return from_micros(F.bround(micros(c).cast("decimal(38,10)") / step, 0).cast("long") * step)


def java_format(fmt: str) -> str:
    out = re.sub(r"(%.)|([A-Za-z]+)", lambda m: DIRECTIVES[m[1]] if m[1] else f"'{m[2]}'", fmt)
    return out


_SIMPLE = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofweek": F.weekday, "day_of_week": F.weekday, "weekday": F.weekday, "dayofyear": F.dayofyear, "day_of_year": F.dayofyear,
    "week": F.weekofyear, "weekofyear": F.weekofyear, "qyear": F.year, "date": F.to_date,
    "days_in_month": lambda c: F.dayofmonth(F.last_day(c)), "daysinmonth": lambda c: F.dayofmonth(F.last_day(c)),
    "microsecond": lambda c: F.pmod(micros(c), F.lit(10**6)).cast("int"), "nanosecond": lambda c: F.when(c.isNotNull(), F.lit(0)),
    "is_leap_year": lambda c: ((F.year(c) % 4 == 0) & (F.year(c) % 100 != 0)) | (F.year(c) % 400 == 0),
    "is_month_start": lambda c: F.dayofmonth(c) == 1, "is_month_end": lambda c: F.to_date(c) == F.last_day(c),
    "is_quarter_start": lambda c: (F.dayofmonth(c) == 1) & (F.month(c) % 3 == 1),
    "is_quarter_end": lambda c: (F.to_date(c) == F.last_day(c)) & (F.month(c) % 3 == 0),
    "is_year_start": lambda c: F.dayofyear(c) == 1, "is_year_end": lambda c: (F.month(c) == 12) & (F.dayofmonth(c) == 31),
    "time": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"), "timetz": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"),
}
PROPERTIES = dict(_SIMPLE)

#: Parts of intervals; days are floored, the rest is not negative.
_DAY = 86400 * 10**6


def interval_micros(c: Column) -> Column:
    return (F.extract(F.lit("DAY"), c).cast("long") * 24 + F.extract(F.lit("HOUR"), c)) * FIXED["h"] + F.extract(F.lit("MINUTE"), c).cast("long") * FIXED["min"] + (F.extract(F.lit("SECOND"), c) * 10**6).cast("long")


PROPERTIES |= {
    "days": lambda c: F.floor(interval_micros(c) / _DAY).cast("long"),
    "seconds": lambda c: F.floor(F.pmod(interval_micros(c), F.lit(_DAY)) / 10**6).cast("long"),
    "microseconds": lambda c: F.pmod(interval_micros(c), F.lit(10**6)).cast("long"),
    "nanoseconds": lambda c: F.when(c.isNotNull(), F.lit(0)),
}
METHODS = {
    "floor": floor_to, "ceil": ceil_to, "round": round_to,
    "day_name": lambda c: F.date_format(c, "EEEE"), "month_name": lambda c: F.date_format(c, "MMMM"),
    "normalize": lambda c: F.date_trunc("day", c).cast("timestamp_ntz"), "strftime": lambda c, fmt: F.date_format(c, java_format(fmt)),
    "total_seconds": lambda c: interval_micros(c) / 10**6,
    "to_period": lambda c, freq="D": floor_to(c, freq), "to_timestamp": lambda c, freq=None, how="start": c,
    "tz_localize": lambda c, tz=None: F.to_utc_timestamp(c, tz) if tz else c.cast("timestamp_ntz"),
    "tz_convert": lambda c, tz=None: F.from_utc_timestamp(c, tz) if tz else c.cast("timestamp_ntz"),
}
#: Members that give several columns.
FRAMES = {
    "isocalendar": {"year": lambda c: F.extract(F.lit("YEAROFWEEK"), c).cast("int"), "week": F.weekofyear, "day": lambda c: F.weekday(c) + 1},
    "components": {
        "days": PROPERTIES["days"], "hours": lambda c: F.floor(F.pmod(interval_micros(c), F.lit(_DAY)) / FIXED["h"]).cast("long"),
        "minutes": lambda c: F.floor(F.pmod(interval_micros(c), F.lit(FIXED["h"])) / FIXED["min"]).cast("long"),
        "seconds": lambda c: F.floor(F.pmod(interval_micros(c), F.lit(FIXED["min"])) / 10**6).cast("long"),
        "milliseconds": lambda c: F.floor(F.pmod(interval_micros(c), F.lit(10**6)) / 1000).cast("long"),
        "microseconds": lambda c: F.pmod(interval_micros(c), F.lit(1000)).cast("long"), "nanoseconds": lambda c: F.when(c.isNotNull(), F.lit(0)).cast("long"),
    },
}


def period_bounds(c: Column, freq: str) -> tuple[Column, Column]:
    """The first and last microsecond of the period that holds c."""
    start = floor_to(c, freq)
    n, unit = frequency(freq)
    after = from_micros(micros(start) + n * FIXED[unit]) if unit in FIXED else F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[CALENDAR.get(unit, unit)]).cast("timestamp_ntz") if CALENDAR.get(unit, unit) != "week" else from_micros(micros(start) + 7 * _DAY)
    return start, from_micros(micros(after) - 1)
