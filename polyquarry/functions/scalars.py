"""Casts, rounding, intervals and system functions whose rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of interval units in microseconds; a month is 30 days and a year 365.25. Fixed values.
UNITS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
    "month": 2_592_000_000_000,
    "year": 31_557_600_000_000,
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_int(text) -> Column:
    """Text to BIGINT; decimals are cut off; anything else is null."""
    t = F.trim(_c(text))
    return F.coalesce(F.expr("try_cast(NULL AS BIGINT)"), t.try_cast("bigint"), t.try_cast("double").try_cast("bigint"))


def to_bool(text) -> Column:
    """true, t, yes, y, 1 and false, f, no, n, 0, in any case; else null."""
    t = F.lower(F.trim(_c(text)))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False)


def to_timestamp(text) -> Column:
    """ISO 8601, blanks for T, date only, and dates written day.month.year or month/day/year."""
    t = F.trim(_c(text))
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy"]
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in forms))


def to_path(text) -> Column:
    """A path must begin with a slash."""
    t = _c(text)
    return F.when(t.isNull() | t.startswith("/"), t).otherwise(F.raise_error(F.concat(F.lit("not a path: "), t)))


def interval(amount: float, unit: str) -> Column:
    """A flat duration as a day-time interval."""
    micros = round(amount * UNITS[unit.rstrip("s").lower()])
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(micros) / F.lit(1_000_000)).cast("decimal(18,6)"))


def nullif(a, b) -> Column:
    return F.nullif(_c(a), _c(b))


def round_half_up(x, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(_c(x), digits)


def system(name: str) -> Column:
    """VERSION, CURRENT_SCHEMA, CURRENT_DATABASE, CURRENT_USER, SESSION_USER, CURRENT_CATALOG."""
    return F.expr({"version": "version()", "current_schema": "current_schema()", "current_database": "current_database()", "current_user": "current_user()", "session_user": "session_user()", "current_catalog": "current_catalog()"}[name.lower()])
