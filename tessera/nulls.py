"""The rules in which results differ from plain SQL: missing values, zero divisors, floored division, rounding."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def lit(value) -> Column:
    """A literal; missing values of any kind are null."""
    if isinstance(value, Column):
        return value
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return F.lit(None)
    if isinstance(value, pd.Timestamp):
        value = value.to_pydatetime()
    if isinstance(value, pd.Timedelta):
        value = value.to_pytimedelta()
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value).cast("timestamp_ntz")
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    return F.lit(value)


def is_missing(c: Column, kind: T.DataType | None = None) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(kind, FLOATING) else c.isNull()


def divide(a: Column, b: Column) -> Column:
    """x / 0 is an infinity of x's sign and 0 / 0 is missing."""
    x, y = a.cast("double"), b.cast("double")
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def mod(a: Column, b: Column) -> Column:
    """With the divisor's sign; missing for a zero divisor. Exact for whole numbers of any size."""
    rest = F.try_mod(a, b)
    return F.when(b != 0, F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest))


def floordiv(a: Column, b: Column) -> Column:
    """Toward minus infinity; missing for a zero divisor. Exact for whole numbers, which a double may not hold."""
    x, y = a.try_cast("long"), b.try_cast("long")
    whole = F.call_function("div", x - mod(x, y), y)
    return F.when(b != 0, F.when((x == a) & (y == b), whole).otherwise(F.floor(F.try_divide(a, b))))


def known(predicate: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(predicate, F.lit(False))


def variance(c: Column, ddof: int = 1) -> Column:
    if ddof == 1:
        return F.when(F.count(c) > 1, F.var_samp(c))
    if ddof == 0:
        return F.var_pop(c)
    n = F.count(c)
    return F.when(n > ddof, F.var_pop(c) * n / (n - ddof))


def aggregate(how: str, c: Column, order: Column | None = None, **options) -> Column:
    """The Column of an aggregate by its pandas name; ``order`` decides first and last. Without ``skipna`` one missing
    value makes the result missing."""
    if not options.pop("skipna", True):
        return F.when(F.count(c) == F.count(F.lit(1)), aggregate(how, c, order, **options))
    q = options.get("q", 0.5)
    at_least = options.get("min_count", 0)
    n = F.count(c)
    if how == "sum":
        total = F.coalesce(F.sum(c), F.lit(0))
        return F.when(n >= at_least, total) if at_least > 0 else total
    if how == "prod":
        total = F.coalesce(F.product(c), F.lit(1.0))
        return F.when(n >= at_least, total) if at_least > 0 else total
    if how == "mean":
        return F.avg(c)
    if how in ("min", "max"):
        return getattr(F, how)(c)
    if how == "count":
        return n
    if how == "size":
        return F.count(F.lit(1))
    if how == "nunique":
        return F.count_distinct(c)
    if how == "var":
        return variance(c, options.get("ddof", 1))
    if how == "std":
        return F.sqrt(variance(c, options.get("ddof", 1)))
    if how == "sem":
        return F.sqrt(variance(c, options.get("ddof", 1)) / n)
    if how == "median":
        return F.median(c)
    if how == "quantile":
        return F.percentile(c, F.lit(float(q)))
    if how == "skew":
        return F.skewness(c)
    if how == "kurt":
        return F.kurtosis(c)
    if how == "first":
        return F.min_by(c, F.when(c.isNotNull(), order)) if order is not None else F.first(c, ignorenulls=True)
    if how == "last":
        return F.max_by(c, F.when(c.isNotNull(), order)) if order is not None else F.last(c, ignorenulls=True)
    if how == "any":
        return F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False))
    if how == "all":
        return F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True))
    if how == "list":
        return F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[1]) if order is not None else F.collect_list(c)
    if how == "unique":
        return F.array_sort(F.collect_set(c))
    raise ValueError(f"unknown aggregate {how!r}")
