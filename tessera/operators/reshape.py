"""Pivots, melts, one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.nulls import aggregate


def categories_of(df: DataFrame, column: str) -> list:
    """The distinct values in order: an eager pass, as the result's columns depend on them."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def pivot_table(df: DataFrame, index: str, columns: str, values: list[str], aggfunc: str = "mean", categories: list | None = None) -> DataFrame:
    if aggfunc not in ("mean", "sum", "count", "first", "last"):
        raise NotImplementedError(f"aggfunc {aggfunc!r}")
    categories = categories_of(df, columns) if categories is None else categories
    grouped = df.where(F.col(index).isNotNull()).groupBy(index)
    made = []
    for v in values:
        for k in categories:
            c = F.when(F.col(columns) == F.lit(k), F.col(v))
            cell = F.when(F.count(c) > 0, aggregate("sum", c)) if aggfunc == "sum" else aggregate(aggfunc, c)
            made.append(cell.alias(f"{v}_{k}" if len(values) > 1 else str(k)))
    return grouped.agg(*made)


def melt(df: DataFrame, id_vars: list[str], value_vars: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    value_vars = value_vars or [c for c in df.columns if c not in id_vars]
    return df.unpivot([F.col(c) for c in id_vars], [F.col(c) for c in value_vars], var_name, value_name)


def dummies(df: DataFrame, categories: dict[str, list], prefix_sep: str = "_", dummy_na: bool = False, drop_first: bool = False, dtype: str = "boolean", prefix: dict[str, str] | None = None) -> DataFrame:
    out: list[Column] = [F.col(c) for c in df.columns if c not in categories]
    for c, values in categories.items():
        name = (prefix or {}).get(c, c)
        for v in values[1:] if drop_first else values:
            out.append(F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast(dtype).alias(f"{name}{prefix_sep}{v}"))
        if dummy_na:
            out.append(F.col(c).isNull().cast(dtype).alias(f"{name}{prefix_sep}nan"))
    return df.select(*out)
