"""A dataframe analytics engine with pandas-like results, built on Spark DataFrames and Columns.

Names load on first use, so that workers which need one module import only that.
"""

from __future__ import annotations

import importlib

_WHERE = {
    "tessera.frame": "Frame Series Index Scalar align concat merge merge_asof",
    "tessera.operators.groupby": "GroupBy Aggregation",
    "tessera.operators.windows": "Rolling Resampler",
    "tessera.sources.io": "read_parquet read_csv read_table read_fwf read_json read_orc read_sql read_sql_table read_sql_query read_hdf from_pandas from_dict from_array from_map from_delayed from_spark "
    "from_pandas_divisions from_scalars to_parquet to_csv to_json to_orc to_sql to_hdf to_records to_bag",
    "tessera.sources.datasets": "timeseries",
    "tessera.top": "to_numeric to_datetime to_timedelta isna melt pivot_table get_dummies map_partitions map_overlap repartition elemwise explain optimize",
    "tessera.array": "Array",
}
_HOME = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(importlib.import_module(_HOME[name]), name)
    raise AttributeError(name)
