"""Reading and writing. Column selection and filters are plain plan nodes, so they reach the files' scan."""

from __future__ import annotations

import glob as _glob
import os
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.frame import IDX, Frame, Series, _list
from tessera.nulls import lit
from tessera.session import active

_OPS = {"==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}


def _finished(sdf, index=None, columns=None) -> Frame:
    if index:
        sdf = sdf.withColumn(IDX, F.col(index))
        names = [c for c in (columns or sdf.columns) if c not in (index, IDX)]
        return Frame(sdf.select(*names, IDX), names, IDX, index_name=index)
    return Frame(sdf.select(*columns) if columns else sdf)


def _test(leaf):
    name, op, value = leaf
    if op in ("in", "not in"):
        found = F.col(name).isin([lit(v) for v in value])
        return found if op == "in" else ~found
    if op in ("is", "is not"):
        return F.col(name).isNull() if op == "is" else F.col(name).isNotNull()
    return _OPS[op](F.col(name), lit(value))


def _dnf(filters):
    """[(column, op, value), ...] is a conjunction; a list of such lists is a disjunction of them."""
    if not filters:
        return None
    groups = [filters] if isinstance(filters[0], tuple) else filters
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_test(x) for x in g]) for g in groups])


def read_parquet(path, columns=None, filters=None, categories=None, index=None, **_) -> Frame | Series:
    sdf = active().read.parquet(*_list(path))
    if (test := _dnf(filters)) is not None:
        sdf = sdf.where(test)
    one = isinstance(columns, str)
    wanted = _list(columns) or None
    out = _finished(sdf, index, [*wanted, *_list(index)] if wanted and index else wanted)
    for c in _list(categories):
        out.cats[c] = (None, False)
    return out[columns] if one else out


def read_csv(path, sep: str = ",", header="infer", usecols=None, dtype=None, schema: str | None = None, names=None, **_) -> Frame:
    reader = active().read.option("sep", sep).option("header", header is not None)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    sdf = reader.csv(_list(path))
    sdf = sdf.toDF(*names) if names else sdf
    out = Frame(sdf.select(*usecols) if usecols else sdf)
    return out.astype(dtype) if dtype else out


def read_table(path, sep: str = "\t", **kwargs) -> Frame:
    return read_csv(path, sep=sep, **kwargs)


def read_fwf(path, colspecs=None, widths=None, names=None, header="infer", dtype=None, **_) -> Frame:
    """Columns by position in the line; the first line names them unless ``names`` does."""
    if colspecs is None:
        ends = np.cumsum(widths).tolist()
        colspecs = list(zip([0, *ends[:-1]], ends, strict=True))
    lines = active().read.text(_list(path))
    cut = [F.trim(F.substring("value", a + 1, b - a)) for a, b in colspecs]
    if names is None:
        first = lines.select(*cut).first()
        names = [x or f"c{k}" for k, x in enumerate(first)]
        lines = lines.where(F.struct(*cut) != F.struct(*[F.lit(x) for x in first]))
    out = Frame(lines.select(*[F.when(c != "", c).alias(n) for c, n in zip(cut, names, strict=True)]))
    return out.astype(dtype) if dtype else out


def read_json(path, orient: str = "records", lines: bool | None = None, include_path_column=False, path_converter: Callable | None = None, schema: str | None = None, encoding: str | None = None, **_) -> Frame:
    reader = active().read.option("multiLine", lines is False)
    reader = reader.schema(schema) if schema else reader
    reader = reader.option("encoding", encoding) if encoding else reader
    sdf = reader.json(_list(path))
    if include_path_column:
        name = "path" if include_path_column is True else include_path_column
        where = F.col("_metadata.file_path")
        sdf = sdf.withColumn(name, F.udf(path_converter)(where) if path_converter else where)
    return Frame(sdf)


def read_orc(path, columns=None, index=None, **_) -> Frame:
    return _finished(active().read.orc(*_list(path)), index, _list(columns) or None)


def read_hdf(pattern, key: str, schema: str, columns=None, **_) -> Frame:
    """HDF5 tables, a file a row of work; the reader library must be installed."""
    files = sorted(f for p in _list(pattern) for f in _glob.glob(p))
    spark = active()

    def run(batches):
        for b in batches:
            for f in b["file"]:
                yield pd.read_hdf(f, key, columns=columns)

    return Frame(spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files) or 1).mapInPandas(run, schema))


def read_sql_table(table: str, con: str, index_col: str, divisions: list | None = None, npartitions: int | None = None, limits: tuple | None = None, columns=None, **properties) -> Frame:
    """A table in partitions of its index column: explicit bounds, or as many equal ranges as asked for."""
    spark, options = active(), {k: str(v) for k, v in properties.items()}
    if divisions is not None:
        pairs = list(zip(divisions[:-1], divisions[1:], strict=True))
        tests = [f"{index_col} >= {a!r} and {index_col} {'<=' if k == len(pairs) - 1 else '<'} {b!r}" for k, (a, b) in enumerate(pairs)]
        sdf = spark.read.jdbc(con, table, predicates=tests, properties=options)
    elif npartitions:
        if limits is None:
            limits = tuple(spark.read.jdbc(con, f"(select min({index_col}) a, max({index_col}) b from {table}) t", properties=options).first())
        sdf = spark.read.jdbc(con, table, column=index_col, lowerBound=limits[0], upperBound=limits[1], numPartitions=npartitions, properties=options)
    else:
        sdf = spark.read.jdbc(con, table, properties=options)
    return _finished(sdf, index_col, [*_list(columns), index_col] if columns else None)


def read_sql_query(sql: str, con: str, index_col: str, **kwargs) -> Frame:
    return read_sql_table(f"({sql}) q", con, index_col, **kwargs)


def read_sql(sql: str, con: str, index_col: str, **kwargs) -> Frame:
    return (read_sql_query if " " in sql.strip() else read_sql_table)(sql, con, index_col, **kwargs)


def from_spark(sdf, index: str | None = None, order: list[str] | None = None) -> Frame:
    out = _finished(sdf, index)
    if order:
        object.__setattr__(out, "order", order)
    return out


def from_pandas(data, npartitions: int | None = None, sort: bool = True, chunksize: int | None = None):
    """Missing values are null; the index becomes the index column and, sorted or not, its order is kept."""
    series = isinstance(data, pd.Series)
    name = data.name if series else None
    pdf = data.to_frame("0" if name is None else name) if series else data.copy(deep=False)
    if sort:
        pdf = pdf.sort_index(kind="stable")
    index_name = pdf.index.name
    cats = {}
    made = {}
    for c in pdf.columns:
        s = pdf[c]
        if isinstance(s.dtype, pd.CategoricalDtype):
            cats[str(c)] = (list(s.cat.categories), bool(s.cat.ordered))
            s = s.astype(object).where(s.notna(), None)
        made[str(c)] = s.to_numpy() if not isinstance(s.dtype, pd.api.extensions.ExtensionDtype) else s
    flat = pd.DataFrame(made)
    labels = pdf.index
    flat[IDX] = labels.to_numpy() if not isinstance(labels, pd.PeriodIndex) else labels.to_timestamp().to_numpy()
    flat["__ord"] = np.arange(len(flat))
    spark = active()
    old = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        import pyarrow as pa

        sdf = spark.createDataFrame(pa.Table.from_pandas(flat, preserve_index=False))
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", old)
    for f in sdf.schema:
        if f.dataType.typeName() == "timestamp":
            sdf = sdf.withColumn(f.name, F.col(f.name).cast("timestamp_ntz"))
        elif f.dataType.typeName() in ("float", "double"):
            sdf = sdf.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    n = npartitions or (max(1, len(flat) // chunksize) if chunksize else None)
    sdf = sdf.repartitionByRange(n, "__ord") if n else sdf
    out = Frame(sdf, [str(c) for c in pdf.columns], IDX, ["__ord"], index_name, cats)
    return Series(out, F.col(f"`{out._columns[0]}`"), name) if series else out


def from_pandas_divisions(data, divisions) -> Frame:
    return from_pandas(data).repartition(divisions=list(divisions))


def from_dict(data: dict, npartitions: int | None = None, orient: str = "columns", dtype=None, columns=None, **_) -> Frame:
    return from_pandas(pd.DataFrame.from_dict(data, orient=orient, dtype=dtype, columns=columns), npartitions)


def from_array(arr, chunksize: int = 50_000, columns=None, **_):
    arr = np.asarray(arr)
    if arr.dtype.names:
        return from_pandas(pd.DataFrame.from_records(arr), chunksize=chunksize)
    if arr.ndim == 1:
        return from_pandas(pd.Series(arr, name=columns), chunksize=chunksize)
    return from_pandas(pd.DataFrame(arr, columns=columns if columns is not None else [str(k) for k in range(arr.shape[1])]), chunksize=chunksize)


def from_chunked_array(x, columns=None, **_) -> Frame:
    """A two-dimensional Array as columns."""
    names = columns or [str(k) for k in range(x.shape[1])]
    sdf = x.sdf.groupBy("i0").agg(*[F.max(F.when(F.col("i1") == k, F.col("v"))).alias(n) for k, n in enumerate(names)])
    return Frame(sdf.withColumnRenamed("i0", IDX), names, IDX)


def from_scalars(scalars: dict) -> Series:
    parts = [s.sdf.select(F.lit(k).alias(IDX), F.lit(i).alias("__ord"), F.col("value")) for i, (k, s) in enumerate(scalars.items())]
    return Frame(reduce(lambda a, b: a.union(b), parts), ["value"], IDX, ["__ord"])["value"]


def from_map(func: Callable, *iterables: Iterable, args: tuple = (), meta: str, **kwargs) -> Frame:
    """``func`` of each element makes the rows of a partition."""
    items = list(zip(*iterables, strict=True))
    spark = active()
    seeds = spark.createDataFrame([(k,) for k in range(len(items))], "k long").repartition(max(1, len(items)), "k")

    def run(batches):
        for b in batches:
            for k in b["k"]:
                yield func(*items[k], *args, **kwargs)

    return Frame(seeds.mapInPandas(run, meta))


def from_delayed(dfs: list[Callable], meta: str, **_) -> Frame:
    """Each callable makes a partition."""
    return from_map(lambda f: f(), dfs if isinstance(dfs, (list, tuple)) else [dfs], meta=meta)


def _out(frame: Frame, write_index: bool):
    f = frame if not write_index else frame._indexed() if frame.index_column else frame
    if write_index and f.index_column:
        return f.sdf.select(F.col(f.index_column).alias(f.index_name or "index"), *[F.col(f"`{c}`") for c in f._columns])
    return f.sdf.select(*[F.col(f"`{c}`") for c in f._columns])


def to_parquet(frame: Frame, path, compression: str = "snappy", write_index: bool = False, append: bool = False, overwrite: bool = False, partition_on=None, **_) -> None:
    writer = _out(frame, write_index).write.mode("append" if append else "overwrite" if overwrite else "errorifexists").option("compression", compression)
    (writer.partitionBy(*_list(partition_on)) if partition_on else writer).parquet(str(path))


def to_csv(frame: Frame, path, single_file: bool = False, header: bool = True, sep: str = ",", index: bool = False, mode: str = "overwrite", compression: str | None = None, **_) -> None:
    sdf = _out(frame, index)
    writer = (sdf.coalesce(1) if single_file else sdf).write.mode(mode).option("header", header).option("sep", sep)
    (writer.option("compression", compression) if compression else writer).csv(str(path))


def to_json(frame: Frame, path, orient: str = "records", lines: bool = True, mode: str = "overwrite", compression: str | None = None, **_) -> None:
    writer = _out(frame, False).write.mode(mode)
    (writer.option("compression", compression) if compression else writer).json(str(path))


def to_orc(frame: Frame, path, write_index: bool = False, mode: str = "overwrite", **_) -> None:
    _out(frame, write_index).write.mode(mode).orc(str(path))


def to_sql(frame: Frame, name: str, uri: str, if_exists: str = "fail", index: bool = True, chunksize: int | None = None, **properties) -> None:
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
    options = {k: str(v) for k, v in properties.items()} | ({"batchsize": str(chunksize)} if chunksize else {})
    _out(frame, index).write.jdbc(uri, name, mode, options)


def to_hdf(frame: Frame, path: str, key: str, **kwargs) -> list[str]:
    """A file for each partition, ``*`` in the path being its number; the folder must be shared."""
    if "*" not in path:
        raise ValueError("the path needs a *")
    names = list(frame._columns)

    def run(batches):
        from pyspark import TaskContext

        whole = [b for b in batches]
        if whole:
            target = path.replace("*", str(TaskContext.get().partitionId()))
            pd.concat(whole)[names].to_hdf(target, key=key, format="table", **kwargs)
            yield pd.DataFrame({"file": [target]})

    return [os.fspath(r[0]) for r in frame.sdf.select(*names).mapInPandas(run, "file string").collect()]


def to_records(frame: Frame):
    return frame.to_records()


def to_bag(frame: Frame, index: bool = False, format: str = "tuple"):
    return frame.to_bag(index, format)
