"""Functions over Frames and Series that aren't methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.frame import Frame, Series, _list, reshape
from tessera.functions.datetimes import FIXED, java_format


def to_numeric(arg: Series, errors: str = "raise", downcast: str | None = None) -> Series:
    out = arg.to_numeric(errors)
    return out.astype({"integer": "long", "signed": "long", "float": "float"}[downcast]) if downcast else out


def to_datetime(arg: Series, format: str | None = None, unit: str | None = None, errors: str = "raise") -> Series:
    c = arg.col
    if unit:
        step = {"s": 10**6, "ms": 10**3, "us": 1, "D": FIXED["d"]}[unit]
        return arg._new(F.timestamp_micros((c * step).cast("long")).cast("timestamp_ntz"))
    if errors == "coerce":
        parsed = F.try_to_timestamp(c, F.lit(java_format(format))) if format else F.try_to_timestamp(c)
        return arg._new(parsed.cast("timestamp_ntz"))
    return arg._new(F.to_timestamp_ntz(c, F.lit(java_format(format))) if format else c.cast("timestamp_ntz"))


def to_timedelta(arg: Series, unit: str = "ns", errors: str = "raise") -> Series:
    factor = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400, "D": 86400}[unit]
    return arg._new(F.make_dt_interval(secs=(arg.col * factor).cast("decimal(18,6)")))


def isna(arg):
    return arg.isna()


def melt(frame: Frame, id_vars=None, value_vars=None, var_name="variable", value_name="value") -> Frame:
    return frame.melt(id_vars, value_vars, var_name, value_name)


def pivot_table(frame: Frame, index, columns, values, aggfunc="mean") -> Frame:
    return frame.pivot_table(index, columns, values, aggfunc)


def get_dummies(data, prefix=None, prefix_sep="_", dummy_na=False, columns=None, sparse=False, drop_first=False, dtype="boolean") -> Frame:
    """One column for each known category; unknown ones need categorize() first."""
    if sparse:
        raise NotImplementedError("sparse")
    if isinstance(data, Series):
        values = data.cat._need()
        f = data.to_frame("v")
        out = reshape.dummies(f.sdf.select("v", *[c for c in f._hidden()]), {"v": values}, "_", dummy_na, drop_first, dtype)
        named = {f"v_{v}": f"{prefix}{prefix_sep}{v}" if prefix else str(v) for v in values} | {"v_nan": f"{prefix}{prefix_sep}nan" if prefix else "nan"}
        out = out.withColumnsRenamed({k: v for k, v in named.items() if k in out.columns})
        return f._new(out, [c for c in out.columns if not c.startswith("__")], cats={})
    names = _list(columns) or [c for c in data._columns if c in data.cats]
    values = {c: Series(data, F.col(c), c).cat._need() for c in names}
    prefixes = prefix if isinstance(prefix, dict) else dict.fromkeys(names, prefix) if prefix else None
    out = reshape.dummies(data.sdf.select(*data._columns, *data._hidden()), values, prefix_sep, dummy_na, drop_first, dtype, prefixes)
    return data._new(out, [c for c in out.columns if not c.startswith("__")], cats={})


def map_partitions(func, frame, *args, meta: str, **kwargs) -> Frame:
    return frame.map_partitions(func, *args, meta=meta, **kwargs)


def map_overlap(func, frame: Frame, before: int, after: int, *args, meta: str, **kwargs) -> Frame:
    return frame.map_overlap(func, before, after, *args, meta=meta, **kwargs)


def repartition(frame, divisions=None, npartitions=None, **kwargs):
    return frame.repartition(npartitions=npartitions, divisions=divisions, **kwargs)


def elemwise(op, *args, **kwargs):
    """``op`` on Series as it would be on their values: operators and universal functions."""
    return op(*args, **kwargs)


def explain(frame, mode: str = "formatted") -> None:
    frame.explain(mode)


def optimize(frame, fuse: bool = True):
    return frame
