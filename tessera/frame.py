"""Frame, Series, Index and Scalar: pandas-like handles over one Spark plan.

A Frame is a Spark DataFrame with named columns, at most one index column and the columns that order its rows. A Series
is a Column of a Frame; Series of one root (the same rows) combine as Columns, others are joined on their index.
Operators that need neighbours or running values extend their root's plan, so their results stay combinable with it.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import DataFrame as Spark
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import nulls
from tessera.nulls import FLOATING, INTEGRAL, NUMERIC, lit
from tessera.operators import joins, ordered, quantiles, reshape

IDX = "__idx"
_names = itertools.count()


def _fresh(stem: str = "v") -> str:
    return f"__{stem}{next(_names)}"


def _list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple, set, pd.Index)) else [x]


class Scalar:
    """One lazy value."""

    def __init__(self, sdf: Spark) -> None:
        self.sdf = sdf.toDF("value")

    @property
    def column(self) -> Column:
        return self.sdf.scalar()

    @property
    def dtype(self) -> T.DataType:
        return self.sdf.schema[0].dataType

    def compute(self):
        row = self.sdf.first()
        return None if row is None else row[0]

    def to_series(self, index=0) -> Series:
        return Frame(self.sdf.select("value", lit(index).alias(IDX)), ["value"], IDX)["value"]

    to_delayed = persist = lambda self, *a, **k: self

    def __bool__(self) -> bool:
        raise TypeError("the truth of a lazy value isn't known; compute() it")

    def _op(self, other, f) -> Scalar | Series:
        if isinstance(other, Series):
            return NotImplemented
        b = other.column if isinstance(other, Scalar) else lit(other)
        return Scalar(self.sdf.select(f(F.col("value"), b)))

    def __repr__(self) -> str:
        return f"<Scalar: {self.dtype.simpleString()}>"


class _Common:
    """What Frames and Series share."""

    base: Frame

    @property
    def spark(self):
        return self.base.sdf.sparkSession

    @property
    def npartitions(self) -> int:
        return self.base.sdf.rdd.getNumPartitions()

    @property
    def divisions(self) -> tuple:
        return (None,) * (self.npartitions + 1)

    known_divisions = False

    def lengths(self) -> list[int]:
        """Rows of each partition that has any."""
        return [r["count"] for r in self.base.sdf.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()]

    def compute_current_divisions(self, col: str | None = None) -> tuple:
        """The least label of each partition, and the greatest of the last; an eager pass."""
        c = F.col(col or self.base._indexed().index_column)
        rows = self.base._indexed().sdf.groupBy(F.spark_partition_id().alias("p")).agg(F.min(c).alias("a"), F.max(c).alias("b")).orderBy("p").collect()
        if any(x["b"] > y["a"] for x, y in zip(rows, rows[1:], strict=False)):
            raise ValueError("partitions overlap")
        return (*[r["a"] for r in rows], rows[-1]["b"]) if rows else ()

    def pipe(self, func: Callable, *args, **kwargs):
        if isinstance(func, tuple):
            func, target = func
            return func(*args, **{target: self}, **kwargs)
        return func(self, *args, **kwargs)

    def copy(self, deep: bool = False):
        return self

    def optimize(self, fuse: bool = True):
        return self

    simplify = lower_once = to_backend = clear_divisions = enforce_runtime_divisions = lambda self, *a, **k: self

    def explain(self, mode: str = "formatted", **_) -> None:
        self.spark_frame().explain(mode=mode)

    pprint = visualize = explain

    def analyze(self) -> dict:
        """Runs the plan and returns what an observation of its rows saw."""
        from pyspark.sql import Observation

        seen = Observation()
        self.spark_frame().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        return seen.get

    def head(self, n: int = 5, compute: bool = True, npartitions: int = 1):
        out = self._rows(lambda f: f._new(f.sdf.orderBy(*f.order).limit(n) if f.order else f.sdf.limit(n)))
        return out.compute() if compute else out

    def tail(self, n: int = 5, compute: bool = True):
        def last(f: Frame) -> Frame:
            f = f._positioned()
            return f._new(f.sdf.orderBy(*(f.reverse or [F.col(c).desc() for c in f.order])).limit(n))

        out = self._rows(last)
        return out.compute() if compute else out

    def sample(self, n=None, frac: float | None = None, replace: bool = False, random_state: int | None = None):
        if n is not None or frac is None:
            raise NotImplementedError("a fraction is needed")
        return self._rows(lambda f: f._new(f.sdf.sample(replace, frac, random_state)))

    def random_split(self, frac: list[float], random_state: int | None = None, shuffle: bool = False) -> list:
        parts = self.base.sdf.randomSplit(list(frac), random_state)
        return [self._rows(lambda f, p=p: f._new(p)) for p in parts]

    def repartition(self, npartitions: int | None = None, divisions=None, partition_size=None, freq=None, force: bool = False):
        if divisions is not None:
            return self._rows(lambda f: f._new(f.sdf.repartitionByRange(len(divisions) - 1, *f.order)))
        if freq is not None:
            from tessera.functions.datetimes import floor_to

            return self._rows(lambda f: f._new(f.sdf.repartitionByRange(floor_to(F.col(f.index_column), freq))))
        if npartitions is None:
            return self
        return self._rows(lambda f: f._new(f.sdf.coalesce(npartitions) if npartitions < f.npartitions else f.sdf.repartition(npartitions)))

    def get_partition(self, n: int):
        return self._rows(lambda f: f._new(f.sdf.where(F.spark_partition_id() == n)))

    def persist(self, **_):
        return self._rows(lambda f: f._new(f.sdf.persist()))

    def to_delayed(self, **_):
        return self.spark_frame().toLocalIterator(prefetchPartitions=True)

    def loc_rows(self, key):
        return self._rows(lambda f: f._loc(key))

    def sort_index(self, ascending: bool = True, **_):
        return self._rows(lambda f: f._new(f.sdf.orderBy(F.col(f.index_column).asc() if ascending else F.col(f.index_column).desc())))

    def to_timestamp(self, freq: str | None = None, how: str = "start"):
        from tessera.functions.datetimes import period_bounds

        return self._rows(lambda f: f._new(f.sdf.withColumn(f.index_column, period_bounds(F.col(f.index_column), freq or "D")[0 if how == "start" else 1])))


class Frame(_Common):
    def __init__(self, sdf: Spark, columns: list[str] | None = None, index: str | None = None, order: list[str] | None = None, index_name: str | None = None, cats: dict | None = None, root: ordered.Rows | None = None, ext: tuple = (), reverse: list | None = None) -> None:
        put = object.__setattr__
        put(self, "sdf", sdf)
        put(self, "_columns", list(columns if columns is not None else [c for c in sdf.columns if not c.startswith("__")]))
        put(self, "index_column", index)
        put(self, "order", list(order if order is not None else [index] if index else []))
        put(self, "index_name", index_name)
        put(self, "cats", dict(cats or {}))  # column -> (categories, ordered)
        put(self, "root", root or ordered.Rows(sdf))
        put(self, "ext", ext)
        put(self, "reverse", reverse)  # the order backwards, where it isn't plain columns

    # -- plumbing
    @property
    def base(self) -> Frame:
        return self

    def _rows(self, f: Callable[[Frame], Frame]) -> Frame:
        return f(self)

    def _new(self, sdf: Spark, columns: list[str] | None = None, **changes) -> Frame:
        keep = {"index": self.index_column, "order": self.order, "index_name": self.index_name, "cats": self.cats, "reverse": None if "order" in changes else self.reverse} | changes
        columns = self._columns if columns is None else columns
        return Frame(sdf, columns, **keep)

    def _extend(self, f: Callable[[Spark], Spark], columns: list[str] | None = None, key: object = None) -> Frame:
        """The same rows with more columns."""
        key = key or object()
        return Frame(f(self.sdf), columns or self._columns, self.index_column, self.order, self.index_name, self.cats, self.root, (*self.ext, (key, f)))

    def _merged(self, other: Frame) -> Frame | None:
        """This frame with what ``other`` has added to the same rows; None for other rows."""
        if self.root is not other.root:
            return None
        out, have = self, {k for k, _ in self.ext}
        for key, f in other.ext:
            if key not in have:
                out = out._extend(f, key=key)
        return out

    def _positioned(self) -> Frame:
        """With an order: that of the rows as they are read, where there is no other."""
        if self.order:
            return self
        sdf = self.sdf.withColumn("__ord", F.monotonically_increasing_id())
        return Frame(sdf, self._columns, self.index_column, ["__ord"], self.index_name, self.cats)

    def _placed(self) -> Frame:
        """With ``__n``, a number that grows along the rows: the only order column itself, or a running count."""
        f = self._positioned()
        if len(f.order) == 1 and isinstance(f.order[0], str):
            return f._new(f.sdf.withColumn("__n", F.col(f.order[0])))
        return f._new(ordered.running(f.sdf, {"__n": ("rows", F.lit(1))}, f.order))

    def _indexed(self) -> Frame:
        if self.index_column:
            return self
        f = self._positioned()
        g = f._placed()
        return Frame(g.sdf.withColumn(IDX, F.col("__n")), f._columns, IDX, f.order, None, f.cats)

    def _hidden(self) -> list[str]:
        named = [c for c in [*_list(self.index_column), *self.order] if isinstance(c, str)]
        return [c for c in dict.fromkeys([*named, *[c for c in self.sdf.columns if c.startswith("__")]]) if c not in self._columns]

    def spark_frame(self) -> Spark:
        """The plain Spark DataFrame of the columns, after the index where it has a name."""
        named = [F.col(self.index_column).alias(self.index_name)] if self.index_column and self.index_name and self.index_name not in self._columns else []
        return self.sdf.select(*named, *[F.col(f"`{c}`") for c in self._columns])

    def type_of(self, c: str) -> T.DataType:
        return self.sdf.schema[c].dataType

    def compute(self, **_) -> pd.DataFrame:
        sdf = self.sdf.orderBy(*self.order) if self.order else self.sdf
        out = sdf.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*self._columns, *_list(self.index_column)])]).toPandas()
        if self.index_column:
            out = out.set_index(self.index_column, drop=self.index_column not in self._columns)
            out.index.name = self.index_name
        for c, (values, is_ordered) in self.cats.items():
            if c in out and values is not None:
                out[c] = pd.Categorical(out[c], categories=values, ordered=is_ordered)
        return out[self._columns]

    # -- shape and names
    @property
    def columns(self) -> pd.Index:
        return pd.Index(self._columns)

    @columns.setter
    def columns(self, names) -> None:
        renamed = self.set_columns(list(names))
        self.__init__(renamed.sdf, renamed._columns, renamed.index_column, renamed.order, renamed.index_name, renamed.cats)

    def set_columns(self, names: list[str]) -> Frame:
        if len(names) != len(self._columns):
            raise ValueError("length mismatch")
        return self.rename(columns=dict(zip(self._columns, names, strict=True)))

    @property
    def dtypes(self) -> pd.Series:
        return pd.Series({c: self.type_of(c).simpleString() for c in self._columns})

    @property
    def shape(self) -> tuple:
        return Scalar(self.sdf.agg(F.count("*"))), len(self._columns)

    @property
    def size(self) -> Scalar:
        return Scalar(self.sdf.agg(F.count("*") * len(self._columns)))

    ndim = 2

    @property
    def axes(self) -> list:
        return [self.index, self.columns]

    @property
    def empty(self) -> bool:
        return self.sdf.isEmpty()

    @property
    def index(self) -> Index:
        f = self._indexed()
        return Index(f, F.col(f.index_column), f.index_name)

    def __len__(self) -> int:
        return self.sdf.count()

    def __contains__(self, c) -> bool:
        return c in self._columns

    def __iter__(self):
        return iter(self._columns)

    def __dir__(self):
        return [*super().__dir__(), *self._columns]

    def __getattr__(self, name: str):
        if not name.startswith("__") and name in self._columns:
            return self[name]
        raise AttributeError(name)

    def __setattr__(self, name: str, value) -> None:
        if name == "columns":
            object.__setattr__(self, name, value)
        elif name in self._columns:
            self[name] = value
        else:
            object.__setattr__(self, name, value)

    def __getitem__(self, key):
        if isinstance(key, str):
            if key not in self._columns:
                raise KeyError(key)
            return Series(self, F.col(f"`{key}`"), key)
        if isinstance(key, Series):
            return self._filter(key)
        if isinstance(key, Frame):
            return self.where(key)
        if isinstance(key, slice):
            return self._loc(key)
        names = list(key)
        if missing := [c for c in names if c not in self._columns]:
            raise KeyError(missing)
        return Frame(self.sdf, names, self.index_column, self.order, self.index_name, self.cats, self.root, self.ext, self.reverse)

    def __setitem__(self, key, value) -> None:
        if isinstance(key, Frame):
            new = self.mask(key, value)
        else:
            new = self.assign(**{key: value})
        self.__init__(new.sdf, new._columns, new.index_column, new.order, new.index_name, new.cats, new.root, new.ext)

    def __delitem__(self, key) -> None:
        new = self.drop(columns=[key])
        self.__init__(new.sdf, new._columns, new.index_column, new.order, new.index_name, new.cats, new.root, new.ext)

    def _filter(self, mask: Series) -> Frame:
        whole = self._merged(mask.base)
        if whole is not None:
            return Frame(whole.sdf, self._columns, self.index_column, self.order, self.index_name, self.cats)._new(whole.sdf.where(mask.pred if mask.pred is not None else mask.col))
        right = mask.base._indexed()
        true = right.sdf.where(mask.col).select(F.col(right.index_column).alias("__k"))
        left = self._indexed()
        return left._new(left.sdf.join(true, F.col(left.index_column) == F.col("__k"), "left_semi"))

    # -- columns
    def assign(self, **made) -> Frame:
        out = self
        for name, value in made.items():
            value = value(out) if callable(value) and not isinstance(value, Series) else value
            fresh = name not in out._columns
            columns = [*out._columns, name] if fresh else out._columns
            if isinstance(value, Series):
                whole = out._merged(value.base)
                if whole is None:
                    out = out._aligned_assign(name, value)
                    continue
                col = value.col
            else:
                whole, col = out, value.column if isinstance(value, Scalar) else lit(value)
            cats = {k: v for k, v in out.cats.items() if k != name} | ({name: value.cat_info} if isinstance(value, Series) and value.cat_info else {})
            add = lambda df, n=name, c=col: df.withColumn(n, c)
            if fresh:
                out = whole._extend(add, columns)
                object.__setattr__(out, "cats", cats)
            else:
                out = Frame(add(whole.sdf), columns, out.index_column, out.order, out.index_name, cats)
        return out

    def _aligned_assign(self, name: str, value: Series) -> Frame:
        a, b = self._indexed(), value.base._indexed()
        right = b.sdf.select(F.col(b.index_column).alias("__k"), value.col.alias("__new"))
        joined = a.sdf.join(right, F.col(a.index_column) == F.col("__k"), "left").drop("__k")
        columns = self._columns if name in self._columns else [*self._columns, name]
        return a._new(joined.withColumn(name, F.col("__new")).drop("__new"), columns)

    def drop(self, labels=None, axis=1, columns=None, errors: str = "raise") -> Frame:
        if columns is None and axis not in (1, "columns"):
            raise NotImplementedError("only columns can be dropped")
        names = _list(labels if columns is None else columns)
        if errors == "raise" and (missing := [c for c in names if c not in self._columns]):
            raise KeyError(missing)
        return self[[c for c in self._columns if c not in names]]

    def pop(self, item: str) -> Series:
        out = self[item]
        del self[item]
        return out

    def rename(self, index=None, columns=None) -> Frame:
        new = {c: columns(c) if callable(columns) else columns.get(c, c) for c in self._columns}
        changed = {a: b for a, b in new.items() if a != b}
        keep = self._hidden()
        sdf = self.sdf.select(*[F.col(f"`{c}`").alias(new[c]) for c in self._columns], *[F.col(f"`{c}`") for c in keep])
        order = [changed.get(c, c) if isinstance(c, str) else c for c in self.order]
        return Frame(sdf, [new[c] for c in self._columns], changed.get(self.index_column, self.index_column), order, self.index_name, {new.get(k, k): v for k, v in self.cats.items()})

    def rename_axis(self, mapper=None, index=None, columns=None, axis=0) -> Frame:
        f = self._indexed()
        return f._new(f.sdf, index_name=index if index is not None else mapper)

    def add_prefix(self, prefix: str) -> Frame:
        return self.rename(columns=lambda c: prefix + c)

    def add_suffix(self, suffix: str) -> Frame:
        return self.rename(columns=lambda c: c + suffix)

    def select_dtypes(self, include=None, exclude=None) -> Frame:
        groups = {"number": NUMERIC, "integer": INTEGRAL, "floating": FLOATING, "object": (T.StringType,), "string": (T.StringType,), "bool": (T.BooleanType,), "datetime": (T.TimestampType, T.TimestampNTZType)}

        def is_of(c: str, wanted) -> bool:
            return any(isinstance(self.type_of(c), groups[w]) if w in groups else self.type_of(c).simpleString() == w for w in _list(wanted))

        return self[[c for c in self._columns if (include is None or is_of(c, include)) and (exclude is None or not is_of(c, exclude))]]

    def numeric(self) -> list[str]:
        return [c for c in self._columns if isinstance(self.type_of(c), (*NUMERIC, T.BooleanType))]

    def squeeze(self, axis=None):
        return self[self._columns[0]] if len(self._columns) == 1 else self

    def reset_index(self, drop: bool = False) -> Frame:
        """The index becomes a column; the new index numbers rows in their order."""
        f = self._indexed()
        name = f.index_name or "index"
        sdf = f.sdf if drop else f.sdf.withColumn(name, F.col(f.index_column))
        sdf = ordered.running(sdf, {"__n": ("rows", F.lit(1))}, f.order)
        sdf = sdf.withColumn("__n", F.col("__n") - 1)
        keep = [] if drop else [F.col(f"`{name}`")]
        sdf = sdf.select(*keep, *[F.col(f"`{c}`") for c in f._columns if drop or c != name], F.col("__n").alias(IDX))
        return Frame(sdf, sdf.columns[:-1], IDX, cats=self.cats)

    def set_index(self, other, drop: bool = True, sorted: bool = False, sort: bool = True, append: bool = False, npartitions: int | None = None, divisions=None, **_) -> Frame:
        """``other`` orders the rows from here on; physical sorting is left to whoever needs it."""
        if isinstance(other, list) and len(other) > 1 or append:
            raise NotImplementedError("one index column only")
        other = other[0] if isinstance(other, list) else other
        name = other if isinstance(other, str) else other.name
        f = self if isinstance(other, str) else self._merged(other.base)
        col = F.col(f"`{name}`") if isinstance(other, str) else other.col
        columns = [c for c in self._columns if not (drop and c == name)]
        sdf = f.sdf.withColumn(IDX, col)
        order = [IDX, *[c for c in self.order if not isinstance(c, str) or c != IDX and c in sdf.columns]] if sort else self.order or [IDX]
        if divisions is not None:
            sdf = sdf.repartitionByRange(len(divisions) - 1, IDX)
        return Frame(sdf, columns, IDX, order, name, self.cats)

    def explode(self, column) -> Frame:
        names = _list(column)
        f = self._positioned()
        zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in names]) if len(names) > 1 else None
        if zipped is None:
            sdf = f.sdf.withColumn(names[0], F.explode_outer(F.col(f"`{names[0]}`")))
        else:
            sdf = f.sdf.withColumn("__z", F.explode_outer(zipped)).withColumns({c: F.col("__z")[c] for c in names}).drop("__z")
        return f._new(sdf)

    def melt(self, id_vars=None, value_vars=None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return Frame(reshape.melt(self.sdf.select(*self._columns), _list(id_vars), _list(value_vars) or None, var_name, value_name))

    # -- elementwise over all columns
    def _each(self, f: Callable[[Series], Series], columns: list[str] | None = None) -> Frame:
        done = {c: f(self[c]) for c in columns or self._columns}
        whole = self
        for s in done.values():
            whole = whole._merged(s.base)
        sdf = whole.sdf.withColumns({c: s.col for c, s in done.items()})
        return Frame(sdf, self._columns, whole.index_column, whole.order, whole.index_name, self.cats)

    def _with(self, other, f: Callable) -> Frame:
        """Column by column with a scalar, a Series of the same rows or a Frame."""
        if isinstance(other, Frame):
            a, b = self, other
            if a._merged(b) is None:
                a, b = align(a, b)
            names = [c for c in a._columns if c in b._columns]
            lone = [c for c in dict.fromkeys([*a._columns, *b._columns]) if c not in names]
            whole = a._merged(b)
            # columns of one frame are told apart by name only where the roots are one
            sdf = whole.sdf.withColumns({c: f(a[c], b[c]).col for c in names} | {c: F.lit(None) for c in lone})
            return whole._new(sdf, [*names, *lone])
        return self._each(lambda s: f(s, other), self.numeric() if not isinstance(other, Series) else None)

    def isna(self) -> Frame:
        return self._each(lambda s: s.isna())

    isnull = isna

    def notnull(self) -> Frame:
        return self._each(lambda s: s.notnull())

    notna = notnull

    def abs(self) -> Frame:
        return self._each(lambda s: s.abs(), self.numeric())

    __abs__ = abs

    def round(self, decimals: int = 0) -> Frame:
        return self._each(lambda s: s.round(decimals), self.numeric())

    def clip(self, lower=None, upper=None, axis=None) -> Frame:
        return self._each(lambda s: s.clip(lower, upper), self.numeric())

    def astype(self, dtypes) -> Frame:
        chosen = dtypes if isinstance(dtypes, dict) else dict.fromkeys(self._columns, dtypes)
        return self._each(lambda s: s.astype(chosen[s.name]), list(chosen))

    def fillna(self, value) -> Frame:
        chosen = value if isinstance(value, dict) else None

        def fits(c: str) -> bool:
            kind = self.type_of(c)
            return isinstance(kind, (*NUMERIC, T.BooleanType)) if isinstance(value, (int, float)) else isinstance(kind, T.StringType) if isinstance(value, str) else True

        return self._each(lambda s: s.fillna(chosen[s.name] if chosen else value), [c for c in self._columns if (c in chosen if chosen is not None else fits(c))])

    def isin(self, values) -> Frame:
        return self._each(lambda s: s.isin(values[s.name] if isinstance(values, dict) else values))

    def replace(self, to_replace=None, value=None, regex: bool = False) -> Frame:
        return self._each(lambda s: s.replace(to_replace, value, regex))

    def where(self, cond, other=None) -> Frame:
        return self._each(lambda s: s.where(cond[s.name] if isinstance(cond, Frame) else cond, other[s.name] if isinstance(other, Frame) else other))

    def mask(self, cond, other=None) -> Frame:
        return self._each(lambda s: s.mask(cond[s.name] if isinstance(cond, Frame) else cond, other[s.name] if isinstance(other, Frame) else other))

    def map(self, func, na_action=None, meta="double") -> Frame:
        return self._each(lambda s: s.map(func, na_action, meta))

    def dropna(self, how: str = "any", subset=None, thresh: int | None = None) -> Frame:
        return self._new(self.sdf.dropna(how, thresh, _list(subset) or self._columns))

    def query(self, expr: str, local_dict: dict | None = None) -> Frame:
        from tessera.functions.expressions import translate

        return self._new(self.sdf.where(translate(expr, local_dict)))

    def eval(self, expr: str, local_dict: dict | None = None):
        from tessera.functions.expressions import assignments, translate

        made = assignments(expr)
        if not made:
            return Series(self, translate(expr, local_dict), None)
        out = self
        for name, text in made:
            out = out.assign(**{name: Series(out, translate(text, local_dict), name)})
        return out

    def apply(self, func, axis=0, args=(), meta: str = "double", **kwargs) -> Series:
        """``func`` on each row, in pandas batches."""
        if axis not in (1, "columns"):
            raise NotImplementedError("axis=1 only")
        names = list(self._columns)

        @F.pandas_udf(meta)
        def run(rows: pd.DataFrame) -> pd.Series:
            return rows[names].apply(func, axis=1, args=args, **kwargs)

        return Series(self, run(F.struct(*[F.col(f"`{c}`") for c in names])), None)

    def map_partitions(self, func, *args, meta: str, **kwargs) -> Frame:
        names = list(self._columns)

        def run(batches):
            whole = [b for b in batches]
            if whole:
                yield func(pd.concat(whole)[names], *args, **kwargs)

        return Frame(self.sdf.select(*names).mapInPandas(run, meta))

    def map_overlap(self, func, before: int, after: int, *args, meta: str, **kwargs) -> Frame:
        """``func`` on each segment of the order together with its neighbours' nearest rows, which are cut off after."""
        f = self._positioned()
        names = list(self._columns)
        wide = ordered.haloed(f.sdf, f.order, before, after)

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("__pos").reset_index(drop=True)
            return func(part[names], *args, **kwargs)[~part["__halo"].to_numpy()]

        return Frame(wide.groupBy(ordered.SEGMENT).applyInPandas(run, meta))

    # -- rows
    def sort_values(self, by, ascending=True, na_position: str = "last", **_) -> Frame:
        names = _list(by)
        if not all(isinstance(c, str) for c in names):
            raise NotImplementedError("columns must be named by strings")
        ups = ascending if isinstance(ascending, list) else [ascending] * len(names)
        held = {_fresh("k"): c for c in names}
        keys = [getattr(F.col(k), f"{'asc' if up else 'desc'}_nulls_{na_position}")() for k, up in zip(held, ups, strict=True)]
        keys += [c for c in self.order if isinstance(c, str)]
        wide = self.sdf.withColumns({k: F.col(f"`{c}`") for k, c in held.items()})
        other = {"last": "first", "first": "last"}[na_position]
        reverse = [getattr(F.col(k), f"{'desc' if up else 'asc'}_nulls_{other}")() for k, up in zip(held, ups, strict=True)]
        reverse += [F.col(c).desc() for c in self.order if isinstance(c, str)]
        return self._new(wide.orderBy(*keys), order=keys, reverse=reverse)

    def nlargest(self, n: int = 5, columns=None) -> Frame:
        return self._new(self.sdf.orderBy(*[F.col(c).desc_nulls_last() for c in _list(columns)], *self.order).limit(n))

    def nsmallest(self, n: int = 5, columns=None) -> Frame:
        return self._new(self.sdf.orderBy(*[F.col(c).asc_nulls_last() for c in _list(columns)], *self.order).limit(n))

    def drop_duplicates(self, subset=None, keep: str = "first", ignore_index: bool = False) -> Frame:
        if keep not in ("first", "last"):
            raise NotImplementedError("keep first or last")
        names = _list(subset) or self._columns
        if names == self._columns and not self.order:
            return self._new(self.sdf.dropDuplicates(names))
        f = self._positioned()
        # the chosen row's place is a plain minimum, combined before the shuffle
        rest = [c for c in f.sdf.columns if c not in names]
        pick = F.min_by if keep == "first" else F.max_by
        best = f.sdf.groupBy(*names).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*f.order)).alias("__r"))
        return f._new(best.select(*names, *[F.col("__r")[c].alias(c) for c in rest]))

    def shuffle(self, on=None, npartitions: int | None = None, **_) -> Frame:
        keys = [F.col(c) for c in _list(on)] or [F.col(c) for c in self.order]
        return self._new(self.sdf.repartition(npartitions, *keys) if npartitions else self.sdf.repartition(*keys))

    @property
    def loc(self) -> _Loc:
        return _Loc(self)

    @property
    def iloc(self) -> _ILoc:
        return _ILoc(self)

    @property
    def partitions(self):
        outer = self

        class Parts:
            def __getitem__(self, k):
                if isinstance(k, slice):
                    k = list(range(outer.npartitions))[k]
                return outer._new(outer.sdf.where(F.spark_partition_id().isin(_list(k))))

        return Parts()

    def _loc(self, key) -> Frame:
        if callable(key):
            key = key(self)
        if isinstance(key, Series):
            return self._filter(key)
        f = self._indexed()
        c, kind = F.col(f.index_column), f.type_of(f.index_column)

        def of(v, last: bool = False) -> Column:
            if isinstance(v, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                p = pd.Period(v)
                return lit((p.end_time if last else p.start_time).floor("us"))
            return lit(v).cast(kind)

        if isinstance(key, slice):
            test = F.lit(True)
            if key.start is not None:
                test = test & (c >= of(key.start))
            if key.stop is not None:
                test = test & (c <= of(key.stop, True))
            return f._new(f.sdf.where(test))
        if isinstance(key, (list, np.ndarray, pd.Index)):
            return f._new(f.sdf.where(c.isin([lit(v) for v in key])))
        if isinstance(key, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return f._new(f.sdf.where((c >= of(key)) & (c <= of(key, True))))
        return f._new(f.sdf.where(c == of(key)))

    # -- reductions: one row, one column for each column
    def _reduce(self, how: str, columns: list[str] | None = None, **options) -> Reduced:
        f = self
        names = columns if columns is not None else f._columns
        return Reduced(f.sdf.agg(*[nulls.aggregate(how, F.col(f"`{c}`"), **options).alias(c) for c in names]), names)

    def _reduction(self, how: str, axis, numeric_only: bool, **options):
        if axis in (1, "columns"):
            whole = options.pop("skipna", True)
            out = self._across(how, **options)
            complete = F.forall(F.array(*[F.col(c).cast("double") for c in self.numeric()]), lambda x: x.isNotNull())
            return out if whole else Series(self, F.when(complete, out.col), None)
        names = self.numeric() if numeric_only else self._columns
        return self._reduce(how, names, **options)

    def _across(self, how: str, **options) -> Series:
        """The reduction along each row."""
        values = F.filter(F.array(*[F.col(c).cast("double") for c in self.numeric()]), lambda x: x.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        n = F.size(values)
        if how == "sum":
            out = total
        elif how == "prod":
            out = F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
        elif how == "mean":
            out = F.when(n > 0, total / n)
        elif how in ("min", "max"):
            out = getattr(F, f"array_{how}")(values)
        elif how == "count":
            out = n
        elif how in ("var", "std"):
            ddof = options.get("ddof", 1)
            mean = total / n
            out = F.when(n > ddof, F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - ddof))
            out = F.sqrt(out) if how == "std" else out
        elif how == "nunique":
            out = F.size(F.array_distinct(values))
        elif how == "any":
            out = F.exists(values, lambda x: x != 0)
        elif how == "all":
            out = F.forall(values, lambda x: x != 0)
        else:
            raise NotImplementedError(f"{how} along rows")
        return Series(self, out, None)

    def sum(self, axis=0, skipna=True, numeric_only=False, min_count=0, **_):
        return self._reduction("sum", axis, numeric_only, min_count=min_count, skipna=skipna)

    def prod(self, axis=0, skipna=True, numeric_only=False, min_count=0, **_):
        return self._reduction("prod", axis, numeric_only, min_count=min_count, skipna=skipna)

    product = prod

    def nunique(self, axis=0, dropna=True, **_):
        if axis in (1, "columns"):
            return self._across("nunique")
        missing = lambda c: F.lit(0) if dropna else F.max(F.col(c).isNull().cast("int"))
        return Reduced(self.sdf.agg(*[(F.count_distinct(F.col(c)) + missing(c)).alias(c) for c in self._columns]), self._columns)

    def nunique_approx(self, b: int = 16) -> Scalar:
        return Scalar(self.sdf.agg(F.approx_count_distinct(F.struct(*self._columns), max(1.04 / math.sqrt(2**b), 0.0041))))

    def _moment(self, name: str, bias: bool, fisher: bool = True) -> Reduced:
        return Reduced(self.sdf.agg(*[_moment(name, F.col(c), fisher).alias(c) for c in self.numeric()]), self.numeric())

    def skew(self, axis=0, bias=True, nan_policy="propagate", **_):
        return self._moment("skew", bias)

    def kurtosis(self, axis=0, fisher=True, bias=True, nan_policy="propagate", **_):
        return self._moment("kurt", bias, fisher)

    def idxmin(self, axis=0, **_):
        return self._idx("min")

    def idxmax(self, axis=0, **_):
        return self._idx("max")

    def _idx(self, which: str) -> Reduced:
        f = self._indexed()
        return Reduced(f.sdf.agg(*[f[c]._idx_column(which).alias(c) for c in f.numeric()]), f.numeric())

    def cov(self, min_periods=None, **_) -> Frame:
        return self._pairwise(F.covar_samp)

    def corr(self, method="pearson", min_periods=None, **_) -> Frame:
        if method != "pearson":
            raise NotImplementedError("pearson only")
        return self._pairwise(F.corr)

    def _pairwise(self, f) -> Frame:
        names = self.numeric()
        pair = lambda a, b: f(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
        one = self.sdf.agg(*[pair(a, b).alias(f"__{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)])
        rows = F.explode(F.array(*[F.struct(F.lit(i).alias("__p"), F.lit(a).alias(IDX), *[F.col(f"__{i}_{j}").alias(b) for j, b in enumerate(names)]) for i, a in enumerate(names)])).alias("r")
        return Frame(one.select(rows).select("r.*"), names, IDX, ["__p"])

    def quantile(self, q=0.5, axis=0, numeric_only=True, method="default"):
        names = self.numeric()
        if isinstance(q, (list, tuple, np.ndarray)):
            values = quantiles.percentiles(self.sdf, {c: [float(x) for x in q] for c in names})
            zipped = F.arrays_zip(F.array(*[F.lit(float(x)) for x in q]).alias(IDX), *[F.col(c) for c in names])
            return Frame(values.select(F.explode(zipped).alias("r")).select(F.col(f"r.{IDX}").alias(IDX), *[F.col(f"r.{c}").alias(c) for c in names]), names, IDX)
        return self._exact(float(q))

    def _exact(self, q: float) -> Reduced:
        names = self.numeric()
        return Reduced(quantiles.percentiles(self.sdf, {c: [q] for c in names}).select(*[F.col(f"`{c}`")[0].alias(c) for c in names]), names)

    def median(self, axis=0, numeric_only=False, **_) -> Reduced:
        return self._exact(0.5)

    def median_approximate(self, **_) -> Reduced:
        return Reduced(self.sdf.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in self.numeric()]), self.numeric())

    def mode(self, dropna=True, **_) -> Frame:
        """All modal values of each column, in order, one below the other."""
        out = None
        for c in self._columns:
            m = self[c].mode(dropna).base.sdf.select(F.col(c), F.row_number().over(Window.orderBy(F.col(c).asc_nulls_last())).alias("__m"))
            out = m if out is None else out.join(m, "__m", "full")
        return Frame(out.withColumn(IDX, F.col("__m") - 1).drop("__m"), self._columns, IDX)

    def describe(self, percentiles=(0.25, 0.5, 0.75), include=None, **_) -> Frame:
        names = [c for c in self._columns if isinstance(self.type_of(c), NUMERIC)]
        rows = [self[c]._describe_struct(percentiles) for c in names]
        labels = list(dict.fromkeys(k for r in rows for k in r))
        one = self.sdf.agg(*[r[k].cast("double").alias(f"__{i}_{k}") for i, r in enumerate(rows) for k in r if r[k] is not None])
        if percentiles and names:
            percentiles = list(dict.fromkeys(percentiles))
            exact = quantiles.percentiles(self.sdf, {c: [float(p) for p in percentiles] for c in names})
            one = one.crossJoin(F.broadcast(exact.select(*[F.col(f"`{c}`")[j].alias(f"__{i}_{100 * p:g}%") for i, c in enumerate(names) for j, p in enumerate(percentiles)])))  # one row
        value = lambda i, k: F.col(f"`__{i}_{k}`") if k in rows[i] else F.lit(None)
        exploded = F.explode(F.array(*[F.struct(F.lit(p).alias("__p"), F.lit(k).alias(IDX), *[value(i, k).alias(c) for i, c in enumerate(names)]) for p, k in enumerate(labels)])).alias("r")
        return Frame(one.select(exploded).select("r.*"), names, IDX, ["__p"])

    def value_counts(self, **kwargs):
        return Frame(self.sdf.groupBy(*self._columns).count())

    def dot(self, other, meta=None):
        other = other.to_frame() if isinstance(other, Series) else other
        return Frame(self._dot(other))

    def _dot(self, other: Frame) -> Spark:
        """This frame's columns against the other's index: each row's products summed by label."""
        a, b = self._indexed(), other._indexed()
        tall = a.sdf.select(F.col(a.index_column).alias("__i"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in a._columns]), F.array(*[F.col(c).cast("double") for c in a._columns]))).alias("__k", "__v"))
        right = b.sdf.select(F.col(b.index_column).cast("string").alias("__k"), *b._columns)
        return tall.join(right, "__k").groupBy("__i").agg(*[F.sum(F.col("__v") * F.col(c)).alias(c) for c in b._columns]).withColumnRenamed("__i", "index")

    def memory_usage(self, index=True, deep=False) -> Reduced:
        return Reduced(self.sdf.agg(*[self[c]._bytes().alias(c) for c in self._columns]), self._columns)

    @property
    def nbytes(self) -> Scalar:
        total = None
        for c in self._columns:
            total = self[c]._bytes() if total is None else total + self[c]._bytes()
        return Scalar(self.sdf.agg(total))

    def memory_usage_per_partition(self, **_) -> Frame:
        total = sum((self[c]._bytes() for c in self._columns[1:]), self[self._columns[0]]._bytes())
        return Frame(self.sdf.groupBy(F.spark_partition_id().alias("partition")).agg(total.alias("bytes")))

    def info(self, buf=None, **_) -> None:
        print(self.spark_frame()._jdf.schema().treeString(), file=buf)

    def reduction(self, chunk, aggregate=None, combine=None, meta: str = "value double", **_) -> Frame:
        """``chunk`` on each partition, ``combine`` on groups of at most 64 results until one group is left, then ``aggregate``."""
        names = list(self._columns)

        def first(batches):
            for b in batches:
                out = chunk(b[names])
                yield out.to_frame().T if isinstance(out, pd.Series) else out if isinstance(out, pd.DataFrame) else pd.DataFrame([[out]])

        probe = self.sdf.select(*names)
        made = probe.mapInPandas(first, meta)
        final = aggregate or combine

        def last(batches):
            whole = [b for b in batches]
            if whole:
                out = final(pd.concat(whole)) if final else pd.concat(whole)
                yield out.to_frame().T if isinstance(out, pd.Series) else out if isinstance(out, pd.DataFrame) else pd.DataFrame([[out]])

        n = made.rdd.getNumPartitions()
        if combine:
            def middle(batches):
                whole = [b for b in batches]
                if whole:
                    out = combine(pd.concat(whole))
                    yield out.to_frame().T if isinstance(out, pd.Series) else out if isinstance(out, pd.DataFrame) else pd.DataFrame([[out]])

            while n > 64:
                n = math.ceil(n / 64)
                made = made.coalesce(n).mapInPandas(middle, meta)
        return Frame(made.coalesce(1).mapInPandas(last, meta))

    # -- ordered
    def _running(self, kind: str, skipna: bool = True) -> Frame:
        f = self._positioned()
        names = f.numeric()
        new, seen = {c: _fresh() for c in names}, {c: _fresh() for c in names}
        more = {} if skipna else {seen[c]: ("sum", F.col(c).isNull().cast("long")) for c in names}
        g = f._extend(lambda df: ordered.running(df, {new[c]: (kind, F.col(c)) for c in names} | more, f.order, rows=f.root))
        there = lambda c: F.col(c).isNotNull() if skipna else F.col(seen[c]) == 0
        return g._each(lambda s: Series(g, F.when(there(s.name), F.col(new[s.name])), s.name), names)[names]

    def cumsum(self, axis=0, skipna=True, **_):
        return self._running("sum", skipna)

    def cumprod(self, axis=0, skipna=True, **_):
        return self._running("prod", skipna)

    def cummin(self, axis=0, skipna=True, **_):
        return self._running("min", skipna)

    def cummax(self, axis=0, skipna=True, **_):
        return self._running("max", skipna)

    def shift(self, periods: int = 1, freq=None, axis=0) -> Frame:
        if freq is not None:
            f = self._indexed()
            from tessera.functions.datetimes import FIXED, frequency, from_micros, micros

            n, unit = frequency(freq)
            return f._new(f.sdf.withColumn(f.index_column, from_micros(micros(F.col(f.index_column)) + periods * n * FIXED[unit])))
        f = self._positioned()
        return f._each(lambda s: s.shift(periods))

    def diff(self, periods: int = 1, axis=0) -> Frame:
        f = self._positioned()[self.numeric()]
        return f._each(lambda s: s.diff(periods))

    def ffill(self, axis=0, limit=None) -> Frame:
        f = self._positioned()
        return f._new(ordered.filled(f.sdf, f._columns, f.order, True, limit, rows=f.root))

    def bfill(self, axis=0, limit=None) -> Frame:
        f = self._positioned()
        return f._new(ordered.filled(f.sdf, f._columns, f.order, False, limit, rows=f.root))

    def rolling(self, window, min_periods=None, center=False, win_type=None, **_):
        from tessera.operators.windows import Rolling

        return Rolling(self._positioned(), window, min_periods, center)

    def resample(self, rule, closed="left", label="left", on: str | None = None):
        from tessera.operators.windows import Resampler

        return Resampler(self if on is None else self.set_index(on), rule, closed, label)

    def groupby(self, by, group_keys=True, sort=None, observed=None, dropna=True, **_):
        from tessera.operators.groupby import GroupBy

        return GroupBy(self, by, dropna=dropna)

    # -- combining
    def merge(self, right, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, suffixes=("_x", "_y"), indicator=False, broadcast=None, **_) -> Frame:
        return merge(self, right, how, on, left_on, right_on, left_index, right_index, suffixes, indicator, broadcast)

    def join(self, other, on=None, how="left", lsuffix="", rsuffix="", **_) -> Frame:
        out = self
        for o in _list(other):
            o = o.to_frame() if isinstance(o, Series) else o
            out = merge(out, o, how, left_on=on, left_index=on is None, right_index=True, suffixes=(lsuffix, rsuffix))
        return out

    def align(self, other, join: str = "outer", axis=None, fill_value=None):
        return align(self, other, join, fill_value)

    def combine_first(self, other: Frame) -> Frame:
        a, b = align(self, other)
        names = list(dict.fromkeys([*self._columns, *other._columns]))
        whole = a._merged(b)
        cols = {}
        for c in names:
            parts = [x[c].col for x, own in ((a, self), (b, other)) if c in own._columns]
            cols[c] = F.coalesce(*parts)
        return Frame(whole.sdf.select(F.col(whole.index_column), *[v.alias(k) for k, v in cols.items()]), names, whole.index_column, index_name=whole.index_name)

    def combine(self, other: Frame, func, fill_value=None, overwrite=True, meta: str = "double") -> Frame:
        a, b = align(self, other, fill_value=fill_value)
        whole = a._merged(b)
        names = [c for c in self._columns if c in other._columns]

        @F.pandas_udf(meta)
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return func(x, y)

        return Frame(whole.sdf.select(F.col(whole.index_column), *[run(a[c].col, b[c].col).alias(c) for c in names]), names, whole.index_column)

    def pivot_table(self, index, columns, values, aggfunc="mean") -> Frame:
        cats = self.cats.get(columns, (None, False))[0]
        sdf = reshape.pivot_table(self.sdf, index, columns, _list(values), aggfunc, cats)
        return Frame(sdf.withColumnRenamed(index, IDX), [c for c in sdf.columns if c != index], IDX, index_name=index)

    def categorize(self, columns=None, index=None, **_) -> Frame:
        names = _list(columns) or [c for c in self._columns if isinstance(self.type_of(c), T.StringType)]
        found = {c: (reshape.categories_of(self.sdf, c), False) for c in names}
        return Frame(self.sdf, self._columns, self.index_column, self.order, self.index_name, self.cats | found, self.root, self.ext)

    # -- out
    def iterrows(self):
        for row in self.spark_frame().toLocalIterator(prefetchPartitions=True):
            yield None, pd.Series(row.asDict())

    def itertuples(self):
        yield from self.spark_frame().toLocalIterator(prefetchPartitions=True)

    def items(self):
        for c in self._columns:
            yield c, self[c]

    def to_records(self, index=False):
        return self.compute().to_records(index=index)

    def to_bag(self, index=False, format="tuple"):
        return self.spark_frame().rdd.map((lambda r: r.asDict()) if format == "dict" else tuple)

    @property
    def values(self) -> np.ndarray:
        return self.compute().to_numpy()

    def to_array(self, *_a, **_k):
        from tessera.array import Array

        f = self._positioned()
        numbered = ordered.running(f.sdf, {"__r": ("rows", F.lit(1))}, f.order)
        cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in f._columns])).alias("i1", "v")
        return Array(numbered.select((F.col("__r") - 1).alias("i0"), cells), (self.sdf.count(), len(self._columns)))


    def to_parquet(self, path, **kwargs):
        from tessera.sources import io

        return io.to_parquet(self, path, **kwargs)

    def to_csv(self, path, **kwargs):
        from tessera.sources import io

        return io.to_csv(self, path, **kwargs)

    def to_json(self, path, **kwargs):
        from tessera.sources import io

        return io.to_json(self, path, **kwargs)

    def to_orc(self, path, **kwargs):
        from tessera.sources import io

        return io.to_orc(self, path, **kwargs)

    def to_sql(self, name, uri, **kwargs):
        from tessera.sources import io

        return io.to_sql(self, name, uri, **kwargs)

    def to_hdf(self, path, key, **kwargs):
        from tessera.sources import io

        return io.to_hdf(self, path, key, **kwargs)

    def to_string(self, max_rows=5) -> str:
        return self.head(max_rows).to_string()

    def to_html(self, max_rows=5) -> str:
        return self.head(max_rows).to_html()

    def __dataframe__(self, **_):
        return self.spark_frame().toArrow().__dataframe__()

    def __repr__(self) -> str:
        return f"<Frame: {', '.join(f'{c}: {self.type_of(c).simpleString()}' for c in self._columns)}>"


class Reduced(Frame):
    """One row: a reduction of each column. ``compute`` gives a pandas Series labelled by column."""

    def __init__(self, sdf: Spark, columns: list[str], *_, **__) -> None:
        super().__init__(sdf, columns)

    def compute(self, **_) -> pd.Series:
        return self.sdf.select(*[F.col(f"`{c}`") for c in self._columns]).toPandas().iloc[0].rename(None)

    def to_frame(self, name: str = "value") -> Frame:
        return Frame(self.sdf.unpivot([], [F.col(c) for c in self._columns], IDX, name), [name], IDX)

    def __getitem__(self, key):
        return Scalar(self.sdf.select(f"`{key}`")) if isinstance(key, str) else super().__getitem__(key)


class _Loc:
    def __init__(self, obj) -> None:
        self.obj = obj

    def __getitem__(self, key):
        rows, cols = key if isinstance(key, tuple) else (key, None)
        out = self.obj._rows(lambda f: f._loc(rows)) if not (isinstance(rows, slice) and rows == slice(None)) else self.obj
        if cols is None or (isinstance(cols, slice) and cols == slice(None)):
            return out
        if isinstance(cols, slice):
            names = out._columns
            cols = names[names.index(cols.start) if cols.start else 0 : names.index(cols.stop) + 1 if cols.stop else None]
        return out[cols]


class _ILoc:
    def __init__(self, obj: Frame) -> None:
        self.obj = obj

    def __getitem__(self, key):
        if not isinstance(key, tuple) or key[0] != slice(None):
            raise NotImplementedError("positions select columns only: iloc[:, ...]")
        names = np.array(self.obj._columns)[key[1]]
        return self.obj[str(names)] if np.ndim(names) == 0 else self.obj[[str(c) for c in names]]


def _moment(name: str, c: Column, fisher: bool = True) -> Column:
    """Biased moments; of equal values 0 for the skew, and -3 or 0 for the kurtosis."""
    c = c.cast("double")
    if name == "skew":
        return F.coalesce(F.skewness(c), F.lit(0.0))
    return F.coalesce(F.kurtosis(c), F.lit(-3.0)) + (0.0 if fisher else 3.0)


def align(a: Frame, b: Frame, join: str = "outer", fill_value=None) -> tuple[Frame, Frame]:
    """Both frames on the union (or other join) of their index labels: two views of one joined plan."""
    x, y = a._indexed(), b._indexed()
    how = {"outer": "full", "inner": "inner", "left": "left", "right": "right"}[join]
    left = x.sdf.select(F.col(x.index_column).alias("__ka"), *[F.col(f"`{c}`").alias(f"__a_{c}") for c in x._columns])
    right = y.sdf.select(F.col(y.index_column).alias("__kb"), *[F.col(f"`{c}`").alias(f"__b_{c}") for c in y._columns])
    sdf = left.join(right, F.col("__ka") == F.col("__kb"), how).withColumn(IDX, F.coalesce("__ka", "__kb")).drop("__ka", "__kb")
    root = ordered.Rows(sdf)

    def view(f: Frame, side: str) -> Frame:
        out = _View(sdf, f._columns, IDX, [IDX], f.index_name, f.cats, root)
        object.__setattr__(out, "side", side)
        object.__setattr__(out, "fill", fill_value)
        return out

    return view(x, "a"), view(y, "b")


class _View(Frame):
    """One side of two aligned frames, whose columns are prefixed in the joined plan."""

    def __getitem__(self, key):
        if isinstance(key, str):
            c = F.col(f"`__{self.side}_{key}`")
            return Series(Frame(self.sdf, [], IDX, [IDX], self.index_name, root=self.root), c if self.fill is None else F.coalesce(c, lit(self.fill)), key)
        return super().__getitem__(key)

    def compute(self, **_):
        made = Frame(self.sdf.select(F.col(IDX), *[self[c].col.alias(c) for c in self._columns]), self._columns, IDX, index_name=self.index_name)
        return made.compute()


def merge(left: Frame, right, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, suffixes=("_x", "_y"), indicator=False, broadcast=None, **_) -> Frame:
    right = right.to_frame() if isinstance(right, Series) else right
    if on is None and left_on is None and right_on is None and not left_index and not right_index:
        on = [c for c in left._columns if c in right._columns]
        if not on:
            left_index = right_index = True
    lk, rk = _list(on if left_on is None else left_on), _list(on if right_on is None else right_on)
    a, b = left, right
    if left_index:
        a, lk = left._indexed(), [IDX]
    if right_index:
        b, rk = right._indexed(), [IDX]
    sa = a.sdf.select(*[F.col(f"`{c}`") for c in a._columns], *([F.col(a.index_column).alias(IDX)] if left_index else []))
    sb = b.sdf.select(*[F.col(f"`{c}`") for c in b._columns], *([F.col(b.index_column).alias(IDX)] if right_index else []))
    sdf = joins.merge(sa, sb, how, lk, rk, suffixes, indicator, broadcast)
    if left_index and right_index:
        return Frame(sdf, [c for c in sdf.columns if c != IDX], IDX, index_name=a.index_name)
    return Frame(sdf, [c for c in sdf.columns if c != IDX])


def merge_asof(left: Frame, right: Frame, on=None, left_on=None, right_on=None, left_index=False, right_index=False, by=None, left_by=None, right_by=None, suffixes=("_x", "_y"), tolerance=None, allow_exact_matches=True, direction="backward") -> Frame:
    a, b = (left._indexed() if left_index else left), (right._indexed() if right_index else right)
    lo, ro = (IDX if left_index else left_on or on), (IDX if right_index else right_on or on)
    sa = a.sdf.select(*[F.col(f"`{c}`") for c in a._columns], *([F.col(a.index_column).alias(IDX)] if left_index else []))
    sb = b.sdf.select(*[F.col(f"`{c}`") for c in b._columns], *([F.col(b.index_column).alias(IDX)] if right_index else []))
    sdf = joins.as_of(sa, sb, lo, ro, _list(left_by if left_by is not None else by), _list(right_by if right_by is not None else by), direction, tolerance, allow_exact_matches, suffixes)
    columns = [c for c in sdf.columns if not c.startswith(IDX)]
    return Frame(sdf, columns, IDX, index_name=a.index_name) if left_index else Frame(sdf, columns, order=[lo])


def concat(objs: Iterable, axis=0, join="outer", ignore_index=False, **_) -> Frame:
    """Rows frame by frame in their order, or columns side by side on the index."""
    frames = [o.to_frame() if isinstance(o, Series) else o for o in objs]
    if axis in (1, "columns"):
        out = frames[0]
        for f in frames[1:]:
            out = merge(out, f, "outer" if join == "outer" else "inner", left_index=True, right_index=True, suffixes=("", "_1"))
        return out
    placed = []
    for k, f in enumerate(frames):
        f = f._indexed()._placed()
        placed.append(f.sdf.select(*[F.col(f"`{c}`") for c in f._columns], F.col(f.index_column).alias(IDX), F.lit(k).alias("__f"), F.col("__n").alias("__ord")))
    if len({p.schema["__ord"].dataType.simpleString() for p in placed}) > 1:
        placed = [p.withColumn("__ord", F.col("__ord").cast("string")) for p in placed]
    if join == "inner":
        shared = [c for c in placed[0].columns if all(c in p.columns for p in placed)]
        placed = [p.select(*shared) for p in placed]
    sdf = joins.stack(placed)
    return Frame(sdf, [c for c in sdf.columns if not c.startswith("__")], IDX, ["__f", "__ord"], frames[0].index_name)


def _install() -> None:
    """Arithmetic, comparison and reduction methods that are one line for each."""
    for name in ("mean", "min", "max", "count", "any", "all"):
        setattr(Frame, name, lambda self, axis=0, skipna=True, numeric_only=None, how=name, **_: self._reduction(how, axis, numeric_only if numeric_only is not None else how == "mean", skipna=skipna))
    for name in ("var", "std", "sem"):
        setattr(Frame, name, lambda self, axis=0, skipna=True, ddof=1, numeric_only=True, how=name, **_: self._reduction(how, axis, True, ddof=ddof, skipna=skipna))
    ops = {
        "add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": operator.truediv, "floordiv": operator.floordiv, "mod": operator.mod, "pow": operator.pow,
        "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne, "and": operator.and_, "or": operator.or_, "xor": operator.xor,
    }
    for name, f in ops.items():
        setattr(Frame, f"__{name}__", lambda self, other, f=f: self._with(other, f))
        if name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow"):
            setattr(Frame, f"__r{name}__", lambda self, other, f=f: self._with(other, lambda a, b: f(b, a)))
            setattr(Frame, f"r{name}", lambda self, other, axis=None, level=None, fill_value=None, n=f"r{name}": self._with(other, lambda a, b: getattr(a, n)(b, fill_value=fill_value)))
        if name not in ("and", "or", "xor"):
            setattr(Frame, name, lambda self, other, axis=None, level=None, fill_value=None, n=name: self._with(other, lambda a, b: getattr(a, n)(b, fill_value=fill_value)))
    Frame.div = Frame.divide = Frame.truediv
    Frame.rdiv = Frame.rtruediv
    Frame.__neg__ = lambda self: self._each(lambda s: -s, self.numeric())
    Frame.__pos__ = lambda self: self
    Frame.__invert__ = lambda self: self._each(lambda s: ~s)
    Frame.__divmod__ = lambda self, other: (self // other, self % other)
    for name, f in ops.items():
        if name not in ("and", "or", "xor"):
            setattr(Scalar, f"__{name}__", lambda self, other, f=_RAW.get(name, f): self._op(other, f))
    Frame.__hash__ = Series.__hash__ = Scalar.__hash__ = object.__hash__


from tessera.series import Index, Series  # noqa: E402  the two modules need each other

_RAW = {"truediv": nulls.divide, "floordiv": nulls.floordiv, "mod": nulls.mod, "pow": F.pow}
_install()
