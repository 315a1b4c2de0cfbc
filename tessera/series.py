"""Series and Index: one Column of a Frame."""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import nulls
from tessera.frame import IDX, Frame, Scalar, _Common, _fresh, _list, _moment, align
from tessera.nulls import FLOATING, NUMERIC, is_missing, known, lit
from tessera.operators import ordered, quantiles, reshape


class Series(_Common):
    def __init__(self, base: Frame, col: Column, name: str | None = None, pred: Column | None = None, cat_info: tuple | None = None) -> None:
        self.base, self.col, self.name, self.pred = base, col, name, pred
        self.cat_info = base.cats.get(name) if cat_info is None else cat_info or None  # () for none

    # -- plumbing
    def _new(self, col: Column, pred: Column | None = None, **changes) -> Series:
        return type(self)(self.base, col, changes.get("name", self.name), pred, changes.get("cat_info", ()))

    def _named(self) -> str:
        return "__value" if self.name is None else self.name

    def to_frame(self, name: str | None = None) -> Frame:
        name = name or ("0" if self.name is None else self.name)
        b = self.base
        keep = [F.col(f"`{c}`") for c in dict.fromkeys([*b._hidden(), *_list(b.index_column), *[c for c in b.order if isinstance(c, str)]]) if c != name]
        return Frame(b.sdf.select(self.col.alias(name), *keep), [name], b.index_column, b.order, b.index_name, {name: self.cat_info} if self.cat_info else None)

    def _rows(self, f: Callable[[Frame], Frame]) -> Series:
        out = f(self.to_frame())
        return out[out._columns[0]]

    def spark_frame(self):
        return self.to_frame().spark_frame()

    @property
    def dtype(self) -> T.DataType:
        return self.base.sdf.select(self.col).schema[0].dataType

    dtypes = dtype

    def compute(self, **_) -> pd.Series:
        return self.to_frame().compute().iloc[:, 0].rename(self.name)

    @property
    def values(self):
        return self.compute().to_numpy()

    @property
    def index(self) -> Index:
        return self.to_frame().index

    @property
    def shape(self) -> tuple:
        return (self.size,)

    @property
    def size(self) -> Scalar:
        return Scalar(self.base.sdf.agg(F.count("*")))

    ndim = 1

    @property
    def axes(self) -> list:
        return [self.index]

    def __len__(self) -> int:
        return self.base.sdf.count()

    def squeeze(self):
        return self

    def rename(self, index=None, sorted_index: bool = False) -> Series:
        if callable(index) or isinstance(index, dict):
            f = self.to_frame()._indexed()
            c = F.col(f.index_column)
            moved = Series(f, c).map(index).col
            return f._new(f.sdf.withColumn(f.index_column, F.coalesce(moved, c) if isinstance(index, dict) else moved))[f._columns[0]]
        return self._new(self.col, self.pred, name=index, cat_info=self.cat_info or ())

    def rename_axis(self, mapper=None, **kw) -> Series:
        return self._rows(lambda f: f.rename_axis(mapper, **kw))

    def add_prefix(self, prefix: str) -> Series:
        return self._rows(lambda f: (g := f._indexed())._new(g.sdf.withColumn(g.index_column, F.concat(lit(prefix), F.col(g.index_column).cast("string")))))

    def add_suffix(self, suffix: str) -> Series:
        return self._rows(lambda f: (g := f._indexed())._new(g.sdf.withColumn(g.index_column, F.concat(F.col(g.index_column).cast("string"), lit(suffix)))))

    def reset_index(self, drop: bool = False, name: str | None = None):
        out = self.to_frame(name).reset_index(drop)
        return out[out._columns[-1]] if drop else out

    def __getitem__(self, key):
        if isinstance(key, Series):
            whole = self.base._merged(key.base)
            if whole is not None:
                return Series(Frame(whole.sdf.where(key.pred if key.pred is not None else key.col), whole._columns, whole.index_column, whole.order, whole.index_name, whole.cats), self.col, self.name)
            return self._rows(lambda f: f._filter(key))
        return self._rows(lambda f: f._loc(key))

    @property
    def loc(self):
        from tessera.frame import _Loc

        return _Loc(self)

    # -- with others
    def _with(self, other, f: Callable[[Column, Column], Column], truth: bool = False) -> Series:
        if isinstance(other, Frame):
            return other._each(lambda s: self._with(s, f))
        if isinstance(other, Series):
            whole = self.base._merged(other.base)
            if whole is None:
                a, b = align(self.to_frame("l"), other.to_frame("r"))
                return Series(a["l"].base, a["l"].col, self.name)._with(Series(a["l"].base, b["r"].col), f, truth)
            name = self.name if self.name == other.name else None
            col = f(self.col, other.col)
            return Series(whole, known(col) if truth else col, name, col if truth else None, ())
        col = f(self.col, other.column if isinstance(other, Scalar) else lit(other))
        return Series(self.base, known(col) if truth else col, self.name, col if truth else None, ())

    def _filled(self, other, f: Callable, fill_value) -> Series:
        if fill_value is None:
            return self._with(other, f)

        def both(a: Column, b: Column) -> Column:
            v = lit(fill_value)
            return F.when(a.isNotNull() | b.isNotNull(), f(F.coalesce(a, v), F.coalesce(b, v)))

        return self._with(other, both)

    def _logic(self, other, f: Callable) -> Series:
        out = self._with(other, f)
        if isinstance(other, Series) and self.pred is not None and other.pred is not None and f in (operator.and_, operator.or_):
            out.pred = f(self.pred, other.pred)
        return out

    def _is_boolean(self) -> bool:
        return isinstance(self.dtype, T.BooleanType)

    def __and__(self, other):
        return self._logic(other, operator.and_) if self._is_boolean() else self._with(other, lambda a, b: a.bitwiseAND(b))

    def __or__(self, other):
        return self._logic(other, operator.or_) if self._is_boolean() else self._with(other, lambda a, b: a.bitwiseOR(b))

    def __xor__(self, other):
        return self._with(other, operator.ne) if self._is_boolean() else self._with(other, lambda a, b: a.bitwiseXOR(b))

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __invert__(self):
        return self._new(~self.col if self._is_boolean() else F.bitwise_not(self.col))

    def __neg__(self):
        return self._new(-self.col)

    def __pos__(self):
        return self

    def __abs__(self):
        return self.abs()

    def __divmod__(self, other):
        return self // other, self % other

    def __rdivmod__(self, other):
        return self.__rfloordiv__(other), self.__rmod__(other)

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        from tessera.functions.ufuncs import apply

        return apply(ufunc, method, inputs, kwargs)

    # -- elementwise
    def abs(self):
        return self._new(F.abs(self.col))

    def round(self, decimals: int = 0):
        return self._new(F.bround(self.col, decimals) if isinstance(self.dtype, NUMERIC) else self.col)

    def clip(self, lower=None, upper=None, axis=None):
        c = self.col
        if lower is not None:
            c = F.greatest(c, lit(lower))
        if upper is not None:
            c = F.least(c, lit(upper))
        return self._new(F.when(self.col.isNotNull(), c))

    def between(self, left, right, inclusive: str = "both"):
        low = self >= left if inclusive in ("both", "left") else self > left
        high = self <= right if inclusive in ("both", "right") else self < right
        return low & high

    def isin(self, values):
        if isinstance(values, Series):
            held = values.base.sdf.select(values.col.alias("__v")).distinct()
            flag = _fresh("in")
            f = self.base._extend(lambda df: df.join(held.withColumn(flag, F.lit(True)), self.col == F.col("__v"), "left").drop("__v"))
            return Series(f, F.coalesce(F.col(flag), F.lit(False)), self.name)
        values = list(values)
        some = [v for v in values if not pd.isna(v)]
        found = known(self.col.isin(some)) if some else F.lit(False)
        pred = self.col.isin(some) if len(some) == len(values) and some else None
        return self._new(found | self.col.isNull() if len(some) < len(values) else found, pred)

    def isna(self):
        return self._new(is_missing(self.col, self.dtype))

    isnull = isna

    def notnull(self):
        return self._new(~is_missing(self.col, self.dtype))

    notna = notnull

    def fillna(self, value):
        if isinstance(value, Series):
            return self._with(value, F.coalesce)
        v = value.column if isinstance(value, Scalar) else lit(value)
        return self._new(F.coalesce(F.nanvl(self.col, F.lit(None)) if isinstance(self.dtype, FLOATING) else self.col, v))

    def dropna(self):
        return self._rows(lambda f: f.dropna())

    def where(self, cond, other=None):
        return self._choose(cond, other, True)

    def mask(self, cond, other=None):
        return self._choose(cond, other, False)

    def _choose(self, cond, other, keep: bool):
        cond = cond(self) if callable(cond) and not isinstance(cond, Series) else cond
        if isinstance(other, Series):
            s = self._with(other, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return s._with(cond, lambda p, c: F.when(c, p["a" if keep else "b"]).otherwise(p["b" if keep else "a"])).rename(self.name)
        o = other.column if isinstance(other, Scalar) else lit(other)
        return self._with(cond, lambda a, c: F.when(c, a if keep else o).otherwise(o if keep else a)).rename(self.name)

    def case_when(self, caselist):
        out = self
        for cond, value in reversed(list(caselist)):  # the first that holds is set last
            out = out.mask(cond, value)
        return out

    def replace(self, to_replace=None, value=None, regex: bool = False):
        pairs = to_replace if isinstance(to_replace, dict) else {k: (value[i] if isinstance(value, (list, tuple)) else value) for i, k in enumerate(_list(to_replace))}
        c = self.col
        if regex:
            for pattern, new in pairs.items():
                c = F.regexp_replace(c, pattern, new)
            return self._new(c)
        chain = None
        for old, new in pairs.items():
            test = c.isNull() if pd.isna(old) else c == lit(old)
            chain = F.when(test, lit(new)) if chain is None else chain.when(test, lit(new))
        return self._new(chain.otherwise(c) if chain is not None else c)

    def astype(self, dtype):
        if dtype in ("category",):
            return self._new(self.col, cat_info=(None, False))
        kind = {"int": "long", "int64": "long", "int32": "int", "float": "double", "float64": "double", "float32": "float", "str": "string", "object": "string", "bool": "boolean", "datetime64[ns]": "timestamp_ntz"}.get(getattr(dtype, "__name__", str(dtype)), str(dtype))
        return self._new(self.col.cast(kind))

    def map(self, arg, na_action=None, meta: str = "double"):
        if isinstance(arg, dict):
            pairs = F.create_map(*[lit(x) for kv in arg.items() for x in kv])
            return self._new(F.try_element_at(pairs, self.col))
        if isinstance(arg, Series):
            g = arg.to_frame("__to")._indexed()
            new = _fresh("m")
            right = g.sdf.select(F.col(g.index_column).alias("__from"), F.col("__to").alias(new))
            return Series(self.base._extend(lambda df: df.join(right, self.col == F.col("__from"), "left").drop("__from")), F.col(new), self.name)

        @F.pandas_udf(meta)
        def run(s: pd.Series) -> pd.Series:
            return s.map(arg, na_action=na_action)

        return self._new(run(self.col))

    def apply(self, function, meta: str = "double", args=(), **kwargs):
        return self.map(lambda x: function(x, *args, **kwargs), meta=meta)

    def map_partitions(self, func, *args, meta: str, **kwargs):
        return self.to_frame().map_partitions(lambda d: (lambda r: r.to_frame() if isinstance(r, pd.Series) else r)(func(d.iloc[:, 0], *args, **kwargs)), meta=meta)

    def combine_first(self, other):
        return self._with(other, F.coalesce)

    def combine(self, other, func, fill_value=None, meta: str = "double"):
        @F.pandas_udf(meta)
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return x.combine(y, func, fill_value)

        return self._with(other, run)

    def explode(self):
        return self._rows(lambda f: f.explode(f._columns[0]))

    def align(self, other, join="outer", axis=None, fill_value=None):
        a, b = align(self.to_frame("l"), other.to_frame("r"), join, fill_value)
        return a["l"].rename(self.name), b["r"].rename(other.name)

    def to_numeric(self, errors="raise"):
        return self._new(self.col.try_cast("double") if errors == "coerce" else self.col.cast("double"))

    # -- reductions
    def _agg(self, c: Column) -> Scalar:
        return Scalar(self.base.sdf.agg(c))

    def _moment_of(self, name: str, fisher: bool = True) -> Scalar:
        return self._agg(_moment(name, self.col, fisher))

    def skew(self, axis=0, bias=True, **_):
        return self._moment_of("skew")

    def kurtosis(self, axis=0, fisher=True, bias=True, **_):
        return self._moment_of("kurt", fisher)

    def nunique(self, dropna=True, **_):
        return self._agg(F.count_distinct(self.col) + (F.lit(0) if dropna else F.max(self.col.isNull().cast("int"))))

    def nunique_approx(self, b: int = 16):
        return self.to_frame().nunique_approx(b)

    def _idx_column(self, which: str) -> Column:
        """The label of the first extremum; missing values don't count."""
        f = self.base
        place = F.struct(*f.order)
        idx = F.col(f.index_column)
        if which == "min":
            return F.min_by(idx, F.when(self.col.isNotNull(), F.struct(self.col, place)))
        # negating the value orders the place ascending among equals
        return F.min_by(idx, F.when(self.col.isNotNull(), F.struct(-self.col.cast("double"), place)))

    def idxmin(self, **_):
        s = self.to_frame()._indexed()
        return s[s._columns[0]]._agg(s[s._columns[0]]._idx_column("min"))

    def idxmax(self, **_):
        s = self.to_frame()._indexed()
        return s[s._columns[0]]._agg(s[s._columns[0]]._idx_column("max"))

    def cov(self, other, min_periods=None, **_):
        return self._pair(other, F.covar_samp)

    def corr(self, other, method="pearson", min_periods=None, **_):
        return self._pair(other, F.corr)

    def _pair(self, other, f):
        s = self._with(other, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))))
        return s._agg(f(s.col["a"], s.col["b"]))

    def autocorr(self, lag: int = 1, **_):
        return self.corr(self.shift(lag))

    def unique(self, **_):
        return Frame(self.base.sdf.select(self.col.alias(self._named())).distinct())[self._named()]

    def drop_duplicates(self, keep="first", **_):
        return self._rows(lambda f: f.drop_duplicates(keep=keep))

    def value_counts(self, sort=None, ascending=False, dropna=True, normalize=False, **_):
        c = "__k"
        sdf = self.base.sdf.select(self.col.alias(c))
        sdf = sdf.where(F.col(c).isNotNull()) if dropna else sdf
        out = sdf.groupBy(c).agg(F.count("*").alias("count"))
        name = "count"
        if normalize:
            name = "proportion"
            out = out.crossJoin(F.broadcast(out.agg(F.sum("count").alias("__t")))).select(c, (F.col("count") / F.col("__t")).alias(name))  # one row
        f = Frame(out.withColumnRenamed(c, IDX), [name], IDX, index_name=self.name)
        if sort is not False:
            f = f.sort_values(name, ascending)
        return Series(f, F.col(name), name)

    def mode(self, dropna=True, **_):
        c = self._named()
        counts = self.base.sdf.select(self.col.alias(c))
        counts = counts.where(F.col(c).isNotNull()) if dropna else counts
        counts = counts.groupBy(c).agg(F.count("*").alias("__n"))
        top = counts.agg(F.max("__n").alias("__m"))  # one row
        kept = counts.join(F.broadcast(top), F.col("__n") == F.col("__m")).select(c)
        return Frame(kept, [c], order=[c])[c]

    def nlargest(self, n=5, **_):
        return self._rows(lambda f: f.nlargest(n, f._columns))

    def nsmallest(self, n=5, **_):
        return self._rows(lambda f: f.nsmallest(n, f._columns))

    def quantile(self, q=0.5, method="default"):
        if isinstance(q, (list, tuple, np.ndarray)):
            out = self.to_frame().quantile(q)
            return out[out._columns[0]]
        if method == "tdigest":
            return self._agg(F.percentile_approx(self.col, float(q), 10_000))
        return self._agg(F.percentile(self.col, F.lit(float(q)))) if not isinstance(self.dtype, NUMERIC) else self._exact(float(q))

    def _exact(self, q: float) -> Scalar:
        return Scalar(quantiles.percentiles(self.base.sdf.select(self.col.alias("value")), {"value": [q]}).select(F.col("value")[0]))

    def median(self, **_):
        return self._exact(0.5) if isinstance(self.dtype, NUMERIC) else self._agg(F.median(self.col))

    def median_approximate(self, **_):
        return self._agg(F.percentile_approx(self.col, 0.5))

    def _describe_struct(self, percentiles=(0.25, 0.5, 0.75)) -> dict[str, Column | None]:
        c = self.col
        if isinstance(self.dtype, NUMERIC):
            out = {"count": F.count(c), "mean": F.avg(c), "std": F.sqrt(nulls.variance(c)), "min": F.min(c)}
            out |= {f"{100 * p:g}%": None for p in percentiles}  # exact quantiles aren't an aggregate: see quantiles.percentiles
            return out | {"max": F.max(c)}
        raise TypeError('numbers only')

    def describe(self, percentiles=(0.25, 0.5, 0.75), **_):
        f = self.to_frame()
        if not isinstance(self.dtype, NUMERIC):
            c = F.col(f._columns[0])
            counts = f.sdf.where(c.isNotNull()).groupBy(c.alias("k")).agg(F.count("*").alias("n"))
            one = counts.agg(F.count("*").alias("unique"), F.sum("n").alias("count"), F.min_by("k", F.struct(-F.col("n"), F.col("k"))).cast("string").alias("top"), F.max("n").alias("freq"))
            rows = F.explode(F.array(*[F.struct(F.lit(i).alias("__p"), F.lit(k).alias(IDX), F.col(k).cast("string").alias(f._columns[0])) for i, k in enumerate(["unique", "count", "top", "freq"])])).alias("r")
            return Frame(one.select(rows).select("r.*"), f._columns, IDX, ["__p"])[f._columns[0]]
        out = f.describe(percentiles)
        return out[out._columns[0]]

    def _monotonic(self, up: bool):
        s = self.to_frame()._positioned()
        name = s._columns[0]
        sdf = ordered.neighbours(s.sdf, {"__prev": lambda w: F.lag(name).over(w)}, s.order, 1, rows=s.root)
        c, p = F.col(name), F.col("__prev")
        return Scalar(sdf.agg(F.coalesce(F.bool_and((c >= p) if up else (c <= p)), F.lit(True))))

    @property
    def is_monotonic_increasing(self):
        return self._monotonic(True)

    @property
    def is_monotonic_decreasing(self):
        return self._monotonic(False)

    def dot(self, other):
        s = self._with(other, operator.mul)
        return s._agg(F.sum(s.col))

    def _bytes(self) -> Column:
        kind = self.dtype
        size = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.FloatType: 4, T.ShortType: 2, T.ByteType: 1, T.BooleanType: 1}.get(type(kind), 8)
        if isinstance(kind, T.StringType):
            return F.coalesce(F.sum(F.octet_length(self.col)), F.lit(0)).cast("long")
        return (F.count(F.lit(1)) * size).cast("long")

    def memory_usage(self, index=True, deep=False):
        return self._agg(self._bytes())

    @property
    def nbytes(self):
        return self._agg(self._bytes())

    # -- ordered: the root's plan gets the new column
    def _neighbours(self, f: Callable, before: int, after: int = 0) -> Series:
        b = self.base if self.base.order else self.base._positioned()
        new, value = _fresh("w"), self.col
        kept = _fresh("c")
        g = b._extend(lambda df: ordered.neighbours(df.withColumn(kept, value), {new: lambda w: f(F.col(kept), w)}, b.order, before, after, rows=b.root).drop(kept))
        return Series(g, F.col(new), self.name)

    def shift(self, periods: int = 1, freq=None, axis=0):
        if freq is not None:
            return self._rows(lambda f: f.shift(periods, freq))
        if periods >= 0:
            return self._neighbours(lambda c, w: F.lag(c, periods).over(w), periods)
        return self._neighbours(lambda c, w: F.lead(c, -periods).over(w), 0, -periods)

    def diff(self, periods: int = 1, axis=0):
        before = self.shift(periods)
        return Series(before.base, self.col - before.col, self.name)

    def _running(self, kind: str, skipna: bool = True) -> Series:
        b = self.base if self.base.order else self.base._positioned()
        new, seen, value, kept = _fresh("r"), _fresh("s"), self.col, _fresh("c")
        more = {} if skipna else {seen: ("sum", F.col(kept).isNull().cast("long"))}
        g = b._extend(lambda df: ordered.running(df.withColumn(kept, value), {new: (kind, F.col(kept))} | more, b.order, rows=b.root).drop(kept))
        return Series(g, F.when(self.col.isNotNull() if skipna else F.col(seen) == 0, F.col(new)), self.name)

    def cumsum(self, axis=0, skipna=True, **_):
        return self._running("sum", skipna)

    def cumprod(self, axis=0, skipna=True, **_):
        return self._running("prod", skipna)

    def cummin(self, axis=0, skipna=True, **_):
        return self._running("min", skipna)

    def cummax(self, axis=0, skipna=True, **_):
        return self._running("max", skipna)

    def ffill(self, axis=0, limit=None):
        return self._rows(lambda f: f.ffill(limit=limit))

    def bfill(self, axis=0, limit=None):
        return self._rows(lambda f: f.bfill(limit=limit))

    def rolling(self, window, min_periods=None, center=False, win_type=None, **_):
        from tessera.operators.windows import Rolling

        name = _fresh("v")
        base = self.base._extend(lambda df: df.withColumn(name, self.col))
        return Rolling(base if base.order else base._positioned(), window, min_periods, center, columns=[name], series=True, label=self.name)

    def resample(self, rule, closed="left", label="left"):
        from tessera.operators.windows import Resampler

        return Resampler(self.to_frame(), rule, closed, label, series=True)

    def groupby(self, by, dropna=True, **_):
        from tessera.operators.groupby import GroupBy

        value = self._named()
        keys = _list(by)
        f = self.base.assign(**{value: self}) if self.name not in self.base._columns else self.base
        return GroupBy(f, keys, dropna=dropna, chosen=value)

    def sort_values(self, ascending=True, na_position="last", **_):
        return self._rows(lambda f: f.sort_values(f._columns, ascending, na_position))

    def to_json(self, path, **kw):
        return self.to_frame().to_json(path, **kw)

    def to_csv(self, path, **kw):
        return self.to_frame().to_csv(path, **kw)

    def to_sql(self, name, uri, **kw):
        return self.to_frame().to_sql(name, uri, **kw)

    def to_string(self, max_rows=5):
        return self.head(max_rows).to_string()

    def __iter__(self):
        for row in self.spark_frame().toLocalIterator(prefetchPartitions=True):
            yield row[-1]

    def __repr__(self) -> str:
        return f"<Series {self.name!r}: {self.dtype.simpleString()}>"

    @property
    def str(self):
        from tessera.functions.accessors import StringAccessor

        return StringAccessor(self)

    @property
    def dt(self):
        from tessera.functions.accessors import DatetimeAccessor

        return DatetimeAccessor(self)

    @property
    def cat(self):
        from tessera.functions.accessors import CategoricalAccessor

        return CategoricalAccessor(self)

    def categories_now(self) -> list:
        return reshape.categories_of(self.to_frame("c").sdf, "c")


class Index(Series):
    """The labels of the rows."""

    def to_series(self, name=None) -> Series:
        return Series(self.base, self.col, name or self.name)

    def to_frame(self, name: str | None = None) -> Frame:
        return super().to_frame(name or self.name or "0")

    def shift(self, periods: int = 1, freq=None, axis=0):
        return self.base.shift(periods, freq).index

    def __getattribute__(self, name: str):
        if name in ("sum", "prod", "mean", "std", "var", "idxmax", "idxmin", "index"):
            raise AttributeError(f"an Index has no {name}")
        return super().__getattribute__(name)


def _install() -> None:
    arithmetic = {"add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": nulls.divide, "floordiv": nulls.floordiv, "mod": nulls.mod, "pow": F.pow}
    for name, f in arithmetic.items():
        setattr(Series, f"__{name}__", lambda self, other, f=f: self._with(other, f))
        setattr(Series, f"__r{name}__", lambda self, other, f=f: self._with(other, lambda a, b: f(b, a)))
        setattr(Series, name, lambda self, other, level=None, fill_value=None, axis=0, f=f: self._filled(other, f, fill_value))
        setattr(Series, f"r{name}", lambda self, other, level=None, fill_value=None, axis=0, f=f: self._filled(other, lambda a, b: f(b, a), fill_value))
    Series.div = Series.divide = Series.truediv
    Series.rdiv = Series.rtruediv
    for name in ("lt", "le", "gt", "ge", "eq"):
        f = getattr(operator, name)
        setattr(Series, f"__{name}__", lambda self, other, f=f: self._with(other, f, truth=True))
        setattr(Series, name, lambda self, other, level=None, fill_value=None, axis=0, f=f: (self if fill_value is None else self.fillna(fill_value))._with(other, f, truth=True))

    def ne(self, other, level=None, fill_value=None, axis=0):
        """A missing value differs from everything."""
        s = self if fill_value is None else self.fillna(fill_value)
        return s._with(other, lambda a, b: F.coalesce(a != b, F.lit(True)))

    Series.ne, Series.__ne__ = ne, lambda self, other: self.ne(other)
    for name in ("sum", "prod", "mean", "min", "max", "count", "any", "all", "var", "std", "sem"):
        setattr(Series, name, lambda self, axis=0, skipna=True, ddof=1, min_count=0, how=name, **_: self._agg(nulls.aggregate(how, self.col, ddof=ddof, min_count=min_count, skipna=skipna)))
    Series.product = Series.prod


_install()
