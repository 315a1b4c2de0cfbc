"""The ``str``, ``dt`` and ``cat`` members of a Series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.frame import Frame, Series
from tessera.functions import datetimes, strings
from tessera.nulls import lit


def _columns(series: Series, made: dict) -> Frame:
    """Several Columns on the rows of the Series."""
    b = series.base
    keep = [c for c in dict.fromkeys([*b._hidden(), b.index_column, *b.order]) if isinstance(c, str) and c not in made]
    return Frame(b.sdf.select(*[c.alias(k) for k, c in made.items()], *keep), list(made), b.index_column, b.order, b.index_name)


class StringAccessor:
    def __init__(self, series: Series) -> None:
        self.series = series

    def __getattr__(self, name: str):
        if name not in strings.EXPRESSED:
            raise AttributeError(name)
        return lambda *args, **kwargs: self.series._new(strings.EXPRESSED[name](self.series.col, *args, **kwargs))

    def __dir__(self):
        return [*super().__dir__(), *strings.EXPRESSED]

    def __getitem__(self, index):
        if isinstance(index, slice):
            return self.slice(index.start, index.stop, index.step)
        return self.get(index)

    def get(self, i: int) -> Series:
        if self.series.dtype.typeName() == "array":
            return self.series._new(F.get(self.series.col, lit(i if i >= 0 else 0)) if i >= 0 else F.try_element_at(self.series.col, F.lit(i)))
        return self.series._new(strings.get(self.series.col, i))

    def len(self) -> Series:
        is_list = self.series.dtype.typeName() == "array"
        return self.series._new(F.size(self.series.col) if is_list else F.length(self.series.col))

    def join(self, sep: str) -> Series:
        is_list = self.series.dtype.typeName() == "array"
        return self.series._new(F.array_join(self.series.col, sep) if is_list else strings.join(self.series.col, sep))

    def _parted(self, name: str, pat, n: int, expand: bool):
        c = strings.EXPRESSED[name](self.series.col, pat, n)
        if not expand:
            return self.series._new(c)
        if not n or n < 0:
            raise NotImplementedError("expanding needs n")
        return _columns(self.series, {str(k): F.get(c, F.lit(k)) for k in range(n + 1)})

    def split(self, pat=None, n: int = -1, expand: bool = False):
        return self._parted("split", pat, n, expand)

    def rsplit(self, pat=None, n: int = -1, expand: bool = False):
        return self._parted("rsplit", pat, n, expand)

    def partition(self, sep: str = " ", expand: bool = True):
        c = strings.partition(self.series.col, sep)
        return _columns(self.series, {str(k): F.get(c, F.lit(k)) for k in range(3)}) if expand else self.series._new(c)

    def rpartition(self, sep: str = " ", expand: bool = True):
        c = strings.rpartition(self.series.col, sep)
        return _columns(self.series, {str(k): F.get(c, F.lit(k)) for k in range(3)}) if expand else self.series._new(c)

    def extract(self, pat: str, flags: int = 0, expand: bool = True):
        import re

        compiled = re.compile(pat)
        names = {v: k for k, v in compiled.groupindex.items()}
        pattern = re.sub(r"\(\?P<", "(?<", pat)
        made = {names.get(g, str(g - 1)): strings.extract(self.series.col, pattern, g, flags) for g in range(1, compiled.groups + 1)}
        return self.series._new(next(iter(made.values()))) if len(made) == 1 and not expand else _columns(self.series, made)

    def extractall(self, pat: str, flags: int = 0) -> Frame:
        """One row for each match of each value: match number and the groups."""
        import re

        groups = re.compile(pat).groups
        pattern = F.lit(strings._flags(re.sub(r"\(\?P<", "(?<", pat), True, flags))
        lists = [F.regexp_extract_all(self.series.col, pattern, F.lit(g)).alias(str(g - 1)) for g in range(1, groups + 1)]
        wide = self.series.base._indexed()
        sdf = wide.sdf.select(F.col(wide.index_column), F.posexplode(F.arrays_zip(*lists)).alias("match", "r"))
        return Frame(sdf.select(F.col(wide.index_column), "match", "r.*"), ["match", *[str(g) for g in range(groups)]], wide.index_column)

    def cat(self, others=None, sep: str = "", na_rep=None):
        if others is None:
            value = self.series.col if na_rep is None else F.coalesce(self.series.col, F.lit(na_rep))
            s = self.series.to_frame("v")._positioned()
            ordered = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.struct(*s.order).alias("o"), F.col("v").alias("v")))))
            from tessera.frame import Scalar

            return Scalar(s.sdf.agg(F.array_join(F.transform(ordered, lambda x: x["v"]), sep or "")))
        out = self.series
        for o in others if isinstance(others, list) else [others]:
            out = out._with(o, lambda a, b: strings.cat(a, [b], sep, na_rep))
        return out


class DatetimeAccessor:
    def __init__(self, series: Series) -> None:
        self.series = series

    def __getattr__(self, name: str):
        c = self.series.col
        if name in datetimes.PROPERTIES:
            return self.series._new(datetimes.PROPERTIES[name](c))
        if name in datetimes.METHODS:
            return lambda *args, **kwargs: self.series._new(datetimes.METHODS[name](c, *args, **kwargs))
        raise AttributeError(name)

    def __dir__(self):
        return [*super().__dir__(), *datetimes.PROPERTIES, *datetimes.METHODS]

    tz = freq = None

    def isocalendar(self) -> Frame:
        return _columns(self.series, {k: f(self.series.col) for k, f in datetimes.FRAMES["isocalendar"].items()})

    @property
    def components(self) -> Frame:
        return _columns(self.series, {k: f(self.series.col) for k, f in datetimes.FRAMES["components"].items()})

    @property
    def start_time(self) -> Series:
        return self.series._new(datetimes.period_bounds(self.series.col, "D")[0])

    @property
    def end_time(self) -> Series:
        return self.series._new(datetimes.period_bounds(self.series.col, "D")[1])

    def to_pydatetime(self):
        return self.series.compute().dt.to_pydatetime()

    def to_pytimedelta(self):
        return self.series.compute().dt.to_pytimedelta()


class CategoricalAccessor:
    """The categories are kept beside the plan; values not among them are missing."""

    def __init__(self, series: Series) -> None:
        self.series = series
        self.values, self.is_ordered = series.cat_info or (None, False)

    def _with(self, values, is_ordered=None, col=None) -> Series:
        return self.series._new(self.series.col if col is None else col, cat_info=(list(values) if values is not None else None, self.is_ordered if is_ordered is None else is_ordered))

    @property
    def known(self) -> bool:
        return self.values is not None

    def _need(self) -> list:
        if self.values is None:
            raise NotImplementedError("unknown categories: use as_known()")
        return self.values

    def as_known(self) -> Series:
        return self.series if self.known else self._with(self.series.categories_now())

    def as_unknown(self) -> Series:
        return self.series._new(self.series.col, cat_info=(None, self.is_ordered))

    @property
    def ordered(self) -> bool:
        return self.is_ordered

    @property
    def categories(self):
        import pandas as pd

        return pd.Index(self._need())

    @property
    def codes(self) -> Series:
        at = F.array_position(F.array(*[lit(v) for v in self._need()]), self.series.col) - 1
        return self.series._new(F.coalesce(at, F.lit(-1)).cast("int"))

    def as_ordered(self) -> Series:
        return self._with(self.values, True)

    def as_unordered(self) -> Series:
        return self._with(self.values, False)

    def add_categories(self, new) -> Series:
        return self._with([*self._need(), *([new] if isinstance(new, str) else new)])

    def set_categories(self, new, ordered=None) -> Series:
        new = list(new)
        return self._with(new, ordered, F.when(self.series.col.isin(new), self.series.col))

    def remove_categories(self, gone) -> Series:
        gone = [gone] if isinstance(gone, str) else list(gone)
        return self.set_categories([v for v in self._need() if v not in gone])

    def reorder_categories(self, new, ordered=None) -> Series:
        if set(new) != set(self._need()):
            raise ValueError("the same categories are needed")
        return self._with(new, ordered)

    def rename_categories(self, new) -> Series:
        pairs = new if isinstance(new, dict) else dict(zip(self._need(), new, strict=True))
        return self._with([pairs.get(v, v) for v in self._need()], None, self.series.replace(pairs).col)

    def remove_unused_categories(self) -> Series:
        used = set(self.series.categories_now())
        return self._with([v for v in self._need() if v in used])
