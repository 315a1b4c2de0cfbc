"""Group-by: every aggregate is partial before the shuffle; ordered operators are windows over the group."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera import nulls
from tessera.frame import IDX, Frame, Series, _fresh, _list
from tessera.operators import ordered, quantiles

SIMPLE = ("sum", "prod", "mean", "min", "max", "count", "var", "std", "median", "nunique", "first", "last", "skew", "kurt", "sem", "any", "all")


@dataclass(frozen=True)
class Aggregation:
    """A user aggregate as Columns: ``agg(column) -> Column``, then ``finalize(result) -> Column``."""

    name: str
    agg: object
    finalize: object = None

    def __call__(self, c: Column) -> Column:
        out = self.agg(c)
        return self.finalize(out) if self.finalize else out


class GroupBy:
    def __init__(self, frame: Frame, by, dropna: bool = True, chosen=None) -> None:
        self.keys: list[str] = []
        self.made: list[str] = []
        for k in _list(by):
            if isinstance(k, pd.Grouper):
                raise NotImplementedError("pd.Grouper")
            if isinstance(k, Series):
                if k.name in frame._columns and k.base is frame:
                    self.keys.append(k.name)
                    continue
                name = k.name or "key"
                frame = frame.assign(**{name: k})
                self.keys.append(name)
                self.made.append(name)
            elif k in frame._columns:
                self.keys.append(k)
            elif k == frame.index_name:
                frame = frame.assign(**{k: Series(frame, F.col(frame.index_column), k)})
                self.keys.append(k)
                self.made.append(k)
            else:
                raise KeyError(k)
        self.frame, self.dropna, self.chosen = frame, bool(dropna) if dropna is not None else True, chosen
        self.columns = _list(chosen) or [c for c in frame._columns if c not in self.keys]
        valid = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in self.keys])
        self.rows = frame._new(frame.sdf.where(valid)) if self.dropna else frame

    def __getitem__(self, key) -> GroupBy:
        if missing := [c for c in _list(key) if c not in self.frame._columns]:
            raise KeyError(missing)
        out = object.__new__(GroupBy)
        out.__dict__ = self.__dict__ | {"chosen": key, "columns": _list(key)}
        return out

    def __getattr__(self, name: str):
        if not name.startswith("_") and name in self.frame._columns:
            return self[name]
        raise AttributeError(name)

    def _numeric(self) -> list[str]:
        return [c for c in self.columns if c in self.frame.numeric()]

    def _result(self, sdf, columns: list[str]):
        """Keys become the index: one key itself, several as a struct beside their columns."""
        if len(self.keys) == 1:
            key = self.keys[0]
            if key in columns:
                f = Frame(sdf.withColumn(IDX, F.col(key)), columns, IDX, index_name=key)
            else:
                f = Frame(sdf.withColumnRenamed(key, IDX), columns, IDX, index_name=key)
        else:
            f = Frame(sdf, [*self.keys, *columns], order=self.keys)
        return f[columns[0]] if isinstance(self.chosen, str) and columns == [self.chosen] else f

    def _order(self) -> Column | None:
        return F.struct(*self.rows.order) if self.rows.order else None

    def _aggregate(self, how: str, columns: list[str], **options):
        if how in ("median", "quantile") and columns:
            spread = quantiles.grouped(self.rows.sdf, self.keys, {c: (c, float(options.get("q", 0.5))) for c in columns})
            if spread is not None:
                return self._result(spread, columns)
        f = self.rows if how not in ("first", "last") else self.rows._positioned()
        order = F.struct(*f.order) if f.order else None
        cells = [nulls.aggregate(how, F.col(f"`{c}`"), order, **options).alias(c) for c in columns]
        return self._result(f.sdf.groupBy(*self.keys).agg(*cells), columns)

    def size(self):
        """Rows of each group, whatever they hold."""
        out = self.rows.sdf.groupBy(*self.keys).agg(F.count("*").alias("size"))
        if len(self.keys) > 1:
            return Frame(out, [*self.keys, "size"], order=self.keys)
        f = Frame(out.withColumnRenamed(self.keys[0], IDX), ["size"], IDX, index_name=self.keys[0])
        return Series(f, F.col("size"), None)

    def agg(self, arg=None, **named):
        """A name, a list of names, {column: name or names}, or new=(column, name)."""
        if arg is None:
            made = {new: (c, how) for new, (c, how) in named.items()}
        elif isinstance(arg, dict):
            made = {(c if not isinstance(hows, list) else f"{c}_{h}"): (c, h) for c, hows in arg.items() for h in _list(hows)}
        elif isinstance(arg, list):
            made = {f"{c}_{getattr(h, 'name', h)}" if not isinstance(self.chosen, str) else getattr(h, "name", h): (c, h) for c in self.columns for h in arg}
        else:
            made = {c: (c, arg) for c in (self.columns if arg in ("count", "min", "max", "first", "last", "nunique", "list", "size") or not isinstance(arg, str) else self._numeric())}
        f = self.rows._positioned() if any(h in ("first", "last", "list") for _, h in made.values() if isinstance(h, str)) else self.rows
        order = F.struct(*f.order) if f.order else None
        cells = [(h(F.col(f"`{c}`")) if callable(h) else nulls.aggregate(h, F.col(f"`{c}`"), order)).alias(new) for new, (c, h) in made.items()]
        exact = {new: (c, 0.5) for new, (c, h) in made.items() if isinstance(h, str) and h in ("median", "quantile") and c in self.frame.numeric()}
        spread = quantiles.grouped(f.sdf, self.keys, exact) if exact else None
        if spread is None:
            return self._result(f.sdf.groupBy(*self.keys).agg(*cells), list(made))
        # the others beside them, joined by the key as one value, in which missing parts are equal
        rest = f.sdf.groupBy(*self.keys).agg(F.count("*").alias("__n"), *[x for x, new in zip(cells, made, strict=True) if new not in exact])
        both = rest.withColumn("__g", F.struct(*self.keys)).join(spread.select(F.struct(*self.keys).alias("__g"), *exact), "__g")
        return self._result(both.select(*self.keys, *[F.col(f"`{new}`") for new in made]), list(made))

    aggregate = agg

    def value_counts(self, **_):
        c = self.columns[0]
        sdf = self.rows.sdf.where(F.col(c).isNotNull()).groupBy(*self.keys, c).agg(F.count("*").alias("count"))
        return Frame(sdf, [*self.keys, c, "count"])

    def unique(self, **_):
        return self._aggregate("unique", self.columns)

    def idxmin(self, **_):
        return self._idx("min")

    def idxmax(self, **_):
        return self._idx("max")

    def _idx(self, which: str):
        f = self.rows._indexed()
        return self._result(f.sdf.groupBy(*self.keys).agg(*[f[c]._idx_column(which).alias(c) for c in self.columns]), self.columns)

    def cov(self, ddof: int = 1, **_):
        return self._matrix(F.covar_samp)

    def corr(self, **_):
        return self._matrix(F.corr)

    def _matrix(self, f):
        names = self._numeric()
        one = self.rows.sdf.groupBy(*self.keys).agg(*[f(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"__{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)])
        rows = F.explode(F.array(*[F.struct(F.lit(a).alias("variable"), *[F.col(f"__{i}_{j}").alias(b) for j, b in enumerate(names)]) for i, a in enumerate(names)])).alias("r")
        sdf = one.select(*self.keys, rows).select(*self.keys, "r.*")
        return Frame(sdf, [*self.keys, "variable", *names])

    def quantile(self, q=0.5, **_):
        return self._aggregate("quantile", self._numeric(), q=q)

    def get_group(self, key):
        values = _list(key) if isinstance(key, (list, tuple)) else [key]
        test = reduce(lambda a, b: a & b, [F.col(k) == nulls.lit(v) for k, v in zip(self.keys, values, strict=True)])
        out = self.rows._new(self.rows.sdf.where(test))
        return out[self.chosen] if self.chosen is not None else out

    # -- rows of groups
    def _numbered(self, last: bool):
        f = self.rows._positioned()
        f = f._placed() if last else f
        order = [F.col("__n").desc()] if last else f.order
        return f, F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))

    def head(self, n: int = 5, **_):
        f, rn = self._numbered(False)
        out = f._new(f.sdf.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn"))
        return out[self.chosen] if self.chosen is not None else out

    def tail(self, n: int = 5, **_):
        f, rn = self._numbered(True)
        out = f._new(f.sdf.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn"))
        return out[self.chosen] if self.chosen is not None else out

    def _windowed(self, f, columns: list[str]):
        """Columns over the group's rows in their order, on the same rows as the frame."""
        rows = self.rows._positioned()
        w = ordered.within(rows.order, self.keys)
        new = {c: _fresh("g") for c in columns}
        wide = rows._extend(lambda df: df.withColumns({new[c]: f(F.col(f"`{c}`"), w) for c in columns}))
        if isinstance(self.chosen, str):
            return Series(wide, F.col(new[self.chosen]), self.chosen)
        return wide._each(lambda s: Series(wide, F.col(new[s.name]), s.name), columns)[columns]

    def shift(self, periods: int = 1, **_):
        return self._windowed(lambda c, w: F.lag(c, periods).over(w) if periods >= 0 else F.lead(c, -periods).over(w), self.columns)

    def ffill(self, limit=None, **_):
        return self._windowed(lambda c, w: F.last(c, True).over(w.rowsBetween(-limit if limit is not None else Window.unboundedPreceding, 0)), self.columns)

    def bfill(self, limit=None, **_):
        return self._windowed(lambda c, w: F.first(c, True).over(w.rowsBetween(0, limit if limit is not None else Window.unboundedFollowing)), self.columns)

    def cumsum(self, **_):
        return self._windowed(lambda c, w: F.when(c.isNotNull(), F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))), self._numeric())

    def cumprod(self, **_):
        return self._windowed(lambda c, w: F.when(c.isNotNull(), F.product(c).over(w.rowsBetween(Window.unboundedPreceding, 0))), self._numeric())

    def cumcount(self, **_):
        rows = self.rows._positioned()
        new = _fresh("g")
        wide = rows._extend(lambda df: df.withColumn(new, F.row_number().over(ordered.within(rows.order, self.keys)) - 1))
        return Series(wide, F.col(new), None)

    def transform(self, func, meta: str | None = None, **_):
        """A named aggregate is a window; a function runs on each group in pandas."""
        if isinstance(func, str):
            return self._windowed(lambda c, w: nulls.aggregate(func, c).over(Window.partitionBy(*self.keys)) if func not in ("sum", "prod", "var", "std") else _over(func, c, self.keys), self.columns if func in ("count", "min", "max") else self._numeric())
        columns = list(self.columns)
        return self._apply(lambda pdf: pdf[columns].apply(func), meta)

    def apply(self, func, *args, meta: str, **kwargs):
        chosen = self.chosen
        return self._apply(lambda pdf: func(pdf[chosen] if chosen is not None else pdf, *args, **kwargs), meta)

    def _apply(self, func, meta: str):
        """Each group goes to one task whole: what ``func`` asks for."""
        f = self.rows._placed()
        names, order = list(f._columns), "__n"

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = func(pdf.sort_values(order)[names])
            if isinstance(out, pd.Series):
                out = out.to_frame() if len(out) == len(pdf) else out.to_frame().T
            return out if isinstance(out, pd.DataFrame) else pd.DataFrame([[out]])

        return Frame(f.sdf.groupBy(*self.keys).applyInPandas(run, meta))

    def rolling(self, window, min_periods=None, center=False, **_):
        from tessera.operators.windows import Rolling

        return Rolling(self.rows._positioned(), window, min_periods, center, keys=self.keys, columns=self._numeric(), series=isinstance(self.chosen, str))

    def compute(self, **_):
        raise NotImplementedError("aggregate or apply first")


def _over(how: str, c: Column, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    if how == "sum":
        return F.coalesce(F.sum(c).over(w), F.lit(0))
    if how == "prod":
        return F.coalesce(F.product(c).over(w), F.lit(1.0))
    v = F.when(F.count(c).over(w) > 1, F.var_samp(c).over(w))
    return F.sqrt(v) if how == "std" else v


def _install() -> None:
    for name in SIMPLE:
        whole = name in ("min", "max", "count", "first", "last", "nunique", "any", "all")
        setattr(GroupBy, name, lambda self, numeric_only=None, ddof=1, min_count=0, how=name, whole=whole, **_: self._aggregate(how, self.columns if whole else self._numeric(), ddof=ddof, min_count=min_count))
    GroupBy.kurtosis = GroupBy.kurt


_install()
