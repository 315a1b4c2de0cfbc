"""Rolling windows and time bins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import nulls
from tessera.frame import IDX, Frame, Series, _fresh
from tessera.functions.datetimes import CALENDAR, FIXED, floor_to, frequency, from_micros, micros
from tessera.operators import ordered, quantiles


class Rolling:
    """Windows of a number of rows, or of a span of time up to and with each row's."""

    def __init__(self, frame: Frame, window, min_periods=None, center=False, keys=None, columns=None, series=False, label=None) -> None:
        self.frame, self.window, self.center, self.keys, self.series, self.label = frame, window, center, keys, series, label
        self.timed = not isinstance(window, int)
        if self.timed and center:
            raise NotImplementedError("centred spans of time")
        self.least = min_periods if min_periods is not None else (1 if self.timed else window)
        self.columns = columns or frame.numeric()

    def _made(self, f, columns=None, parts=(), whole=None):
        """f(column, window) -> Column; missing where fewer than min_periods values are present.

        Over a span of time, what can be put together from ``parts`` (names of PARTS) is ``whole`` of them, a function of
        (type, part, part, ...): see ``spanned``. Else every window is gone through.
        """
        frame, names, least = self.frame, columns or self.columns, self.least
        new = {c: _fresh("o") for c in names}

        def cell(c: str, w) -> Column:
            return F.when(F.count(F.col(c)).over(w) >= least, f(F.col(c), w))

        if self.timed:
            n, unit = frequency(self.window if isinstance(self.window, str) else f"{int(pd.Timedelta(self.window).total_seconds() * 10**6)}us")
            span = n * FIXED[unit]
            at, cuts = frame.index_column, []

            def extend(df):
                df = df.withColumn("__t", micros(F.col(at)))
                if parts:
                    made = {new[c]: (c, lambda count, *p, kind=df.schema[c].dataType: F.when(count >= least, _bound(lambda *q: whole(kind, *q), *p))) for c in names}
                    return spanned(df, span, ("count", *parts), made, self.keys, cuts).drop("__t")
                df = df if self.keys else _timed_halo(df, span)
                w = Window.partitionBy(*(self.keys or ["__bin"])).orderBy("__t").rangeBetween(-span + 1, 0)
                df = df.withColumns({new[c]: cell(c, w) for c in names})
                return (df if self.keys else df.where(~F.col("__halo")).drop("__halo", "__bin")).drop("__t")
        else:
            before = self.window // 2 if self.center else self.window - 1
            after = (self.window - 1) // 2 if self.center else 0

            def extend(df):
                return ordered.neighbours(df, {new[c]: (lambda w, c=c: cell(c, w.rowsBetween(-before, after))) for c in names}, frame.order, before, after, self.keys, frame.root)

        wide = frame._extend(extend)
        if self.series:
            return Series(wide, F.col(new[names[0]]), self.label or names[0])
        return wide._each(lambda s: Series(wide, F.col(new[s.name]), s.name), names)[names]

    def count(self):
        least, self.least = self.least, 0
        out = self._made(lambda c, w: F.count(c).over(w).cast("double"), parts=("count",), whole=lambda kind, n: n.cast("double"))
        self.least = least
        return out

    def quantile(self, q: float = 0.5):
        return self._made(lambda c, w: F.percentile(c, F.lit(float(q))).over(w))

    def var(self, ddof: int = 1):
        return self._made(lambda c, w: _variance(c, w, ddof), parts=("moments",), whole=lambda kind, m: F.when(m["n"] > ddof, m["m2"] / (m["n"] - ddof)))

    def std(self, ddof: int = 1):
        return self._made(lambda c, w: F.sqrt(_variance(c, w, ddof)), parts=("moments",), whole=lambda kind, m: F.when(m["n"] > ddof, F.sqrt(m["m2"] / (m["n"] - ddof))))

    def skew(self):
        """Without bias: missing for under three values."""
        def f(c, w):
            n = F.count(c).over(w).cast("double")
            return F.when(n >= 3, F.skewness(c).over(w) * F.sqrt(n * (n - 1)) / (n - 2))

        def whole(kind, m):
            n, spread = m["n"], m["m2"] != 0
            return F.when((n >= 3) & spread, F.sqrt(n) * m["m3"] / F.pow(m["m2"], F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2))

        return self._made(f, parts=("moments",), whole=whole)

    def kurt(self):
        def f(c, w):
            n = F.count(c).over(w).cast("double")
            return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c).over(w) + 6))

        def whole(kind, m):
            n, spread = m["n"], m["m2"] != 0
            return F.when((n >= 4) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m["m4"] / (m["m2"] * m["m2"]) - 3) + 6))

        return self._made(f, parts=("moments",), whole=whole)

    def cov(self, ddof: int = 1) -> Frame:
        """Pairs of columns side by side."""
        frame = self.frame
        pairs = {f"{a}_{b}": (a, b) for a in self.columns for b in self.columns}
        before = self.window - 1
        wide = ordered.neighbours(frame.sdf, {k: (lambda w, a=a, b=b: F.when(F.count(F.col(a)).over(w.rowsBetween(-before, 0)) >= self.least, F.covar_samp(a, b).over(w.rowsBetween(-before, 0)))) for k, (a, b) in pairs.items()}, frame.order, before, 0, self.keys, frame.root)
        return frame._new(wide, list(pairs))

    def agg(self, hows) -> Frame:
        if isinstance(hows, str):
            return getattr(self, hows)()
        chosen = hows if isinstance(hows, dict) else {c: hows for c in self.columns}
        out, names = self.frame, []
        for c, which in chosen.items():
            for how in [which] if isinstance(which, str) else which:
                one = Rolling(self.frame, self.window, self.least, self.center, self.keys, [c], True)
                s = getattr(one, how)()
                name = f"{c}_{how}" if not isinstance(which, str) else c
                out = out._merged(s.base)
                names.append((name, s.col))
        wide = out.sdf.select(*out._hidden(), *[col.alias(n) for n, col in names])
        return out._new(wide, [n for n, _ in names])

    aggregate = agg

    def apply(self, func, raw: bool = True, meta: str = "double"):
        """``func`` on the values of each window, vectorised over windows gathered as arrays."""
        @F.pandas_udf(meta)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else func(x if raw else pd.Series(x)))

        return self._made(lambda c, w: run(F.collect_list(c).over(w)))


def _variance(c: Column, w, ddof: int) -> Column:
    n = F.count(c).over(w)
    return F.when(n > ddof, F.var_pop(c).over(w) * n / (n - ddof))


def _timed_halo(df, span: int):
    """Bins of time at least as wide as the span, each with copies of the bin before: no task holds all rows."""
    width = span * 64
    df = df.withColumn("__bin", F.floor(F.col("__t") / width)).withColumn("__halo", F.lit(False))
    copies = df.where(F.pmod(F.col("__t"), F.lit(width)) > width - span).withColumn("__bin", F.col("__bin") + 1).withColumn("__halo", F.lit(True))
    return df.unionByName(copies)


def _moments(c: Column, over) -> Column:
    """Number, mean, least, largest and sums of the 2nd to 4th powers of deviations from the mean."""
    x = c.cast("double")
    n, v = over(F.count(x)).cast("double"), over(F.var_pop(x))
    m3 = F.when(v == 0, F.lit(0.0)).otherwise(over(F.skewness(x)) * n * F.pow(v, F.lit(1.5)))
    m4 = F.when(v == 0, F.lit(0.0)).otherwise((over(F.kurtosis(x)) + 3) * n * v * v)
    return F.struct(n.alias("n"), over(F.avg(x)).alias("mean"), over(F.min(x)).alias("lo"), over(F.max(x)).alias("hi"), (v * n).alias("m2"), m3.alias("m3"), m4.alias("m4"))


def _joined_moments(a: Column, b: Column) -> Column:
    """Moments of both; equal values have none but the mean, whatever rounding gives."""
    na, nb, d = a["n"], b["n"], b["mean"] - a["mean"]
    n, lo, hi = na + nb, F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"])
    made = {
        "m2": a["m2"] + b["m2"] + d * d * na * nb / n,
        "m3": a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (n * n) + 3 * d * (na * b["m2"] - nb * a["m2"]) / n,
        "m4": a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (n * n * n) + 6 * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n) + 4 * d * (na * b["m3"] - nb * a["m3"]) / n,
    }
    cells = [F.when(lo == hi, F.lit(0.0)).otherwise(m).alias(k) for k, m in made.items()]
    both = F.struct(n.alias("n"), F.when(lo == hi, lo).otherwise(a["mean"] + d * nb / n).alias("mean"), lo.alias("lo"), hi.alias("hi"), *cells)
    return F.when(a.isNull() | (na == 0), b).when(b.isNull() | (nb == 0), a).otherwise(both)


def _bound(f, *cells: Column) -> Column:
    """f(*cells) with each cell made once, however often ``f`` names it: else expressions would double at every step."""
    return F.transform(F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])), lambda x: f(*[x[f"c{i}"] for i in range(len(cells))]))[0]


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: What aggregates over spans of time are put together from: of the rows of a stretch (by way of ``over``), and of two stretches.
PARTS = {
    "count": (lambda c, over: over(F.count(c)), _added), "sum": (lambda c, over: over(F.sum(c)), _added),
    "total": (lambda c, over: over(F.sum(c.cast("double"))), _added), "moments": (_moments, lambda a, b: _bound(_joined_moments, a, b)),
    "min": (lambda c, over: over(F.min(c)), F.least), "max": (lambda c, over: over(F.max(c)), F.greatest),
}


def spanned(df, span: int, parts, made: dict, keys=None, cuts: list | None = None):
    """``df`` with aggregates of the rows of the last ``span`` microseconds up to and with each row's ``__t``.

    ``made``: new name -> (column, function of the window's ``parts``). Time is cut into bins as wide as the span. A
    window is the rest of the bin before and the start of its own, and each of the two is a running aggregate, so a row
    costs the same however many rows a span holds; nothing is subtracted. Copies of the bin before are moved on by the
    span: those after a row's time are the ones in its window. Bins with many rows are cut further, at quantiles of the
    time of rows and copies, with the parts of a bin's other pieces carried on; ``cuts`` keeps these from call to call.
    Groups are spread already and have bins only.
    """
    keys, columns = list(keys or []), list(dict.fromkeys(c for c, _ in made.values()))
    t = F.col("__t")
    if cuts is not None and not cuts and not keys:
        cuts.append(ordered._bounds(df.select(F.explode(F.array(t, t + span)).alias("__t")), ["__t"]))
    bounds = [] if keys or not cuts else cuts[0]
    df = df.withColumn("__bin", t - F.pmod(t, F.lit(span))).withColumn("__copy", F.lit(False))
    copies = df.where(t.isNotNull()).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *columns])], (t + span).alias("__t"), (F.col("__bin") + span).alias("__bin"), F.lit(True).alias("__copy"))
    stack = df.unionByName(copies, allowMissingColumns=True).withColumn("__piece", ordered._found(t, bounds))
    place = [*keys, "__bin", "__piece"]
    upto, after = Window.partitionBy(*place).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*place).orderBy(t.desc(), "__copy").rowsBetween(Window.unboundedPreceding, 0)
    sides = {"own": (~F.col("__copy"), upto), "old": (F.col("__copy"), after)}
    cells = [(f"__{side}_{i}_{p}", PARTS[p], F.when(which, F.col(f"`{c}`")), w) for side, (which, w) in sides.items() for i, c in enumerate(columns) for p in dict.fromkeys(parts)]
    wide = stack.withColumns({name: of(c, lambda a, w=w: a.over(w)) for name, (of, _), c, w in cells})
    kinds = {name: wide.schema[name].dataType for name, *_ in cells}

    def both(name: str, join, a: Column, b: Column) -> Column:  # sums of decimals stay of their type
        return join(a, b).cast(kinds[name]) if isinstance(kinds[name], T.DecimalType) else join(a, b)

    if bounds:
        split = stack.where(F.col("__bin").isin(sorted({int(b) - int(b) % span for b in bounds})))
        pieces = split.groupBy("__bin", "__piece").agg(*[of(c, lambda a: a).alias(name) for name, (of, _), c, _ in cells])
        # one row for each piece of a bin that is cut: no more than cuts and bins that they lie in
        gathered = pieces.groupBy("__bin").agg(F.array_sort(F.collect_list(F.struct("__piece", *kinds))).alias("__all"))

        def beyond(name: str, join) -> Column:
            here = F.col("__at")["__piece"]
            others = F.filter("__all", (lambda x: x["__piece"] < here) if name.startswith("__own") else (lambda x: x["__piece"] > here))
            return F.aggregate(others, F.lit(None).cast(kinds[name]), lambda a, x: both(name, join, a, x[name]))

        carried = gathered.select("__bin", "__all", F.explode("__all").alias("__at")).select("__bin", F.col("__at")["__piece"].alias("__piece"), *[beyond(name, join).alias(f"__c{name}") for name, (_, join), _, _ in cells])
        wide = wide.join(F.broadcast(carried), ["__bin", "__piece"], "left")
        wide = wide.withColumns({name: both(name, join, F.col(f"__c{name}"), F.col(name)) for name, (_, join), _, _ in cells})
    wide = wide.where(~F.col("__copy"))
    part = lambda i, p: both(f"__own_{i}_{p}", PARTS[p][1], F.col(f"__old_{i}_{p}"), F.col(f"__own_{i}_{p}"))
    out = {new: whole(*[part(columns.index(c), p) for p in parts]) for new, (c, whole) in made.items()}
    return wide.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("__bin", "__copy")], *[c.alias(new) for new, c in out.items()])


def _mean(kind: T.DataType, total: Column, n: Column) -> Column:
    made = total / n
    return made.cast(T.DecimalType(min(kind.precision + 4, 38), min(kind.scale + 4, 38))) if isinstance(kind, T.DecimalType) else made


for _name, _f in {"sum": F.sum, "min": F.min, "max": F.max}.items():
    setattr(Rolling, _name, lambda self, how=_name, f=_f: self._made(lambda c, w: f(c).over(w), parts=(how,), whole=lambda kind, a: a))
Rolling.mean = lambda self: self._made(lambda c, w: F.avg(c).over(w), parts=("sum" if any(isinstance(self.frame.type_of(c), T.DecimalType) for c in self.columns) else "total", "count"), whole=_mean)
Rolling.median = lambda self: self.quantile(0.5)


class Resampler:
    """Time bins of a datetime index; bins without rows are part of the result."""

    EMPTY = {"sum": 0, "count": 0, "size": 0, "nunique": 0, "prod": 1.0}

    def __init__(self, frame: Frame, rule: str, closed="left", label="left", series=False) -> None:
        if not isinstance(frame.type_of(frame.index_column), (T.TimestampType, T.TimestampNTZType)):
            raise TypeError("a datetime index is needed")
        self.frame, self.rule, self.closed, self.label, self.series = frame, rule, closed or "left", label or "left", series
        self.columns = frame._columns

    def _bin(self, c: Column) -> Column:
        if self.closed == "right":
            n, unit = frequency(self.rule)
            c = from_micros(micros(c) - 1)
        return floor_to(c, self.rule)

    def _next(self, c: Column) -> Column:
        n, unit = frequency(self.rule)
        if unit in FIXED:
            return from_micros(micros(c) + n * FIXED[unit])
        unit = CALENDAR.get(unit, unit)
        return F.add_months(c, {"month": 1, "quarter": 3, "year": 12}[unit]).cast("timestamp_ntz") if unit != "week" else from_micros(micros(c) + 7 * FIXED["d"])

    def _result(self, cells: dict[str, Column], empty: dict[str, object], exact: dict[str, tuple[str, float]] | None = None):
        """``exact``: the cells that are quantiles, (column, q), made apart where a bin is large."""
        f = self.frame
        bins = f.sdf.where(F.col(f.index_column).isNotNull()).withColumn("__b", self._bin(F.col(f.index_column)))
        spread = quantiles.grouped(bins, ["__b"], exact) if exact else None
        made = bins.groupBy("__b").agg(F.count("*").alias("__n"), *[c.alias(k) for k, c in cells.items() if spread is None or k not in exact])
        made = (made if spread is None else made.join(spread, "__b")).select("__b", *[F.col(f"`{k}`") for k in cells])
        n, unit = frequency(self.rule)
        # the empty bins lie between one bin and the next that has rows: made from the bins, not from the rows
        edge = made.select("__b").withColumn("__n", F.lead("__b").over(Window.orderBy("__b")))
        if unit in FIXED:
            step = n * FIXED[unit]
            gaps = edge.where((micros(F.col("__n")) - micros(F.col("__b"))) > step)
            gaps = gaps.select(F.explode(F.sequence(micros(F.col("__b")) + step, micros(F.col("__n")) - step, F.lit(step))).alias("m")).select(from_micros(F.col("m")).alias("__b"))
        else:
            months = {"month": 1, "quarter": 3, "year": 12}.get(CALENDAR.get(unit, unit))
            span = f"interval {months} months" if months else "interval 7 days"
            gaps = edge.where(F.col("__n") > self._next(F.col("__b")))
            gaps = gaps.select(F.explode(F.slice(F.sequence(F.col("__b"), F.col("__n"), F.expr(span)), F.lit(2), F.size(F.sequence(F.col("__b"), F.col("__n"), F.expr(span))) - 2)).alias("__b"))
        full = made.unionByName(gaps.select(F.col("__b").cast(made.schema["__b"].dataType), *[F.lit(empty.get(k)).cast(made.schema[k].dataType).alias(k) for k in cells]))
        label = F.col("__b") if self.label == "left" else self._next(F.col("__b"))
        out = Frame(full.select(label.alias(IDX), *cells), list(cells), IDX, index_name=f.index_name)
        return out[list(cells)[0]] if self.series and len(cells) == 1 else out

    def _cell(self, how: str, c: str, **options) -> Column:
        return nulls.aggregate(how, F.col(c), F.struct(*self.frame.order), **options)

    def _all(self, how: str, **options):
        names = self.columns if how in ("count", "nunique", "first", "last", "min", "max") else self.frame.numeric()
        exact = {c: (c, 0.5) for c in names} if how in ("median", "quantile") else None
        return self._result({c: self._cell(how, c, **options) for c in names}, {c: self.EMPTY.get(how) for c in names}, exact)

    def size(self):
        out = self._result({"size": F.count(F.lit(1))}, {"size": 0})
        return out["size"] if isinstance(out, Frame) else out

    def quantile(self):
        return self._all("quantile", q=0.5)

    def ohlc(self) -> Frame:
        names = self.frame.numeric()
        key = (lambda c, k: k) if len(names) == 1 else (lambda c, k: f"{c}_{k}")
        cells = {key(c, k): self._cell(how, c) for c in names for k, how in (("open", "first"), ("high", "max"), ("low", "min"), ("close", "last"))}
        return self._result(cells, {})

    def agg(self, hows) -> Frame:
        if isinstance(hows, str):
            return getattr(self, hows)()
        chosen = hows if isinstance(hows, dict) else {c: hows for c in self.frame.numeric()}
        cells, empty, exact = {}, {}, {}
        for c, which in chosen.items():
            for how in [which] if isinstance(which, str) else which:
                name = c if isinstance(which, str) else how if self.series else f"{c}_{how}"
                cells[name], empty[name] = self._cell(how, c), self.EMPTY.get(how)
                if how in ("median", "quantile") and c in self.frame.numeric():
                    exact[name] = (c, 0.5)
        return self._result(cells, empty, exact)


for _name in ("sum", "prod", "mean", "min", "max", "count", "nunique", "first", "last", "var", "std", "sem", "median"):
    setattr(Resampler, _name, lambda self, how=_name, **_: self._all(how))
