"""Ordered operators without one global task: rows are cut into segments of the order, each a window partition.

Segment bounds come from one pass over the order column (approximate quantiles, as many as shuffle partitions); equal
order values stay together. A running aggregate is the segment's own plus the sum of the segments before it, a table of
one row a segment that is broadcast. Fixed-width windows read a halo: the last rows of the segment before.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "__seg"
_RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType, T.DateType)


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("double")


def _bounds(df: DataFrame, order: list[str]) -> list[float]:
    """Where the order column is cut; none for an order that isn't a number or time."""
    kind = df.schema[order[0]].dataType if isinstance(order[0], str) else None
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n == 1 or not isinstance(kind, _RANGED):
        return []
    return sorted(set(df.select(_number(F.col(order[0]), kind).alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.5 / n)))


def _found(key: Column, bounds: list[float], first: int = 0) -> Column:
    """The number of bounds below ``key``, by halving; null has none below it."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key > F.lit(float(bounds[middle])), _found(key, bounds[middle + 1 :], first + middle + 1)).otherwise(_found(key, bounds[:middle], first))


def segmented(df: DataFrame, order: list[str], rows: Rows | None = None) -> DataFrame:
    """``df`` with its segment number; null order values come first. An order that isn't a number or time is one segment."""
    cuts = rows.cuts(order) if rows else None
    bounds = _bounds(df, order) if cuts is None else cuts.bounds
    if not bounds:
        return df.withColumn(SEGMENT, F.lit(0))
    return df.withColumn(SEGMENT, _found(_number(F.col(order[0]), df.schema[order[0]].dataType).cast("double"), bounds))


class Rows:
    """The rows that a frame and all its extensions by more columns have in common, with how their order is cut."""

    def __init__(self, sdf: DataFrame) -> None:
        self.sdf, self._cuts = sdf, {}

    def cuts(self, order: list[str]) -> Cuts | None:
        """Found once for all operators over these rows; None where the order isn't among their columns."""
        if not order or not all(isinstance(c, str) and c in self.sdf.columns for c in order):
            return None
        if tuple(order) not in self._cuts:
            self._cuts[tuple(order)] = Cuts(self.sdf.select(*dict.fromkeys(order)), order)
        return self._cuts[tuple(order)]


class Cuts:
    """Segment bounds and sizes of an order; extensions keep a row's segment and position under names of their own."""

    _made = itertools.count()

    def __init__(self, sdf: DataFrame, order: list[str]) -> None:
        number = next(Cuts._made)
        self.segment, self.position = f"__seg_{number}", f"__pos_{number}"
        self.bounds = _bounds(sdf, order)
        self.sizes = _sizes(segmented(sdf, order, _Known(self)))


class _Known:
    """Cuts that are known already, where Rows are asked for them."""

    def __init__(self, cuts: Cuts) -> None:
        self._cuts = cuts

    def cuts(self, order: list[str]) -> Cuts:
        return self._cuts


def within(order: list[str], keys: list[str] | None = None):
    """The window of a segment, or of a group where there are keys: groups are spread already."""
    return Window.partitionBy(*(keys or [SEGMENT])).orderBy(*order)


def running(df: DataFrame, how: dict[str, tuple[str, Column]], order: list[str], keys: list[str] | None = None, rows: Rows | None = None) -> DataFrame:
    """``df`` with running aggregates: new name -> (sum | prod | min | max | count | rows, column); missing values are skipped."""
    def local(kind: str, c: Column) -> Column:
        return {"sum": F.sum(c), "prod": F.product(c), "min": F.min(c), "max": F.max(c), "count": F.count(c), "rows": F.count(F.lit(1))}[kind]

    def joined(kind: str, a: Column, b: Column) -> Column:
        if kind in ("sum", "count", "rows"):
            return F.coalesce(a + b, a, b)
        if kind == "prod":
            return F.coalesce(a * b, a, b)
        return F.least(a, b) if kind == "min" else F.greatest(a, b)

    if keys:
        w = within(order, keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: local(kind, c).over(w) for name, (kind, c) in how.items()})
    df = segmented(df, order, rows)
    w = within(order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumns({name: local(kind, c).over(w) for name, (kind, c) in how.items()})
    totals = df.groupBy(SEGMENT).agg(*[local(kind, c).alias(f"__t_{name}") for name, (kind, c) in how.items()])
    before = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each segment
    carried = {f"__c_{n}": local("sum" if k in ("count", "rows") else k, F.col(f"__t_{n}")).over(before) for n, (k, _) in how.items()}
    carry = totals.withColumns(carried).select(SEGMENT, *carried)
    full = own.join(F.broadcast(carry), SEGMENT, "left")
    return full.withColumns({n: joined(k, F.col(n), F.col(f"__c_{n}")) for n, (k, _) in how.items()}).drop(SEGMENT, *carried)


def _sizes(df: DataFrame) -> DataFrame:
    """For each segment __s: its rows __n, those before it __base, and the span of positions of every segment."""
    sizes = df.groupBy(SEGMENT).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct((F.col("__base") + 1).alias("lo"), (F.col("__base") + F.col("__n")).alias("hi"), F.col(SEGMENT).alias("s"))
    everything = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a segment
    return sizes.select(F.col(SEGMENT).alias("__s"), "__n", "__base", F.collect_list(span).over(everything).alias("__spans"))


def haloed(df: DataFrame, order: list[str], before: int, after: int = 0, rows: Rows | None = None) -> DataFrame:
    """``df`` in segments, with copies of up to ``before`` rows of what precedes a segment and ``after`` of what follows it.

    ``__halo`` marks the copies. The position of a row among all decides how far a halo reaches, so one wider than a
    segment reaches over several. Only rows near an edge look for segments to be copied to; a row and its copies come
    from one pass over ``df``. The sizes of segments are counted on ``rows``, which any number of operators share, so a
    chain of them reads its input twice, however long it is.
    """
    wide, cuts = _dealt(df, order, before, after, rows)
    return wide.select("*", (F.col(SEGMENT) != F.col(cuts.segment)).alias("__halo"), F.col(cuts.position).alias("__pos"))


def _dealt(df: DataFrame, order: list[str], before: int, after: int, rows: Rows | None) -> tuple[DataFrame, Cuts]:
    cuts = (rows or Rows(df)).cuts(order) or Cuts(df, order)
    own, at, kept = F.col(cuts.segment), F.col(cuts.position), df.columns
    if cuts.position not in kept:
        df = segmented(df, order, _Known(cuts)).select(*[F.col(f"`{c}`") for c in kept], F.col(SEGMENT).alias(cuts.segment), F.row_number().over(within(order)).alias("__row"))
        at, kept = F.col("__base") + F.col("__row"), [*kept, cuts.segment]
    placed = df.join(F.broadcast(cuts.sizes), own == F.col("__s"))
    reach = F.filter("__spans", lambda s: (s["s"] != own) & (at >= s["lo"] - before) & (at <= s["hi"] + after))
    near = (at <= F.col("__base") + after) | (at > F.col("__base") + F.col("__n") - before)
    to = F.concat(F.array(own), F.when(near, F.transform(reach, lambda s: s["s"])).otherwise(F.array().cast("array<int>")))
    same = [F.col(f"`{c}`") for c in kept if c != cuts.position]
    placed = placed.select(*same, at.alias(cuts.position), to.alias("__to"))
    return placed.withColumn(SEGMENT, F.explode("__to")).drop("__to"), cuts


def neighbours(df: DataFrame, made: dict[str, Column], order: list[str], before: int, after: int = 0, keys: list[str] | None = None, rows: Rows | None = None) -> DataFrame:
    """``df`` with Columns that contain ``over``-less windows given as functions of a window specification."""
    if keys:
        w = within(order, keys)
        return df.withColumns({name: f(w) for name, f in made.items()})
    wide, cuts = _dealt(df, order, before, after, rows)
    w = Window.partitionBy(SEGMENT).orderBy(cuts.position)
    return wide.withColumns({name: f(w) for name, f in made.items()}).where(F.col(SEGMENT) == F.col(cuts.segment)).drop(SEGMENT, *([] if rows else [cuts.segment, cuts.position]))


def filled(df: DataFrame, columns: list[str], order: list[str], forward: bool = True, limit: int | None = None, keys: list[str] | None = None, rows: Rows | None = None) -> DataFrame:
    """``df`` with missing values of ``columns`` taken from the last (next) valid row, over at most ``limit`` rows."""
    if limit is not None:
        take = (lambda c: lambda w: F.last(c, True).over(w.rowsBetween(-limit, 0))) if forward else (lambda c: lambda w: F.first(c, True).over(w.rowsBetween(0, limit)))
        return neighbours(df, {c: take(F.col(c)) for c in columns}, order, limit if forward else 0, 0 if forward else limit, keys, rows)

    def edge(c: Column) -> Column:
        return F.last(c, True) if forward else F.first(c, True)

    frame = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    if keys:
        w = within(order, keys).rowsBetween(*frame)
        return df.withColumns({c: edge(F.col(c)).over(w) for c in columns})
    df = segmented(df, order, rows)
    w = within(order).rowsBetween(*frame)
    own = df.withColumns({c: edge(F.col(c)).over(w) for c in columns})
    position = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    ends = df.groupBy(SEGMENT).agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"__e_{c}") for c in columns])
    beyond = Window.orderBy(SEGMENT).rowsBetween(*((Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)))
    carry = ends.select(SEGMENT, *[edge(F.col(f"__e_{c}")).over(beyond).alias(f"__c_{c}") for c in columns])
    full = own.join(F.broadcast(carry), SEGMENT, "left")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(c, f"__c_{c}")).drop(f"__c_{c}"), columns, full).drop(SEGMENT)
