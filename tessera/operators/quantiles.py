"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch tells a value's rank but for one part in so many.
ACCURACY = 2000
#: Groups of up to so many rows keep their values in one task.
LARGE = 1 << 20


def _between(low: Column, high: Column, place: Column) -> Column:
    """The quantile at a place, counted from 0, of which ``low`` and ``high`` are the values at the whole places around it."""
    down, up = F.floor(place), F.ceil(place)
    return F.when((down == up) | (low == high), low).otherwise((up - place) * low + (place - down) * high)


def percentiles(df: DataFrame, wanted: dict[str, list[float]], keys: list[str] | None = None) -> DataFrame:
    """One row, or with ``keys`` one for each of a few groups: for each column of numbers an array of its exact quantiles, interpolated; null without values, NaN last.

    A sketch gives two values around each quantile, a pass counts the rows below and up to them, and only the values
    between are counted one by one and sorted: two thousandths of the rows, fewer where they repeat. Should a sketch
    be wrong, the counts tell, and that side stays open: then more rows are sorted, but the result is exact still.
    """
    targets = [(c, q) for c, qs in wanted.items() for q in qs]
    names = {c: f"c{j}" for j, c in enumerate(wanted)}
    values = df.select(*([F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k")] if keys else []), *[F.col(f"`{c}`").cast("double").alias(v) for c, v in names.items()])
    by = ["k"] if keys else []

    def beside(rows: DataFrame, small: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(small), "k") if keys else rows.crossJoin(F.broadcast(small))

    around = {c: [min(max(q + d / ACCURACY, 0.0), 1.0) for q in qs for d in (-2, 2)] for c, qs in wanted.items()}
    sketch = values.groupBy(*by).agg(*[F.percentile_approx(names[c], qs, ACCURACY).alias(f"s{j}") for j, (c, qs) in enumerate(around.items()) if qs])
    place = {(c, i): F.col(f"s{j}")[i] for j, (c, qs) in enumerate(around.items()) for i in range(len(qs))}
    sides = [(place[c, 2 * i], place[c, 2 * i + 1]) for c, qs in wanted.items() for i in range(len(qs))]
    cells = []
    for i, ((c, _), (lo, hi)) in enumerate(zip(targets, sides, strict=True)):
        v = F.col(names[c])
        cells += [F.count(v).alias(f"n{i}"), F.count_if(v < lo).alias(f"below{i}"), F.count_if(v <= hi).alias(f"upto{i}"), F.max(lo).alias(f"lo{i}"), F.max(hi).alias(f"hi{i}")]
    counts = beside(values, sketch).groupBy(*by).agg(*cells)  # one row each, or one for each group
    at = [(F.col(f"n{i}") - 1) * F.lit(float(q)) for i, (_, q) in enumerate(targets)]
    low_known, high_known = [F.floor(p) >= F.col(f"below{i}") for i, p in enumerate(at)], [F.ceil(p) < F.col(f"upto{i}") for i, p in enumerate(at)]
    bracket = counts.select(
        *by, *[F.when(k, F.col(f"lo{i}")).alias(f"lo{i}") for i, k in enumerate(low_known)], *[F.when(k, F.col(f"hi{i}")).alias(f"hi{i}") for i, k in enumerate(high_known)],
        F.array(*[F.struct(p.alias("place"), F.when(k, F.col(f"below{i}")).otherwise(F.lit(0)).alias("before")) for i, (p, k) in enumerate(zip(at, low_known, strict=True))]).alias("at"),
    )
    inside = [F.col(names[c]).isNotNull() & (F.col(f"lo{i}").isNull() | (F.col(names[c]) >= F.col(f"lo{i}"))) & (F.col(f"hi{i}").isNull() | (F.col(names[c]) <= F.col(f"hi{i}"))) for i, (c, _) in enumerate(targets)]
    near = beside(values, bracket.drop("at")).where(reduce(lambda a, b: a | b, inside))
    kept = near.select(*by, F.explode(F.array_compact(F.array(*[F.when(k, F.struct(F.lit(i).alias("i"), F.col(names[c]).alias("v"))) for i, ((c, _), k) in enumerate(zip(targets, inside, strict=True))]))).alias("x"))
    counted = beside(kept.groupBy(*by, "x.i", "x.v").agg(F.count("*").alias("n")), bracket.select(*by, "at"))
    until = F.sum("n").over(Window.partitionBy(*by, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select(*by, "i", "v", "n", until.alias("until"), F.col("at")[F.col("i")].alias("at")).select(*by, "i", "v", F.col("at.place").alias("place"), (F.col("at.before") + F.col("until")).alias("end"), "n")

    def value(i: int, rank: Column) -> Column:
        return F.max(F.when((F.col("i") == i) & (rank >= F.col("end") - F.col("n")) & (rank < F.col("end")), F.col("v")))

    found = ranked.groupBy(*by).agg(*[cell for i in range(len(targets)) for cell in (value(i, F.floor("place")).alias(f"low{i}"), value(i, F.ceil("place")).alias(f"high{i}"), F.max(F.when(F.col("i") == i, F.col("place"))).alias(f"place{i}"))])
    if keys:  # groups without values too
        found = bracket.select("k").join(found, "k", "left")
    made = [_between(F.col(f"low{i}"), F.col(f"high{i}"), F.col(f"place{i}")) for i in range(len(targets))]
    first, out = 0, []
    for c, qs in wanted.items():
        out.append(F.when(F.col(f"place{first}").isNotNull(), F.array(*made[first : first + len(qs)])).alias(c))
        first += len(qs)
    return found.select(*[F.col("k")[k].alias(k) for k in keys or []], *out)


def grouped(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame | None:
    """Of each group its exact quantiles, new name -> (column, q); None if no group is large, when an aggregate will do.

    The rows of the large groups, of which there are few, go through ``percentiles``, those of all others to the aggregate.
    """
    of = {new: F.percentile(F.col(f"`{c}`"), F.lit(q)).alias(new) for new, (c, q) in wanted.items()}
    sizes = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n"))
    most = sizes.agg(F.max("__n")).first()[0]
    if most is None or most <= LARGE:
        return None
    whole = F.struct(*[F.col(f"`{k}`") for k in keys])
    large = F.broadcast(sizes.where(F.col("__n") > LARGE).select(whole.alias("__g")))  # a row for each million rows at most
    rows = df.select(whole.alias("__g"), *[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *[c for c, _ in wanted.values()]])])
    apart = percentiles(rows.join(large, "__g", "leftsemi").select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`").alias(new) for new, (c, _) in wanted.items()]), {new: [q] for new, (_, q) in wanted.items()}, keys)
    others = rows.join(large, "__g", "leftanti").groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*of.values())
    return others.unionByName(apart.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{new}`")[0].alias(new) for new in wanted]))
