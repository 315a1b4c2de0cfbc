"""Joins of Spark DataFrames with pandas-like results: merge, as-of join, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = {"left": "left", "right": "right", "outer": "full", "inner": "inner", "leftsemi": "left_semi", "left_semi": "left_semi"}


def merge(left: DataFrame, right: DataFrame, how: str, left_on: list[str], right_on: list[str], suffixes: tuple[str, str] = ("_x", "_y"), indicator: bool = False, broadcast: bool | None = None) -> DataFrame:
    """Equi-join; missing keys match each other. Same-named keys become one column, other shared names get suffixes.

    ``broadcast`` only passes a hint on when it is asked for; otherwise sizes decide, at run time if need be.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    if len(left_on) != len(right_on):
        raise ValueError("as many left as right keys are needed")
    right = F.broadcast(right) if broadcast else right
    a, b = left.alias("l"), right.alias("r")
    # null-safe equality is hashed as an equi-join key
    on = reduce(lambda x, y: x & y, [F.col(f"l.`{x}`").eqNullSafe(F.col(f"r.`{y}`")) for x, y in zip(left_on, right_on, strict=True)])
    if HOW[how] == "left_semi":
        return a.join(b, on, "left_semi").select("l.*")
    if indicator:
        a, b = left.withColumn("__l", F.lit(1)).alias("l"), right.withColumn("__r", F.lit(1)).alias("r")
    joined = a.join(b, on, HOW[how])
    same = [x for x, y in zip(left_on, right_on, strict=True) if x == y]
    shared = [c for c in left.columns if c in right.columns and c not in same]
    out: list[Column] = []
    for c in left.columns:
        if c in same:
            value = F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`")) if how in ("right", "outer") else F.col(f"l.`{c}`")
            out.append(value.alias(c))
        else:
            out.append(F.col(f"l.`{c}`").alias(c + suffixes[0] if c in shared else c))
    for c in right.columns:
        if c not in same:
            out.append(F.col(f"r.`{c}`").alias(c + suffixes[1] if c in shared else c))
    if indicator:
        side = F.when(F.col("l.__l").isNull(), "right_only").when(F.col("r.__r").isNull(), "left_only").otherwise("both")
        out.append(side.alias("_merge"))
    return joined.select(*out)


def as_of(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: list[str] = (), right_by: list[str] = (), direction: str = "backward", tolerance=None,
    allow_exact_matches: bool = True, suffixes: tuple[str, str] = ("_x", "_y"), bucket: float | None = None,
) -> DataFrame:
    """Each left row with the last right row at or before it (or the next, or the nearest), within equal ``by`` keys.

    Both sides are stacked and one ordered pass carries the last right row on: no pairs are made. Without ``by`` keys the
    pass runs in segments of the order column, so no task holds all rows.
    """
    from tessera.operators.ordered import filled

    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    values = [c for c in right.columns if c not in right_by and not (c == right_on and right_on == left_on)]
    kind = left.schema[left_on].dataType
    ls = left.select(F.struct(*left.columns).alias("__row"), F.col(left_on).alias("__on"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("__seen"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(left_by)])
    rs = right.where(F.col(right_on).isNotNull()).select(
        F.lit(None).cast(ls.schema["__row"].dataType).alias("__row"), F.col(right_on).cast(kind).alias("__on"), F.struct(*right.columns).alias("__seen"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(right_by)]
    )
    keys = [f"__by{i}" for i in range(len(left_by))] or None

    def carried(forward: bool, name: str, base: DataFrame) -> DataFrame:
        # an equal right row is seen first when exact matches count, and after the left row otherwise
        first = allow_exact_matches == forward
        tie = F.when(F.col("__row").isNull() == F.lit(first), 0).otherwise(1)
        out = base.withColumn("__tie", tie).withColumn(name, F.col("__seen"))
        return filled(out, [name], ["__on", "__tie"], forward, None, keys).drop("__tie")

    both = ls.unionByName(rs)
    if direction in ("backward", "nearest"):
        both = carried(True, "__back", both)
    if direction in ("forward", "nearest"):
        both = carried(False, "__next", both)
    matched = both.where("__row is not null")

    def near(c: str) -> Column:
        at = F.col(c)[right_on].cast(kind)
        if tolerance is None:
            return F.col(c)
        from tessera.nulls import lit

        gap = F.col("__on") - at if c == "__back" else at - F.col("__on")
        return F.when(gap <= lit(tolerance), F.col(c))

    if direction == "nearest":
        back, ahead = near("__back"), near("__next")
        gap_back, gap_ahead = F.col("__on") - back[right_on].cast(kind), ahead[right_on].cast(kind) - F.col("__on")
        hit = F.when(ahead.isNull() | (gap_back <= gap_ahead), back).otherwise(ahead)
    else:
        hit = near("__back" if direction == "backward" else "__next")
    matched = matched.withColumn("__hit", hit)
    shared = {c for c in values if c in left.columns}
    out = [F.col("__row")[c].alias(c + suffixes[0] if c in shared else c) for c in left.columns]
    out += [F.col("__hit")[c].alias(c + suffixes[1] if c in shared else c) for c in values]
    return matched.select(*out)


def stack(frames: list[DataFrame], join: str = "outer") -> DataFrame:
    """All rows, frame by frame; columns of all frames (outer) or of every one (inner)."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if join == "inner":
        names = [c for c in names if all(c in f.columns for f in frames)]
        frames = [f.select(*names) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
