"""Mixing sources to target weights: cube-method balanced sampling of documents."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096  # documents of one source that a task moves together
LARGE = 0.02
LANDING = 12  # fractional documents that are left for the landing
FEWEST_SHUFFLED_SOURCES = 50_000  # up to so many sources their table is broadcast
_SLACK = 1e-9


def sizes_of(docs: DataFrame, text: str = "text") -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source of (source, size): source, n_docs, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn. ``share`` times all sizes is shared by
    weight; a source stops at ``most`` times its size and its excess is reshared until none is above. In order of
    most * size / weight the stopped sources come first, so one pass over the sources finds the last level.
    """
    by = units.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("__k", F.row_number().over(turn) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("__k", F.lit(len(weights))) + 1))
    by = by.withColumn("__cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("weight"), "__k")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("__level", level)
    stopped = F.col("__level") * F.col("weight") > F.col("__cap")
    first = F.first(F.when(~stopped, F.col("__level")), ignorenulls=True).over(everything)
    target = F.when(stopped, F.col("__cap")).otherwise(first * F.col("weight"))
    return by.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, leave: int) -> np.ndarray:
    """Move the fractions ``p`` along vectors that change neither the sum of p nor that of size * p.

    Three fractional units have one such direction; each move settles one of them at 0 or 1 and keeps every
    expectation. Units settle in the order given; at most ``leave`` + 2 at the end stay fractional.
    """
    p = p.astype(float).copy()
    values, probability = size.astype(float).tolist(), p.tolist()
    waiting = [i for i in range(len(probability)) if _SLACK < probability[i] < 1 - _SLACK]
    stop = max(0, len(waiting) - leave)
    draws = iter(rng.random(len(waiting) + 3).tolist())
    active: list[int] = []
    taken = 0
    while True:
        while len(active) < 3 and taken < stop:
            active.append(waiting[taken])
            taken += 1
        if len(active) < 3:
            break
        a, b, c = active
        u = [values[b] - values[c], values[c] - values[a], values[a] - values[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        scale = max(map(abs, u))
        u = [x / scale for x in u]
        up = min(((1 - probability[i]) / x if x > 0 else probability[i] / -x) for i, x in zip(active, u, strict=True) if x)
        down = min((probability[i] / x if x > 0 else (1 - probability[i]) / -x) for i, x in zip(active, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for i, x in zip(active, u, strict=True):
            q = probability[i] + step * x
            probability[i] = 0.0 if q < _SLACK else 1.0 if q > 1 - _SLACK else q
            if 0.0 < probability[i] < 1.0:
                still.append(i)
        active = still
    return np.array(probability)


def settle_large(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, share: float = LARGE) -> np.ndarray:
    """Settle the units that hold over ``share`` of the open words, moving all others a little for each.

    In a flight of three a unit far larger than its companions hardly moves, and what is left of it at the end is
    more than a few small ones can make up for. Here the direction is a + b * size on all other open units, which
    keeps the same two sums.
    """
    p = p.astype(float).copy()
    while True:
        open_ = np.flatnonzero((p > _SLACK) & (p < 1 - _SLACK))
        if len(open_) <= LANDING or size[open_].max() <= share * size[open_].sum():
            return p
        i = open_[np.argmax(size[open_])]
        rest = open_[open_ != i]
        s = size[rest].astype(float)
        sums = np.array([[len(s), s.sum()], [s.sum(), (s * s).sum()]])
        if np.linalg.det(sums / s.max() ** np.array([[0, 1], [1, 2]])) < 1e-9:
            return p
        a, b = np.linalg.solve(sums, [-1.0, -float(size[i])])
        u = np.zeros(len(p))
        u[i], u[rest] = 1.0, a + b * s
        move = u != 0
        up = np.where(u[move] > 0, 1 - p[move], p[move]) / np.abs(u[move])
        down = np.where(u[move] > 0, p[move], 1 - p[move]) / np.abs(u[move])
        up, down = up.min(), down.min()
        p[move] += (up if rng.random() * (up + down) < down else -down) * u[move]
        p = np.where(p < _SLACK, 0.0, np.where(p > 1 - _SLACK, 1.0, p))


def land(size: np.ndarray, p: np.ndarray, owed: float = 0.0) -> np.ndarray:
    """Round the few fractions that are left: of all choices the one whose words miss the wanted sum least,
    then whose number of documents does."""
    open_ = np.flatnonzero((p > _SLACK) & (p < 1 - _SLACK))
    out = np.where(p >= 1 - _SLACK, 1.0, np.where(p <= _SLACK, 0.0, p))
    if not len(open_):
        return out
    choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(open_))))
    words = np.abs(choices @ size[open_] - p[open_] @ size[open_] - owed)
    count = np.abs(choices.sum(1) - p[open_].sum())
    best = np.lexsort((np.arange(len(choices)), count, np.round(words, 6)))[0]
    out[open_] = choices[best]
    return out


def mend(size: np.ndarray, chosen: np.ndarray, wanted: float, slack: float = 0.005) -> np.ndarray:
    """Where one document is so large that no landing is near, give up the number of documents: flip the largest
    settled ones that still fit into the gap."""
    chosen, gap = chosen.copy(), wanted - float(chosen @ size)
    if abs(gap) > slack * wanted:
        for i in np.argsort(-size, kind="stable").tolist():
            if gap > 0 and not chosen[i] and size[i] <= gap:
                chosen[i], gap = 1.0, gap - size[i]
            elif gap < 0 and chosen[i] and size[i] <= -gap:
                chosen[i], gap = 0.0, gap + size[i]
    return chosen


def _fly(seed: int, level: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        source, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
        size, p = table["size"].to_numpy(), table["p"].to_numpy().copy()
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(source).encode()), block])
        last = bool(len(table)) and table["blocks"][0].as_py() == 1
        wanted = float(p @ size)
        p = settle_large(size, p, rng)
        # the last to settle are of all magnitudes, so that the landing can make up for any fraction that is left
        fractional = np.flatnonzero((p > _SLACK) & (p < 1 - _SLACK))
        late = fractional[np.unique(np.linspace(0.1 * len(fractional), len(fractional) - 1, LANDING - 2).astype(int))] if len(fractional) else fractional
        order = np.concatenate([np.setdiff1d(np.arange(len(p)), late), late])
        p[order] = flight(size[order], p[order], rng, len(late))
        if last:
            p = mend(size, land(size, p), wanted)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """``units`` (doc_id, source, size, text_hash) with source_size, target, times and taken (= times * size).

    A source's documents are taken target / source_size times each on average: the whole part always, the
    fraction by the cube method, which balances the words and the number of documents taken in each source.
    Blocks of a source fly by themselves, so a source with a third of all rows is spread over many tasks; what
    they leave open meets, 12 documents from each, in ever fewer blocks. Only identifiers and sizes are shuffled,
    and ``units`` should be cheap to read again.

    Documents without words are never taken; the null source is a source; repeated rows are units of their own.
    Equal inputs give equal results, however they are partitioned. No rows give no rows.
    """
    shares = cut(targets(units, weights, share, most))
    n_sources, most_docs = shares.agg(F.count("*"), F.max("n_docs")).first()
    right = shares.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if n_sources <= FEWEST_SHUFFLED_SOURCES else right
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(each + F.lit(_SLACK)).cast("int")
    state = (
        units.select("doc_id", "source", "size", "text_hash")
        .join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("base", base).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), each - F.col("base"))).otherwise(0.0))
        .withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK).cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    )
    state = cut(state.select("doc_id", "source", "size", "text_hash", "source_size", "target", "base", "p", "blocks", "block"))
    is_open = (F.col("p") > _SLACK) & (F.col("p") < 1 - _SLACK)
    done, blocks, level = [state.where(~is_open)], max(1, math.ceil((most_docs or 0) / BLOCK)), 0
    state = state.where(is_open)
    while True:
        flown = cut(state.groupBy("source", "block").applyInArrow(_fly(seed, level), state.schema))
        done.append(flown.where(~is_open))
        if blocks == 1:
            break
        blocks, level = math.ceil(blocks / (BLOCK // LANDING)), level + 1
        per = BLOCK // LANDING
        state = flown.where(is_open).withColumn("blocks", F.ceil(F.col("blocks") / per).cast("long")).withColumn("block", F.floor(F.col("block") / per).cast("long"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    times = (F.col("base") + F.round("p").cast("int")).alias("times")
    return out.select("doc_id", "source", "size", "text_hash", "source_size", "target", times).withColumn("taken", F.col("times") * F.col("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix over (doc_id, text, source): see ``mix``. Texts are read once."""
    units = docs.select("doc_id", "source", sizes_of(docs).alias("size"), F.xxhash64("text").alias("text_hash"))
    return mix(cut(units), **options)


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; those taken never are gone.

    Decisions meet documents on doc_id and a hash of doc_id, source and text: one shuffle of the texts that stay
    wide. Rows that are equal in all three are interchangeable and share out their decisions in turn.
    """
    made = mix_documents(docs, **options).where("times > 0")
    name = lambda text_hash: F.xxhash64("doc_id", "source", text_hash)
    each = made.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("__d"), name("text_hash").alias("__h")).agg(F.array_sort(F.collect_list("times")).alias("__times"))
    keyed = docs.withColumns({"__d": F.coalesce("doc_id", F.lit(-1)), "__h": name(F.xxhash64("text"))})
    order = Window.partitionBy("__d", "__h").orderBy("__h")
    numbered = keyed.join(each, ["__d", "__h"]).withColumn("__n", F.row_number().over(order))
    return numbered.withColumn("__t", F.explode(F.sequence(F.lit(1), F.get("__times", F.col("__n") - 1)))).select(*docs.columns)
