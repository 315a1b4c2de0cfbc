"""Approximate nearest neighbours with a forest of hash-prefix trees.

A tree is the sorted array of its vectors' hash strings of BITS bits. A query descends to the longest prefix that it
shares with any string of each tree, and then all trees ascend together, one bit at a time, taking in every vector that
shares the shorter prefix, until the neighbours found make others unlikely.
"""

from __future__ import annotations

import math


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 40
BITS = 60
K = 10
MISS = 0.03  # accepted probability that a vector as near as the k-th found was passed over
SHARD = 20_000  # vectors of one forest
QUERY_BLOCK = 256


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """The trees over one shard's vectors, all of one dimension."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5) -> None:
        self.vectors, self.trees, self.bits = vectors, trees, bits
        rng = np.random.default_rng([seed, vectors.shape[1]])
        self.centre = vectors.mean(axis=0)
        spread = np.linalg.norm(vectors - self.centre, axis=1)
        # planes keep a distance from the centre as far as lengths differ, so that vectors in one direction part too
        self.planes = rng.standard_normal((vectors.shape[1], trees * bits))
        self.shift = rng.standard_normal(trees * bits) * spread.std()
        self.codes = self.hash(vectors)
        self.order = np.argsort(self.codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.codes, self.order, axis=0)

    def hash(self, vectors: np.ndarray) -> np.ndarray:
        """One string for each vector and tree, in the high bits of a number."""
        out = np.zeros((len(vectors), self.trees), np.uint64)
        for first in range(0, len(vectors), 4096):
            side = ((vectors[first : first + 4096] - self.centre) @ self.planes + self.shift) > 0
            side = side.reshape(-1, self.trees, self.bits)
            for bit in range(self.bits):
                out[first : first + 4096] |= side[:, :, bit].astype(np.uint64) << np.uint64(63 - bit)
        return out

    def search(self, query: np.ndarray, code: np.ndarray, ids: np.ndarray, own: int, k: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first, ties to the smaller id; own is left out."""
        n, trees, bits = len(self.vectors), self.trees, self.bits
        at = np.array([np.searchsorted(self.sorted[:, t], code[t]) for t in range(trees)])
        shared = np.zeros(trees, int)
        for side in (at - 1, at):
            ok = (side >= 0) & (side < n)
            differ = self.sorted[np.clip(side, 0, n - 1), np.arange(trees)] ^ code
            length = np.array([64 - int(x).bit_length() for x in differ])
            shared = np.maximum(shared, np.where(ok, np.minimum(length, bits), 0))
        low, high = at.copy(), at.copy()
        seen = np.zeros(n, bool)
        found = np.zeros(0, np.int64)
        distance = np.zeros(0)
        for depth in range(int(shared.max()), -1, -1):
            new: list[np.ndarray] = []
            for t in np.flatnonzero(shared >= depth).tolist():
                keep = np.uint64(((1 << depth) - 1) << (64 - depth)) if depth else np.uint64(0)
                first = int(np.searchsorted(self.sorted[:, t], code[t] & keep))
                last = int(np.searchsorted(self.sorted[:, t], code[t] | ~keep, "right"))
                new += [self.order[first : low[t], t], self.order[high[t] : last, t]]
                low[t], high[t] = min(first, low[t]), max(last, high[t])
            fresh = np.zeros(n, bool)
            for part in new:
                fresh[part] = True
            fresh &= ~seen
            more = np.flatnonzero(fresh)
            if len(more):
                seen |= fresh
                more = more[ids[more] != own]
                difference = self.vectors[more] - query
                found = np.concatenate([found, more])
                distance = np.concatenate([distance, np.sqrt((difference * difference).sum(axis=1))])
                if len(found) > 4 * k:
                    worst = np.partition(distance, k - 1)[k - 1]
                    near = distance <= worst
                    found, distance = found[near], distance[near]
            if len(found) >= k and len(more):
                last_one = found[np.argpartition(distance, k - 1)[k - 1]]
                agree = 1 - sum(int(x).bit_count() for x in (self.codes[last_one] ^ code).tolist()) / (trees * bits)
                if (1 - agree**depth) ** trees <= miss:
                    break
        order = np.lexsort((ids[found], distance))[:k]
        return ids[found[order]], distance[order]


def _search(k: int, trees: int, bits: int, miss: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            left = left.sort_by("vec_id")
            ids, queries = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
            forest = Forest(matrix(left["vector"]), trees, bits)
            wanted = matrix(right["query"])
            for first in range(0, len(queries), QUERY_BLOCK):
                part = wanted[first : first + QUERY_BLOCK]
                for q, vector, code in zip(queries[first : first + QUERY_BLOCK].tolist(), part, forest.hash(part), strict=True):
                    near, distance = forest.search(vector, code, ids, q, k, miss)
                    out.append((np.full(len(near), q), near, distance))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, bits: int = BITS, miss: float = MISS, shard: int = SHARD
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each query (query_id, query) in (vec_id, vector).

    Every usable vector is in the forest of one shard of its dimension; shards hold about ``shard`` vectors, by a hash
    of vec_id, and every query visits each shard of its dimension, so a vector that is common fills no shard.
    A shard's results are exact distances in double precision; the best k of all shards remain, ties to the smaller
    vec_id. Ranges of equal prefixes are taken whole: no bucket is cut. Vectors that are null, empty or zero or hold
    null or non-finite components take no part, nor do null ids; a query isn't its own neighbour; fewer candidates
    than k give fewer rows. Repeated rows are candidates each. No rows give no rows.
    """
    held = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where(usable(F.col("query")) & F.col("query_id").isNotNull()).select("query_id", F.col("query").cast("array<double>").alias("query"))
    shards = max(1, math.ceil(held.count() / shard))
    held = held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("dim", F.size("vector"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("dim", F.size("query"))
    found = held.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInArrow(_search(k, trees, bits, miss), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
