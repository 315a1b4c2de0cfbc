"""Sharding by a permutation-filled lookup table; placement is one hash and one broadcast look-up."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65537  # a prime, many times the number of shards


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard.

    Each shard prefers slots in the order offset, offset + skip, offset + 2 skip, ... modulo the prime
    ``size``. Shards take turns; at its turn a shard claims the first slot in its order that is free.
    Every shard gets size / len(shards) slots, give or take one, and few slots move when a shard goes.
    """
    if not shards or len(set(shards)) != len(shards) or not _prime(size) or size < len(shards):
        raise ValueError("distinct shards and a prime table size of at least their number are needed")
    place = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % size
            table[place[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """The table as rows (slot, shard), made inside the JVM from one literal; its size is fixed by the table's."""
    numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(numbers).alias("slot", "shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A null key is placed like the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot``, ``shard`` (index) and ``shard_name``; rows neither move nor multiply.

    Equal keys go to one shard, repeated rows too; a null key counts as the empty string. Extra columns stay;
    those named like a result column give way to it. No rows give no rows.
    """
    placed = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(F.col(key), size))
    table = lookup(df.sparkSession, fill(shards, size))  # ``size`` rows of two ints: the bound of the broadcast
    names = F.array(*[F.lit(s) for s in shards])
    return placed.join(F.broadcast(table), "slot").select(*df.drop("slot", "shard", "shard_name").columns, "slot", "shard", F.get(names, F.col("shard")).alias("shard_name"))
