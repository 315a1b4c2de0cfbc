"""A random time series made inside the engine: each value depends on the seed, its column and its time alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.frame import IDX, Frame
from tessera.session import active

#: The names that a text column holds.
NAMES = "Alice Bob Charlie Dan Edith Frank George Hannah Ingrid Jerry Kevin Laura Michael Norbert Oliver Patricia Quinn Ray Sarah Tim Ursula Victor Wendy Xavier Yvonne Zelda".split()


def _uniform(column: str, seed: int) -> Column:
    """In [0, 1), the same whatever other columns are asked for."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{column}"), F.col("id")), F.lit(1 << 53)) / float(1 << 53)


def timeseries(start="2000-01-01", end="2000-01-31", freq: str = "1s", partition_freq: str = "1d", dtypes: dict | None = None, seed: int = 42, lam: float = 1000.0) -> Frame:
    """Columns of floats in [-1, 1), Poisson-like integers and names, on a regular time index."""
    dtypes = dtypes or {"name": str, "id": int, "x": float, "y": float}
    step = int(pd.Timedelta(freq if freq[0].isdigit() else f"1{freq}").total_seconds() * 10**6)
    first, last = pd.Timestamp(start), pd.Timestamp(end)
    n = int((last - first).total_seconds() * 10**6 // step)
    parts = max(1, int((last - first) / pd.Timedelta(partition_freq if partition_freq[0].isdigit() else f"1{partition_freq}")))
    rows = active().range(0, n, 1, parts)
    at = F.timestamp_micros(F.lit(int(first.value // 1000)) + F.col("id") * step).cast("timestamp_ntz")
    made = {}
    for c, kind in dtypes.items():
        u = _uniform(c, seed)
        if kind in (float, "float", "f8"):
            made[c] = u * 2 - 1
        elif kind in (int, "int", "i8"):
            # a normal approximation of the Poisson distribution, by the sum of twelve uniforms
            total = sum((_uniform(f"{c}:{k}", seed) for k in range(1, 12)), _uniform(f"{c}:0", seed))
            made[c] = F.greatest(F.round(F.lit(lam) + (total - 6) * F.sqrt(F.lit(lam))), F.lit(0.0)).cast("long")
        else:
            made[c] = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.floor(u * len(NAMES)) + 1).cast("int"))
    return Frame(rows.select(*[v.alias(c) for c, v in made.items()], at.alias(IDX)), list(made), IDX, index_name="timestamp")
