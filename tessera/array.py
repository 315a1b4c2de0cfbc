"""N-dimensional arrays as tables of cells: one index column for each axis and a value."""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import nulls
from tessera.session import active


def _axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


class Array:
    def __init__(self, sdf: DataFrame, shape: tuple[int, ...], chunks: tuple[int, ...] | None = None) -> None:
        self.sdf, self.shape, self.chunksize = sdf, tuple(int(x) for x in shape), chunks or tuple(int(x) for x in shape)

    ndim = property(lambda self: len(self.shape))
    size = property(lambda self: math.prod(self.shape))
    numblocks = property(lambda self: tuple(math.ceil(s / c) if c else 0 for s, c in zip(self.shape, self.chunksize, strict=True)))
    npartitions = property(lambda self: math.prod(self.numblocks))
    dtype = property(lambda self: self.sdf.schema["v"].dataType)
    T = property(lambda self: self.transpose())

    @property
    def chunks(self) -> tuple:
        return tuple(tuple(min(c, s - k) for k in range(0, s, c)) for s, c in zip(self.shape, self.chunksize, strict=True))

    def compute(self) -> np.ndarray:
        rows = self.sdf.toPandas()
        out = np.zeros(self.shape)
        out[tuple(rows[c].to_numpy() for c in _axes(self.ndim))] = rows["v"].to_numpy(float)
        return out if self.ndim else out[()]

    def persist(self) -> Array:
        return Array(self.sdf.persist(), self.shape, self.chunksize)

    def optimize(self) -> Array:
        return self

    def rechunk(self, chunks) -> Array:
        """Another block size: the cells of a block share a partition."""
        sizes = (chunks,) * self.ndim if isinstance(chunks, int) else tuple(chunks)
        block = [F.floor(F.col(c) / s) for c, s in zip(_axes(self.ndim), sizes, strict=True)]
        return Array(self.sdf.repartition(*block), self.shape, sizes)

    def transpose(self, axes=None) -> Array:
        axes = tuple(axes) if axes else tuple(reversed(range(self.ndim)))
        moved = [F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(axes)]
        return Array(self.sdf.select(*moved, "v"), tuple(self.shape[a] for a in axes), tuple(self.chunksize[a] for a in axes))

    def __getitem__(self, key) -> Array:
        key = key if isinstance(key, tuple) else (key,)
        key = (*key, *[slice(None)] * (self.ndim - len(key)))
        tests, columns, shape = [], [], []
        for k, (part, n) in enumerate(zip(key, self.shape, strict=True)):
            c = F.col(f"i{k}")
            if isinstance(part, int):
                tests.append(c == part % n)
                continue
            start, stop, step = part.indices(n)
            if step <= 0:
                raise NotImplementedError("positive steps only")
            tests.append((c >= start) & (c < stop) & ((c - start) % step == 0))
            columns.append(((c - start) / step).cast("long").alias(f"i{len(columns)}"))
            shape.append(len(range(start, stop, step)))
        return Array(self.sdf.where(reduce(operator.and_, tests)).select(*columns, "v"), tuple(shape))

    def _with(self, other, f) -> Array:
        if not isinstance(other, Array):
            return Array(self.sdf.withColumn("v", f(F.col("v"), nulls.lit(other))), self.shape, self.chunksize)
        shape = np.broadcast_shapes(self.shape, other.shape)
        n = len(shape)

        def placed(a: Array, name: str):
            """Axes counted from the last; those of length one meet every label."""
            lead = n - a.ndim
            return a.sdf.select(*[F.col(f"i{k}").alias(f"{name}{k + lead}") for k in range(a.ndim)], F.col("v").alias(f"{name}v")), {k + lead for k in range(a.ndim) if a.shape[k] == shape[k + lead]}

        (a, own_a), (b, own_b) = placed(self, "a"), placed(other, "b")
        shared = [F.col(f"a{k}") == F.col(f"b{k}") for k in own_a & own_b]
        if shared:
            joined = a.join(b, reduce(operator.and_, shared))
        else:
            joined = a.crossJoin(b)  # what broadcasting asks for: each cell with each
        axes = [F.col(f"a{k}" if k in own_a else f"b{k}").alias(f"i{k}") for k in range(n)]
        return Array(joined.select(*axes, f(F.col("av"), F.col("bv")).alias("v")), shape)

    def map_blocks(self, f) -> Array:
        """A Column function of the values."""
        return Array(self.sdf.withColumn("v", f(F.col("v"))), self.shape, self.chunksize)

    def _reduce(self, cell, axis=None, keepdims: bool = False) -> Array:
        gone = set(range(self.ndim)) if axis is None else {a % self.ndim for a in ((axis,) if isinstance(axis, int) else axis)}
        kept = [k for k in range(self.ndim) if k not in gone]
        made = self.sdf.groupBy(*[f"i{k}" for k in kept]).agg(cell(F.col("v")).alias("v"))
        if keepdims:
            axes = [(F.lit(0).cast("long") if k in gone else F.col(f"i{k}")).alias(f"i{k}") for k in range(self.ndim)]
            return Array(made.select(*axes, "v"), tuple(1 if k in gone else s for k, s in enumerate(self.shape)))
        return Array(made.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)], "v"), tuple(self.shape[k] for k in kept))

    def moment(self, order: int, axis=None, ddof: int = 0, keepdims: bool = False) -> Array:
        centred = self - self.mean(axis, True)
        total = centred.map_blocks(lambda c: F.pow(c, F.lit(order)))
        return total._reduce(lambda c: F.sum(c) / (F.count(c) - ddof), axis, keepdims)

    def argmin(self, axis: int = 0, keepdims: bool = False) -> Array:
        return self._reduce_at(axis, False)

    def argmax(self, axis: int = 0, keepdims: bool = False) -> Array:
        return self._reduce_at(axis, True)

    def _reduce_at(self, axis: int, largest: bool) -> Array:
        place, value = F.col(f"i{axis % self.ndim}"), -F.col("v") if largest else F.col("v")
        return self._reduce(lambda c: F.min_by(place, F.struct(value, place)), axis)

    def dot(self, other: Array) -> Array:
        """The contraction of the last axis with the other's first."""
        a = self.sdf.select(*[F.col(f"i{k}").alias(f"a{k}") for k in range(self.ndim)], F.col("v").alias("av"))
        b = other.sdf.select(*[F.col(f"i{k}").alias(f"b{k}") for k in range(other.ndim)], F.col("v").alias("bv"))
        left, right = [f"a{k}" for k in range(self.ndim - 1)], [f"b{k}" for k in range(1, other.ndim)]
        made = a.join(b, F.col(f"a{self.ndim - 1}") == F.col("b0")).groupBy(*left, *right).agg(F.sum(F.col("av") * F.col("bv")).alias("v"))
        return Array(made.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate([*left, *right])], "v"), (*self.shape[:-1], *other.shape[1:]))

    __matmul__ = dot


def _install() -> None:
    for name, f in {"add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": nulls.divide, "floordiv": nulls.floordiv, "pow": F.pow, "mod": nulls.mod}.items():
        setattr(Array, f"__{name}__", lambda self, other, f=f: self._with(other, f))
        setattr(Array, f"__r{name}__", lambda self, other, f=f: self._with(other, lambda a, b: f(b, a)))
    cells = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg, "any": lambda c: F.bool_or(c.cast("boolean")), "all": lambda c: F.bool_and(c.cast("boolean"))}
    for name, cell in cells.items():
        setattr(Array, name, lambda self, axis=None, keepdims=False, cell=cell: self._reduce(cell, axis, keepdims))
    spread = {"var": lambda c, d: nulls.variance(c, d), "std": lambda c, d: F.sqrt(nulls.variance(c, d))}
    for name, cell in spread.items():
        setattr(Array, name, lambda self, axis=None, ddof=0, keepdims=False, cell=cell: self._reduce(lambda c: cell(c, ddof), axis, keepdims))
    present = lambda c: F.when(~F.isnan(c), c)
    for name in ("sum", "mean"):
        setattr(Array, f"nan{name}", lambda self, axis=None, keepdims=False, name=name: self._reduce(lambda c: F.coalesce(F.sum(present(c)), F.lit(0.0)) if name == "sum" else F.avg(present(c)), axis, keepdims))
    for name, cell in spread.items():
        setattr(Array, f"nan{name}", lambda self, axis=None, ddof=0, keepdims=False, cell=cell: self._reduce(lambda c: cell(present(c), ddof), axis, keepdims))


_install()


def _cells(shape: tuple[int, ...], value) -> Array:
    """An array made from its flat positions inside the engine."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    flat, axes, stride = F.col("id"), [], 1
    for k in reversed(range(len(shape))):
        axes.insert(0, F.pmod(F.floor(flat / stride), F.lit(max(shape[k], 1))).cast("long").alias(f"i{k}"))
        stride *= shape[k]
    return Array(active().range(math.prod(shape)).select(*axes, value.alias("v")), shape)


def from_array(x, chunks=None) -> Array:
    x = np.asarray(x, float)
    import pyarrow as pa

    at = np.indices(x.shape).reshape(x.ndim, -1)
    table = pa.table({**{f"i{k}": at[k] for k in range(x.ndim)}, "v": x.ravel()})
    out = Array(active().createDataFrame(table), x.shape)
    return out.rechunk(chunks) if chunks else out


asarray = from_array


def ones(shape, **_) -> Array:
    return _cells(shape, F.lit(1.0))


def zeros(shape, **_) -> Array:
    return _cells(shape, F.lit(0.0))


empty = zeros


def arange(start, stop=None, step=1, **_) -> Array:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return _cells((n,), F.lit(start) + F.col("id") * step)


def linspace(start, stop, num=50, endpoint=True, **_) -> Array:
    step = (stop - start) / (num - 1 if endpoint and num > 1 else num)
    return _cells((num,), F.lit(float(start)) + F.col("id") * step)


class Generator:
    """Random arrays; a cell depends on the seed and its position alone."""

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.calls = seed, 0

    def _uniform(self, salt: int = 0):
        return (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.calls), F.lit(salt), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)

    def _draw(self, size, value) -> Array:
        out = _cells(size, value)
        self.calls += 1
        return out

    def random(self, size, **_) -> Array:
        return self._draw(size, self._uniform())

    def uniform(self, low=0.0, high=1.0, size=1, **_) -> Array:
        return self._draw(size, self._uniform() * (high - low) + low)

    def normal(self, loc=0.0, scale=1.0, size=1, **_) -> Array:
        z = F.sqrt(F.lit(-2.0) * F.ln(self._uniform())) * F.cos(F.lit(2 * math.pi) * self._uniform(1))
        return self._draw(size, z * scale + loc)

    def standard_normal(self, size=1, **_) -> Array:
        return self.normal(size=size)

    def integers(self, low, high=None, size=1, **_) -> Array:
        low, high = (0, low) if high is None else (low, high)
        return self._draw(size, F.floor(self._uniform() * (high - low)) + low)

    def exponential(self, scale=1.0, size=1, **_) -> Array:
        return self._draw(size, -F.ln(self._uniform()) * scale)

    def choice(self, a, size=1, **_) -> Array:
        values = list(range(a)) if isinstance(a, int) else list(a)
        return self._draw(size, F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.floor(self._uniform() * len(values)) + 1).cast("int")))

    def __getattr__(self, name: str):
        """Any other distribution of NumPy's generator: drawn in Python, each cell from its own seeded stream."""
        if name.startswith("_") or not hasattr(np.random.Generator, name):
            raise AttributeError(name)

        def draw(*args, size=1, **kwargs) -> Array:
            import pandas as pd

            seed, call = self.seed, self.calls

            @F.pandas_udf("double")
            def run(ids: pd.Series) -> pd.Series:
                return ids.map(lambda i: float(np.atleast_1d(getattr(np.random.default_rng([seed, call, int(i)]), name)(*args, **kwargs)).ravel()[0]))

            return self._draw(size, run(F.col("id")))

        return draw


def default_rng(seed: int = 0) -> Generator:
    return Generator(seed)


class RandomState(Generator):
    """The same draws under the older names."""

    def random_sample(self, size=1, **_) -> Array:
        return self.random(size)

    def rand(self, *size) -> Array:
        return self.random(size or 1)

    def randn(self, *size) -> Array:
        return self.normal(size=size or 1)

    def randint(self, low, high=None, size=1, **_) -> Array:
        return self.integers(low, high, size)

    def seed_with(self, seed: int) -> None:
        self.seed, self.calls = seed, 0
