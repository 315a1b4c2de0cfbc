"""NumPy's universal functions over Series as Column expressions."""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera import nulls

UNARY = {
    "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": F.ln, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "absolute": F.abs, "fabs": F.abs, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"),
    "rint": lambda c: F.bround(c, 0), "trunc": lambda c: F.signum(c) * F.floor(F.abs(c)), "sign": F.signum, "square": lambda c: c * c, "negative": lambda c: -c, "positive": lambda c: c, "reciprocal": lambda c: nulls.divide(F.lit(1.0), c),
    "deg2rad": F.radians, "radians": F.radians, "rad2deg": F.degrees, "degrees": F.degrees, "cbrt": F.cbrt, "isnan": lambda c: c.isNull() | F.isnan(c.cast("double")), "isfinite": lambda c: nulls.known((F.abs(c) < float("inf")) & ~F.isnan(c.cast("double"))),
    "isinf": lambda c: nulls.known(F.abs(c) == float("inf")), "logical_not": lambda c: c == 0, "signbit": lambda c: c < 0, "invert": F.bitwise_not,
}
PARTIAL = {"sqrt", "log", "log2", "log10", "log1p", "arcsin", "arccos", "arccosh", "arctanh"}
BINARY = {
    "add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": nulls.divide, "true_divide": nulls.divide, "floor_divide": nulls.floordiv, "remainder": nulls.mod, "mod": nulls.mod, "power": F.pow, "float_power": F.pow,
    "maximum": F.greatest, "minimum": F.least, "fmax": F.greatest, "fmin": F.least, "arctan2": F.atan2, "hypot": F.hypot, "copysign": lambda a, b: F.when(b < 0, -F.abs(a)).otherwise(F.abs(a)), "fmod": lambda a, b: F.try_mod(a, b),
    "logaddexp": lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))), "logaddexp2": lambda a, b: F.greatest(a, b) + F.log2(F.lit(1) + F.pow(F.lit(2.0), -F.abs(a - b))),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
}
TRUTH = {"greater": operator.gt, "greater_equal": operator.ge, "less": operator.lt, "less_equal": operator.le, "equal": operator.eq, "not_equal": operator.ne, "logical_and": lambda a, b: (a != 0) & (b != 0), "logical_or": lambda a, b: (a != 0) | (b != 0), "logical_xor": lambda a, b: (a != 0) != (b != 0)}


def apply(ufunc: np.ufunc, method: str, inputs: tuple, kwargs: dict):
    from tessera.series import Series

    if method != "__call__" or ufunc.nout != 1 or kwargs.get("out"):
        raise NotImplementedError(f"{ufunc.__name__}.{method}")
    name = ufunc.__name__
    first = next(x for x in inputs if isinstance(x, Series))
    if name in UNARY:
        made = UNARY[name](first.col)
        # what has no value is missing, not a number that aggregates would count
        return first._new(F.nanvl(made, F.lit(None).cast("double")) if name in PARTIAL else made)
    if name in BINARY or name in TRUTH:
        f = BINARY.get(name) or TRUTH[name]
        a, b = inputs
        if isinstance(a, Series):
            return a._with(b, f, truth=name in TRUTH)
        return b._with(a, lambda x, y: f(y, x), truth=name in TRUTH)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(ufunc(s.to_numpy()))

    return first._new(run(first.col))
