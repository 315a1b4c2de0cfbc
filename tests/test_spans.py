"""Windows over spans of time: the same values as window by window, at a cost that doesn't depend on what a span holds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.frame import Frame

N = 500


@pytest.fixture(scope="module")
def times():
    """Dense, sparse and equal times on both sides of 1970, missing and equal values."""
    rng = np.random.default_rng(5)
    seconds = np.concatenate([rng.integers(0, 20000, N // 2), rng.integers(0, 10**6, N // 4), rng.integers(7190, 7210, N - N // 2 - N // 4)])
    at = pd.Timestamp("1969-12-31 22:00") + pd.to_timedelta(np.sort(seconds), unit="s")
    values = rng.normal(1000, 3, N).round(3)
    values[rng.random(N) < 0.1] = np.nan
    values[100:130] = 0.1
    return pd.DataFrame({"i": np.arange(N), "g": rng.integers(0, 3, N), "at": at, "v": values})


@pytest.fixture(scope="module")
def frame(spark, times):
    sdf = spark.createDataFrame(times).select("i", "g", F.col("at").cast("timestamp_ntz").alias("at"), F.nanvl("v", F.lit(None).cast("double")).alias("v"))
    return Frame(sdf.repartition(4)).set_index("at", drop=False)


def made(s):
    return s.base.sdf.select("i", s.col.cast("double").alias("r")).toPandas().sort_values("i").r.to_numpy(float)


def one_by_one(times, window, how, same=None):
    t, span, out = times["at"].to_numpy("datetime64[us]").astype("int64"), pd.Timedelta(window).value // 1000, []
    for j in range(N):
        x = times.v[(t > t[j] - span) & (t <= t[j]) & (True if same is None else same == same[j])].dropna()
        equal = x.nunique() == 1 and len(x) > 1
        out.append(len(x) if how == "count" else np.nan if x.empty or (equal and how in ("skew", "kurt")) else 0.0 if equal and how in ("var", "std") else getattr(x, how)())
    return np.array(out, float)


@pytest.mark.parametrize("window", ["90s", "1h", "30d"])
def test_spans_match_windows_one_by_one(frame, times, window):
    for how in ("sum", "mean", "min", "max", "count", "var", "std", "skew", "kurt"):
        np.testing.assert_allclose(made(getattr(frame.v.rolling(window), how)()), one_by_one(times, window, how), 1e-6, 1e-6, err_msg=how)


def test_spans_within_groups(frame, times):
    np.testing.assert_allclose(made(frame.groupby("g").v.rolling("1h").sum()), one_by_one(times, "1h", "sum", times.g.to_numpy()), 1e-9)


def test_rows_without_a_time_are_one_window(spark):
    sdf = spark.createDataFrame([(0, None, 1.0), (1, None, 2.0), (2, 0, 4.0), (3, 5, 8.0)], "i int, s long, v double").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    assert made(Frame(sdf).set_index("at", drop=False).v.rolling("5s").sum()).tolist() == [3.0, 3.0, 4.0, 8.0]


def test_no_window_is_gone_through_row_by_row(frame):
    for how in ("sum", "mean", "min", "std", "count"):
        s = getattr(frame.v.rolling("1h"), how)()
        plan = s.base.sdf._jdf.queryExecution().executedPlan().toString().lower()
        frames = [part.split(")")[0] for part in plan.split("specifiedwindowframe(")[1:]]
        assert frames and all("unboundedpreceding" in f for f in frames)


def test_one_span_of_all_rows_is_spread(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = frame[frame["i"] > 200].v.rolling("10000d").sum()  # all of these are after 1970, where such a bin starts
        sizes = [r["n"] for r in s.base.sdf.select(s.col.alias("r"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.sum("r")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == N - 201 and max(sizes) < 0.9 * (N - 201)
