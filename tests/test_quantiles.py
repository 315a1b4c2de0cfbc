"""Exact quantiles of whole columns: the same as by one aggregate, without all values in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.operators import quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]


def columns(spark, n=20000):
    """Spread, repeated, skewed, signed and missing values, whole numbers and decimals."""
    h = F.xxhash64("id")
    return spark.range(0, n, 1, 6).select(
        (h / 1e15).alias("spread"), F.pmod(h, F.lit(7)).cast("int").alias("few"), F.when(F.col("id") % 10 > 0, F.lit(5.0)).otherwise(h / 1e18).alias("most"),
        F.exp(h / 1e18).cast("float").alias("skewed"), F.when(F.pmod(h, F.lit(3)) == 0, F.col("id") - 777).alias("gaps"), (F.pmod(h, F.lit(10**6)) / 100).cast("decimal(12,2)").alias("money"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 3, -float("inf")).when(F.col("id") % 50 == 0, float("nan")).otherwise(h / 1e15).alias("odd"),
    )


def same(got, want):
    for c in want:
        assert (got[c] is None) == (want[c] is None), c
        if want[c] is not None:
            np.testing.assert_array_equal(got[c], want[c], c)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 20000])
def test_like_the_aggregate(spark, n):
    sdf = columns(spark, n)
    want = sdf.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in QS])).alias(c) for c in sdf.columns]).first().asDict()
    same(quantiles.percentiles(sdf, {c: QS for c in sdf.columns}).first().asDict(), want)


def test_exact_whatever_the_sketch_says(spark, monkeypatch):
    sdf = columns(spark, 3000).select("spread", "few", "odd")
    want = sdf.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in QS])).alias(c) for c in sdf.columns]).first().asDict()
    real = F.percentile_approx
    for wrong in (lambda x: x * 0 + 1e9, lambda x: x * 0 - 1e9, lambda x: x * 0.5):
        monkeypatch.setattr(F, "percentile_approx", lambda c, qs, a, wrong=wrong: F.transform(real(c, qs, a), wrong))
        same(quantiles.percentiles(sdf, {c: QS for c in sdf.columns}).first().asDict(), want)


def test_members_gather_no_column(spark):
    sdf = columns(spark)
    d = Frame(sdf.select("spread", "gaps"))
    for out, pick in ((d.spread.median(), "value"), (d.spread.quantile(0.3), "value"), (d.median(), "spread"), (d.quantile(0.3), "spread"), (d.quantile([0.3, 0.6]), "spread"), (d.describe(), "spread")):
        plan = out.sdf._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
        assert out.sdf.select(pick).first()[0] is not None
    want = sdf.agg(F.percentile("spread", F.lit(0.3)), F.median("gaps")).first()
    assert d.spread.quantile(0.3).compute() == want[0] and d.median().compute()["gaps"] == want[1]


def test_one_task_gets_few_of_the_values(spark):
    sdf = columns(spark, 200000).select("spread")
    plan = quantiles.percentiles(sdf, {"spread": [0.5]})
    assert plan.first()["spread"][0] == sdf.agg(F.median("spread")).first()[0]
    metrics, todo = [], [plan._jdf.queryExecution().executedPlan()]
    plan._jdf.queryExecution().executedPlan().executeCollect()
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif name == "Exchange":
            metrics.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert metrics and max(metrics) < 1000


def test_large_groups_like_the_aggregate(spark, monkeypatch):
    sdf = columns(spark, 3000).withColumn("g", F.when(F.col("few") > 4, None).when(F.col("few") < 3, "a").otherwise("b")).withColumn("h", F.when(F.col("gaps").isNull(), F.lit(0.0)).otherwise(F.col("few")))
    names = ["spread", "most", "gaps", "none", "odd"]
    want = {(r.g, r.h): r.asDict() for r in sdf.groupBy("g", "h").agg(*[F.percentile(c, F.lit(0.3)).alias(c) for c in names]).collect()}
    monkeypatch.setattr(quantiles, "LARGE", 200)  # some groups are larger, others aren't
    got = quantiles.grouped(sdf, ["g", "h"], {c: (c, 0.3) for c in names})
    found = got.collect()
    assert len(found) == len(want)
    for r in found:
        same(r, {c: want[r.g, r.h][c] for c in names})
    monkeypatch.setattr(quantiles, "LARGE", 10**6)
    assert quantiles.grouped(sdf, ["g", "h"], {"spread": ("spread", 0.3)}) is None


def test_groups_and_time_bins(spark, monkeypatch):
    sdf = columns(spark, 2000).select("spread", "few", F.timestamp_seconds(F.col("gaps")).cast("timestamp_ntz").alias("at"))
    d, timed = Frame(sdf), Frame(sdf.where("at is not null")).set_index("at")

    def made():
        frames = [d.groupby("few").spread.quantile(0.2).to_frame(), d.groupby("few").agg(a=("spread", "median"), b=("spread", "sum")), d.groupby("few").spread.median().to_frame()]
        frames += [timed[["spread"]].resample("10min").median(), timed.resample("10min").agg({"spread": "median", "few": "max"})]
        plans = [f.sdf._jdf.queryExecution().optimizedPlan().toString() for f in frames]
        return [sorted((str(r) for r in f.sdf.selectExpr(*[f"round({c}, 6)" if t == "double" else c for c, t in f.sdf.dtypes]).collect())) for f in frames], sum("percentile_approx(" in p for p in plans)

    whole, none = made()
    monkeypatch.setattr(quantiles, "LARGE", 100)
    apart, all_of_them = made()
    assert apart == whole and (none, all_of_them) == (0, 5)
