"""The plans that operators make: what reaches the scan, what is shuffled."""

import pytest

import tessera as ts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    def text(frame):
        return frame.spark_frame()._jdf.queryExecution().executedPlan().toString()

    return text


def test_filters_and_columns_reach_the_scan(plan):
    d = ts.read_parquet(f"{FOLDER}/lineitem.parquet")
    out = plan(d[(d.l_quantity > 40) & (d.l_tax < 0.05)][["l_orderkey"]])
    assert "GreaterThan(l_quantity,40.0)" in out and "LessThan(l_tax,0.05)" in out
    assert "l_comment" not in out.split("ReadSchema")[1] and "l_discount" not in out.split("ReadSchema")[1]


def test_sorted_head_is_a_top_k(plan):
    d = ts.read_parquet(f"{FOLDER}/orders.parquet")
    assert "TakeOrderedAndProject" in plan(d.sort_values("o_totalprice").head(5, compute=False))
    assert "TakeOrderedAndProject" in plan(d.nlargest(5, "o_totalprice"))


def test_group_by_is_partial_and_shuffles_once(plan):
    out = plan(ts.read_parquet(f"{FOLDER}/lineitem.parquet").groupby("l_suppkey").l_quantity.sum())
    assert "partial_sum" in out and out.count("Exchange hashpartitioning") == 1


def test_running_sums_have_no_single_partition_over_rows(spark, plan):
    d = ts.read_parquet(f"{FOLDER}/events.parquet").set_index("event_id", drop=False)
    out = plan(d.value.cumsum())
    windows = [line for line in out.splitlines() if "Window [" in line and "__seg" in line]
    assert any("[__seg" in line for line in windows)


def test_semi_join_keeps_left_columns():
    orders, customers = ts.read_parquet(f"{FOLDER}/orders.parquet"), ts.read_parquet(f"{FOLDER}/customer.parquet")
    out = orders.merge(customers, "leftsemi", left_on="o_custkey", right_on="c_custkey")
    assert list(out.columns) == list(orders.columns)


def test_ordered_operators_share_their_scans(spark):
    d = ts.read_parquet(f"{FOLDER}/events.parquet").set_index("event_id", drop=False)
    scans = []
    for n in (1, 2, 4):
        out = d
        for i in range(n):
            out = out.assign(**{f"s{i}": d.value.shift(i + 1)})
        plan = out.spark_frame()._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation [") - n)  # one for the rows; the sizes of segments are the same plan for each operator
    assert scans == [1, 1, 1]
    got = out.reset_index(drop=True).compute().sort_values("event_id")
    for i in range(4):
        assert got[f"s{i}"].fillna(-1).tolist() == got.value.shift(i + 1).fillna(-1).tolist()
