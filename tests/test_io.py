import pandas as pd
import pytest

import tessera as ts

PDF = pd.DataFrame({"a": [1, 2, 3], "b": ["x", None, "z"], "c": [1.5, 2.5, None]})


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_round_trips(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    getattr(ts.from_pandas(PDF), f"to_{kind}")(path)
    out = getattr(ts, f"read_{kind}")(path)[["a", "b", "c"]].compute().sort_values("a").reset_index(drop=True)
    pd.testing.assert_frame_equal(out.astype({"a": "int64"}), PDF, check_dtype=False)


def test_parquet_partitions_append_and_index(spark, tmp_path):
    path = str(tmp_path / "p")
    f = ts.from_pandas(PDF)
    f.to_parquet(path, partition_on="b")
    f.to_parquet(path, append=True, partition_on="b")
    assert len(ts.read_parquet(path)) == 6
    assert ts.read_parquet(path, index="a", columns=["c"]).compute().index.name == "a"
    assert len(ts.read_parquet(path, filters=[("a", ">", 2)])) == 2


def test_fixed_width_and_tables(spark, tmp_path):
    (tmp_path / "w.txt").write_text("aa bb\n 1  x\n 2  y\n")
    out = ts.read_fwf(str(tmp_path / "w.txt"), widths=[2, 3]).compute()
    assert out["aa"].tolist() == ["1", "2"] and out["bb"].tolist() == ["x", "y"]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert ts.read_table(str(tmp_path / "t.tsv")).compute()["a"].tolist() == [1]


def test_makers(spark):
    assert ts.from_dict({"a": [1, 2]}).compute()["a"].tolist() == [1, 2]
    out = ts.from_map(lambda k: pd.DataFrame({"v": [k, k * 10]}), [1, 2], meta="v long").compute()
    assert sorted(out["v"]) == [1, 2, 10, 20]
    s = ts.timeseries("2000-01-01", "2000-01-02", "1h")
    assert len(s) == 24 and s[["x"]].compute().equals(ts.timeseries("2000-01-01", "2000-01-02", "1h", dtypes={"x": float}).compute())
    assert ts.from_pandas(pd.Series([1.0, None], name="s")).count().compute() == 1


def test_scalars_are_lazy(spark):
    f = ts.from_pandas(PDF)
    total = f.a.sum()
    with pytest.raises(TypeError):
        bool(total)
    assert (f.a / total).compute().tolist() == [1 / 6, 2 / 6, 3 / 6]
    assert (total + 1).compute() == 7


def test_streams(spark):
    from tessera.plans import catalog

    assert catalog.queries()["stream_tumbling"](spark, "/root/testdata/sf0.001").count() > 0
