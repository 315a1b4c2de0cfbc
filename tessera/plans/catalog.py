"""The registered queries: each operator over the driver's tables, beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera as ts
from tessera.frame import Frame, Scalar, Series

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder as Frames."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __getattr__(self, name: str) -> Frame:
        return ts.read_parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], object]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(folder))
            if isinstance(out, Scalar):
                return out.sdf
            return out if isinstance(out, DataFrame) else out.spark_frame()

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return register


def rounded(frame, digits: int = 4) -> DataFrame:
    """Floating results to a few digits, as sums depend on the order of their terms."""
    sdf = frame if isinstance(frame, DataFrame) else frame.spark_frame()
    return sdf.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in sdf.dtypes])


def _indexed(t: Tables) -> Frame:
    return t.events.set_index("event_id", drop=False)


# -- scans and selections
query("flagship", """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 4) as avg_qty,
  count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")(
    lambda t: t.lineitem.query("l_shipdate <= @day", {"day": np.datetime64("1998-09-02").astype("datetime64[us]").item()}).assign(disc=lambda d: d.l_extendedprice * (1 - d.l_discount)).spark_frame()
    .groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum("disc"), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))
)
query("scan_columns_filters", "select o_orderkey, o_totalprice from orders where (o_totalprice > 300000 and o_orderstatus = 'O') or o_orderpriority in ('1-URGENT')")(
    lambda t: ts.read_parquet(f"{t.folder}/orders.parquet", filters=[[("o_totalprice", ">", 300000), ("o_orderstatus", "==", "O")], [("o_orderpriority", "in", ["1-URGENT"])]])[["o_orderkey", "o_totalprice"]]
)
query("projection", "select l_orderkey, l_quantity from lineitem")(lambda t: t.lineitem[["l_orderkey", "l_quantity"]])
query("filter_common_factor", "select l_orderkey, l_linenumber from lineitem where (l_quantity > 40 and l_tax < 0.05) or (l_quantity > 40 and l_discount < 0.02)")(
    lambda t: (lambda d: d[((d.l_quantity > 40) & (d.l_tax < 0.05)) | ((d.l_quantity > 40) & (d.l_discount < 0.02))][["l_orderkey", "l_linenumber"]])(t.lineitem)
)
query("query_expression", "select o_orderkey from orders where o_totalprice > 200000 and o_orderstatus in ('F', 'P')")(lambda t: t.orders.query("o_totalprice > @least and o_orderstatus in ['F', 'P']", {"least": 200000})[["o_orderkey"]])
query("eval_assign", "select p_partkey, p_retailprice * 2 + p_size as v from part")(lambda t: t.part.eval("v = p_retailprice * 2 + p_size")[["p_partkey", "v"]])
query("assign_chain", "select c_custkey, c_acctbal * 2 as a, c_acctbal * 2 + 1 as b from customer")(lambda t: t.customer.assign(a=lambda d: d.c_acctbal * 2, b=lambda d: d.a + 1)[["c_custkey", "a", "b"]])
query("drop_rename", "select n_nationkey as \"key\", n_name as name from nation")(lambda t: t.nation.drop(columns=["n_regionkey"]).rename(columns={"n_nationkey": "key", "n_name": "name"}))
query("add_prefix_suffix", "select r_regionkey as x_r_regionkey_y, r_name as x_r_name_y from region")(lambda t: t.region.add_prefix("x_").add_suffix("_y"))
query("select_dtypes", "select s_suppkey, s_nationkey, s_acctbal from supplier")(lambda t: t.supplier.select_dtypes("number"))
query("reset_index", "select row_number() over (order by c_custkey) - 1 as n, c_custkey from customer where c_acctbal > 0")(
    lambda t: (lambda f: f.sdf.select(F.col("__idx").alias("n"), "c_custkey"))(t.customer.query("c_acctbal > 0").set_index("c_custkey", drop=False)[["c_custkey"]].reset_index(drop=True))
)
query("explode", "select p_partkey, unnest(string_split(p_type, ' ')) as word from part")(lambda t: t.part.assign(word=lambda d: d.p_type.str.split(" "))[["p_partkey", "word"]].explode("word"))
query("melt", "select s_suppkey, unnest(['s_nationkey', 's_acctbal']) as variable, unnest([s_nationkey::double, s_acctbal]) as value from supplier")(lambda t: t.supplier.astype({"s_nationkey": "double"}).melt(["s_suppkey"], ["s_nationkey", "s_acctbal"]))

# -- elementwise
query("arithmetic", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_quantity - 10 as less, -l_tax as neg from lineitem")(
    lambda t: t.lineitem.assign(net=lambda d: d.l_extendedprice * (1 - d.l_discount), less=lambda d: d.l_quantity - 10, neg=lambda d: -d.l_tax)[["l_orderkey", "l_linenumber", "net", "less", "neg"]]
)
query("floordiv_mod", "select c_custkey, floor((c_custkey - 70) / 7)::bigint as q, (c_custkey - 70) - 7 * floor((c_custkey - 70) / 7)::bigint as r from customer")(
    lambda t: t.customer.assign(q=lambda d: (d.c_custkey - 70) // 7, r=lambda d: (d.c_custkey - 70) % 7)[["c_custkey", "q", "r"]]
)
query("division_by_zero", "select s_suppkey, case when s_suppkey % 3 = 0 then (case when s_acctbal > 0 then 'inf' else '-inf' end) else 'finite' end as kind from supplier where s_acctbal <> 0")(
    lambda t: t.supplier.query("s_acctbal != 0").assign(v=lambda d: d.s_acctbal / (d.s_suppkey % 3)).spark_frame().select("s_suppkey", F.when(F.col("v") == float("inf"), "inf").when(F.col("v") == float("-inf"), "-inf").otherwise("finite").alias("kind"))
)
query("power_abs", "select p_partkey, pow(p_size, 2)::double as p, abs(p_size - 25) as a from part")(lambda t: t.part.assign(p=lambda d: d.p_size**2, a=lambda d: (d.p_size - 25).abs())[["p_partkey", "p", "a"]])
query("round_half_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) as r from lineitem")(lambda t: t.lineitem.assign(r=lambda d: (d.l_quantity / 4).round())[["l_orderkey", "l_linenumber", "r"]])
query("boolean_logic", "select o_orderkey, (o_totalprice > 100000) <> (o_orderstatus = 'O') as x, not (o_orderstatus = 'F') as n from orders")(
    lambda t: t.orders.assign(x=lambda d: (d.o_totalprice > 100000) ^ (d.o_orderstatus == "O"), n=lambda d: ~(d.o_orderstatus == "F"))[["o_orderkey", "x", "n"]]
)
query("clip_between", "select s_suppkey, least(greatest(s_acctbal, 0), 5000)::double as c, s_acctbal >= 0 and s_acctbal < 5000 as b from supplier")(
    lambda t: t.supplier.assign(c=lambda d: d.s_acctbal.clip(0.0, 5000.0), b=lambda d: d.s_acctbal.between(0, 5000, "left"))[["s_suppkey", "c", "b"]]
)
query("isin", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")(lambda t: (lambda d: d[d.c_mktsegment.isin(["BUILDING", "MACHINERY"])][["c_custkey"]])(t.customer))
query("isin_series", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")(
    lambda t: (lambda d: d[d.o_custkey.isin(t.customer.query("c_acctbal < 0").c_custkey)][["o_orderkey"]])(t.orders)
)
query("missing_values", "select event_id, case when value > 50 then value end as v, (case when value > 50 then value end) is null as n, coalesce(case when value > 50 then value end, -1) as f from events")(
    lambda t: t.events.assign(v=lambda d: d.value.where(d.value > 50), n=lambda d: d.v.isna(), f=lambda d: d.v.fillna(-1.0))[["event_id", "v", "n", "f"]]
)
query("dropna", "select event_id from events where value > 50")(lambda t: t.events.assign(v=lambda d: d.value.where(d.value > 50)).dropna(subset=["v"])[["event_id"]])
query("mask_where", "select c_custkey, case when c_acctbal < 0 then 0 else c_acctbal end as m from customer")(lambda t: t.customer.assign(m=lambda d: d.c_acctbal.mask(d.c_acctbal < 0, 0.0))[["c_custkey", "m"]])
query("case_when", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else p_brand end as k from part")(
    lambda t: t.part.assign(k=lambda d: d.p_brand.case_when([(d.p_size < 10, "small"), (d.p_size < 30, "medium")]))[["p_partkey", "k"]]
)
query("replace", "select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else o_orderstatus end as s from orders")(lambda t: t.orders.assign(s=lambda d: d.o_orderstatus.replace({"O": "open", "F": "done"}))[["o_orderkey", "s"]])
query("astype", "select p_partkey, p_size::double as d, p_size::varchar as s from part")(lambda t: t.part.assign(d=lambda x: x.p_size.astype(float), s=lambda x: x.p_size.astype(str))[["p_partkey", "d", "s"]])
query("to_numeric_coerce", "select p_partkey, try_cast(split_part(p_brand, '#', 2) as double) as n from part")(lambda t: t.part.assign(n=lambda d: ts.to_numeric(d.p_brand.str.rsplit("#", 1).str.get(1), "coerce"))[["p_partkey", "n"]])
query("map_dict", "select o_orderkey, case o_orderstatus when 'O' then 1 when 'F' then 2 end as code from orders")(lambda t: t.orders.assign(code=lambda d: d.o_orderstatus.map({"O": 1, "F": 2}))[["o_orderkey", "code"]])
query("map_series", "select s_suppkey, n_name as nation from supplier left join nation on s_nationkey = n_nationkey")(lambda t: t.supplier.assign(nation=lambda d: d.s_nationkey.map(t.nation.set_index("n_nationkey").n_name))[["s_suppkey", "nation"]])
query("combine_first", "select event_id, case when value > 50 then value else user_id end::double as v from events")(lambda t: t.events.assign(v=lambda d: d.value.where(d.value > 50).combine_first(d.user_id.astype(float)))[["event_id", "v"]])
query("row_reductions", "select p_partkey, round(p_size + p_retailprice, 4) as s, round((p_size + p_retailprice) / 2, 4) as m, greatest(p_size, p_retailprice)::double as x from part")(
    lambda t: rounded(t.part.assign(s=lambda d: d[["p_size", "p_retailprice"]].sum(axis=1), m=lambda d: d[["p_size", "p_retailprice"]].mean(axis=1), x=lambda d: d[["p_size", "p_retailprice"]].max(axis=1))[["p_partkey", "s", "m", "x"]])
)
query("ufuncs", "select p_partkey, round(sqrt(p_retailprice), 6) as s, round(ln(p_retailprice), 6) as l, greatest(p_size, 25) as m from part")(
    lambda t: rounded(t.part.assign(s=lambda d: np.sqrt(d.p_retailprice), l=lambda d: np.log(d.p_retailprice), m=lambda d: np.maximum(d.p_size, 25))[["p_partkey", "s", "l", "m"]], 6)
)
query("apply_rows", "select s_suppkey, s_suppkey * 2.0 + s_nationkey as v from supplier")(lambda t: t.supplier.assign(v=lambda d: d[["s_suppkey", "s_nationkey"]].apply(lambda r: r.s_suppkey * 2.0 + r.s_nationkey, axis=1))[["s_suppkey", "v"]])
query("map_partitions", "select s_suppkey, s_acctbal + 1 as b from supplier")(lambda t: t.supplier.map_partitions(lambda p: p.assign(b=p.s_acctbal + 1)[["s_suppkey", "b"]], meta="s_suppkey long, b double"))

# -- joins
query("merge_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")(lambda t: t.orders.merge(t.customer, left_on="o_custkey", right_on="c_custkey")[["o_orderkey", "c_name"]])
query("merge_left", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")(lambda t: t.customer.merge(t.orders, "left", left_on="c_custkey", right_on="o_custkey")[["c_custkey", "o_orderkey"]])
query("merge_right", "select c_custkey, o_orderkey from (select * from customer where c_acctbal > 0) right join orders on o_custkey = c_custkey")(lambda t: t.customer.query("c_acctbal > 0").merge(t.orders, "right", left_on="c_custkey", right_on="o_custkey")[["c_custkey", "o_orderkey"]])
query("merge_outer_indicator", """select coalesce(n_nationkey, s_nationkey) as k, case when s_suppkey is null then 'left_only' when n_name is null then 'right_only' else 'both' end as m
  from (select * from nation where n_regionkey < 3) full join supplier on n_nationkey = s_nationkey""")(
    lambda t: t.nation.query("n_regionkey < 3").rename(columns={"n_nationkey": "k"}).merge(t.supplier.rename(columns={"s_nationkey": "k"}), "outer", on="k", indicator=True)[["k", "_merge"]].rename(columns={"_merge": "m"})
)
query("merge_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")(lambda t: t.customer.merge(t.orders.query("o_totalprice > 200000"), "leftsemi", left_on="c_custkey", right_on="o_custkey")[["c_custkey"]])
query("merge_suffixes", "select a.n_nationkey as k, a.n_name as n_name_x, b.n_name as n_name_y from nation a join nation b on a.n_nationkey = b.n_nationkey")(
    lambda t: (lambda n: n.merge(n, on="k"))(t.nation[["n_nationkey", "n_name"]].rename(columns={"n_nationkey": "k"}))
)
query("join_index", "select s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey")(lambda t: t.supplier.join(t.nation.set_index("n_nationkey"), on="s_nationkey")[["s_suppkey", "s_name", "n_name"]])
query("merge_five_tables", """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
  join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by n_name""")(
    lambda t: rounded(
        t.customer.merge(t.orders, left_on="c_custkey", right_on="o_custkey").merge(t.lineitem, left_on="o_orderkey", right_on="l_orderkey").merge(t.supplier, left_on=["l_suppkey", "c_nationkey"], right_on=["s_suppkey", "s_nationkey"])
        .merge(t.nation, left_on="s_nationkey", right_on="n_nationkey").assign(revenue=lambda d: d.l_extendedprice * (1 - d.l_discount)).groupby("n_name").revenue.sum().to_frame(), 2)
)
_PURCHASES = "(select event_id as e, ts, user_id, value as price from events where event_type = 'purchase')"
for _direction, _op, _pick in (("backward", "<=", "desc"), ("forward", ">=", "asc")):
    query(f"merge_asof_{_direction}", f"""select event_id, (select price from {_PURCHASES} p where p.user_id = v.user_id and p.ts {_op} v.ts order by p.ts {_pick} limit 1) as price from events v where event_type = 'view' or event_type = 'click'""")(
        lambda t, d=_direction: ts.merge_asof(t.events.query("event_type in ['view', 'click']"), t.events.query("event_type == 'purchase'").rename(columns={"value": "price", "event_id": "e"})[["ts", "user_id", "price"]], on="ts", by="user_id", direction=d)[["event_id", "price"]]
    )
query("merge_asof_global", f"select event_id, (select price from {_PURCHASES} p where p.ts < v.ts order by p.ts desc limit 1) as price from events v where event_type = 'click'")(
    lambda t: ts.merge_asof(t.events.query("event_type == 'click'")[["event_id", "ts"]], t.events.query("event_type == 'purchase'").rename(columns={"value": "price"})[["ts", "price"]], on="ts", allow_exact_matches=False)[["event_id", "price"]]
)
query("align_series", "select coalesce(a.k, b.k) as k, a.v + b.v as s from (select s_suppkey as k, s_acctbal as v from supplier where s_suppkey % 2 = 0) a full join (select s_suppkey as k, s_nationkey as v from supplier where s_suppkey % 3 = 0) b on a.k = b.k")(
    lambda t: (t.supplier.query("s_suppkey % 2 == 0").set_index("s_suppkey").s_acctbal + t.supplier.query("s_suppkey % 3 == 0").set_index("s_suppkey").s_nationkey).to_frame("s").sdf.select(F.col("__idx").alias("k"), "s")
)
query("concat_rows", "select c_custkey as k, c_acctbal as b from customer union all select s_suppkey, s_acctbal from supplier")(
    lambda t: ts.concat([t.customer[["c_custkey", "c_acctbal"]].set_columns(["k", "b"]), t.supplier[["s_suppkey", "s_acctbal"]].set_columns(["k", "b"])])
)
query("concat_columns", "select coalesce(a.n_nationkey, b.s_suppkey) as k, n_name, s_name from nation a full join supplier b on a.n_nationkey = b.s_suppkey")(
    lambda t: ts.concat([t.nation.set_index("n_nationkey")[["n_name"]], t.supplier.set_index("s_suppkey")[["s_name"]]], axis=1).sdf.select(F.col("__idx").alias("k"), "n_name", "s_name")
)

# -- reductions
_PART = ["p_size", "p_retailprice"]
query("reduce_sum_mean", "select round(sum(l_quantity), 2) as q, round(sum(l_tax), 4) as t from lineitem")(lambda t: rounded(t.lineitem[["l_quantity", "l_tax"]].rename(columns={"l_quantity": "q", "l_tax": "t"}).sum()))
query("reduce_min_max", "select min(o_totalprice) as o_totalprice, min(o_custkey) as o_custkey from orders union all select max(o_totalprice), max(o_custkey) from orders")(
    lambda t: (lambda d: d.min().sdf.unionByName(d.max().sdf))(t.orders[["o_totalprice", "o_custkey"]])
)
query("reduce_var_std", "select round(var_samp(p_size), 6) as p_size, round(var_samp(p_retailprice), 6) as p_retailprice from part")(lambda t: rounded(t.part[_PART].var(), 6))
query("reduce_sem", "select round(stddev_samp(p_size) / sqrt(count(p_size)), 8) as value from part")(lambda t: rounded(t.part.p_size.sem().sdf, 8))
query("reduce_skew", "select round((avg(pow(x - m, 3))) / pow(avg(pow(x - m, 2)), 1.5), 6) as value from (select l_extendedprice as x, avg(l_extendedprice) over () as m from lineitem)")(lambda t: rounded(t.lineitem.l_extendedprice.skew().sdf, 6))
query("reduce_kurtosis", "select round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 6) as value from (select p_retailprice as x, avg(p_retailprice) over () as m from part)")(lambda t: rounded(t.part.p_retailprice.kurtosis().sdf, 6))
query("reduce_any_all", "select bool_or(s_acctbal > 9000) as a, bool_and(s_acctbal > -1000) as b from supplier")(lambda t: (lambda d: d.sdf.select(d.any()["a"].column.alias("a"), d.all()["b"].column.alias("b")).limit(1))(t.supplier.assign(a=lambda d: d.s_acctbal > 9000, b=lambda d: d.s_acctbal > -1000)[["a", "b"]]))
query("reduce_prod", "select product(r_regionkey + 1)::double as value from region")(lambda t: (t.region.r_regionkey + 1).prod())
query("reduce_nunique", "select count(distinct p_brand) as p_brand, count(distinct p_type) as p_type from part")(lambda t: t.part[["p_brand", "p_type"]].nunique())
query("reduce_nunique_approx")(lambda t: t.lineitem[["l_partkey", "l_suppkey"]].nunique_approx())
query("reduce_idxmax", "select c_custkey as value from customer order by c_acctbal desc, c_custkey limit 1")(lambda t: t.customer.set_index("c_custkey").c_acctbal.idxmax())
query("reduce_cov_corr", "select round(covar_samp(l_quantity, l_extendedprice), 4) as c, round(corr(l_quantity, l_extendedprice), 8) as r from lineitem")(
    lambda t: (lambda d: d.sdf.limit(1).select(F.round(d.l_quantity.cov(d.l_extendedprice).column, 4).alias("c"), F.round(d.l_quantity.corr(d.l_extendedprice).column, 8).alias("r")))(t.lineitem)
)
query("corr_matrix", """select unnest(['p_size', 'p_retailprice']) as variable, unnest([1.0, round(corr(p_size, p_retailprice), 8)])::double as p_size, unnest([round(corr(p_size, p_retailprice), 8), 1.0])::double as p_retailprice from part""")(
    lambda t: rounded(t.part[_PART].corr().sdf.select(F.col("__idx").alias("variable"), *_PART), 8)
)
query("quantiles", "select q as q, round(v, 6) as v from (select unnest([0.1, 0.5, 0.9]) as q, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) as v from orders)")(lambda t: rounded(t.orders[["o_totalprice"]].quantile([0.1, 0.5, 0.9]).sdf.select(F.col("__idx").alias("q"), F.col("o_totalprice").alias("v")), 6))
query("median", "select round(median(l_extendedprice), 6) as value from lineitem")(lambda t: rounded(t.lineitem.l_extendedprice.median().sdf, 6))
query("describe", """select unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) as stat, round(unnest([count(p_retailprice)::double, avg(p_retailprice), stddev_samp(p_retailprice), min(p_retailprice), quantile_cont(p_retailprice, 0.25),
  quantile_cont(p_retailprice, 0.5), quantile_cont(p_retailprice, 0.75), max(p_retailprice)]), 6) as v from part""")(lambda t: rounded(t.part[["p_retailprice"]].describe().sdf.select(F.col("__idx").alias("stat"), F.col("p_retailprice").alias("v")), 6))
query("unique", "select distinct p_brand from part")(lambda t: t.part.p_brand.unique().to_frame())
query("drop_duplicates_first", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")(lambda t: t.orders.set_index("o_orderkey", drop=False)[["o_custkey", "o_orderkey"]].drop_duplicates(subset=["o_custkey"]).spark_frame().select("o_custkey", "o_orderkey"))
query("drop_duplicates_last", "select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey")(lambda t: t.orders.set_index("o_orderkey", drop=False)[["o_custkey", "o_orderkey"]].drop_duplicates(subset=["o_custkey"], keep="last").spark_frame().select("o_custkey", "o_orderkey"))
query("value_counts", "select l_shipmode_like as k, count(*) as n from (select l_returnflag as l_shipmode_like from lineitem) group by 1")(lambda t: t.lineitem.l_returnflag.value_counts().base.sdf.select(F.col("__idx").alias("k"), F.col("count").alias("n")))
query("value_counts_normalize", "select p_brand as k, round(count(*) / sum(count(*)) over (), 8) as v from part group by 1")(lambda t: rounded(t.part.p_brand.value_counts(normalize=True).base.sdf.select(F.col("__idx").alias("k"), F.col("proportion").alias("v")), 8))
query("mode", "select p_size from part group by 1 having count(*) = (select max(n) from (select count(*) as n from part group by p_size))")(lambda t: t.part.p_size.mode().to_frame())
query("nlargest", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")(lambda t: t.orders.set_index("o_orderkey", drop=False).nlargest(10, "o_totalprice").spark_frame().select("o_orderkey", "o_totalprice"))
query("nsmallest", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10")(lambda t: t.orders.set_index("o_orderkey", drop=False).nsmallest(10, "o_totalprice").spark_frame().select("o_orderkey", "o_totalprice"))
query("is_monotonic", "select true as value")(lambda t: t.orders.set_index("o_orderkey", drop=False).o_orderkey.is_monotonic_increasing)
query("pivot_table", "select l_returnflag, round(avg(case when l_linestatus = 'F' then l_quantity end), 6) as F, round(avg(case when l_linestatus = 'O' then l_quantity end), 6) as O from lineitem group by 1")(
    lambda t: rounded(t.lineitem.pivot_table("l_returnflag", "l_linestatus", "l_quantity", "mean").sdf.select(F.col("__idx").alias("l_returnflag"), "F", "O"), 6)
)
query("dot", "select round(sum(l_quantity * l_extendedprice), 2) as value from lineitem")(lambda t: (lambda d: rounded(d.l_quantity.dot(d.l_extendedprice).sdf, 2))(t.lineitem))
query("reduction_custom", "select max(o_totalprice) as m from orders")(lambda t: t.orders[["o_totalprice"]].reduction(lambda p: p.max().to_frame().T.set_axis(["m"], axis=1), lambda p: p.max().to_frame().T, meta="m double"))

# -- group-by
for _how, _cell in {"sum": "sum(l_quantity)", "mean": "avg(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "count": "count(l_quantity)", "var": "var_samp(l_quantity)", "std": "stddev_samp(l_quantity)", "median": "median(l_quantity)", "nunique": "count(distinct l_quantity)"}.items():
    query(f"groupby_{_how}", f"select l_suppkey, round({_cell}, 6) as v from lineitem group by 1" if _how not in ("count", "nunique") else f"select l_suppkey, {_cell} as v from lineitem group by 1")(
        lambda t, how=_how: rounded(getattr(t.lineitem.groupby("l_suppkey").l_quantity, how)().base.sdf.select(F.col("__idx").alias("l_suppkey"), F.col("l_quantity").alias("v")), 6)
    )
query("groupby_size", "select o_custkey, count(*) as n from orders group by 1")(lambda t: t.orders.groupby("o_custkey").size().base.sdf.select(F.col("__idx").alias("o_custkey"), F.col("size").alias("n")))
query("groupby_agg_many", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q, round(max(l_extendedprice), 2) as p, count(l_tax) as n from lineitem group by 1, 2")(
    lambda t: rounded(t.lineitem.groupby(["l_returnflag", "l_linestatus"]).agg(q=("l_quantity", "sum"), p=("l_extendedprice", "max"), n=("l_tax", "count")), 2)
)
query("groupby_first_last", "select user_id, arg_min(value, event_id) as a, arg_max(value, event_id) as b from events group by 1")(lambda t: _indexed(t).groupby("user_id").agg(a=("value", "first"), b=("value", "last")).sdf.select(F.col("__idx").alias("user_id"), "a", "b"))
query("groupby_head", "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id) <= 2")(lambda t: _indexed(t).groupby("user_id").head(2).sdf.select("user_id", "event_id"))
query("groupby_tail", "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 2")(lambda t: _indexed(t).groupby("user_id").tail(2).sdf.select("user_id", "event_id"))
query("groupby_idxmax", "select user_id, arg_max(event_id, (value, -event_id)) as e from events group by 1")(lambda t: (lambda s: s.base.sdf.select(F.col("__idx").alias("user_id"), F.col("value").alias("e")))(_indexed(t).groupby("user_id").value.idxmax()))
query("groupby_value_counts", "select user_id, event_type, count(*) as \"count\" from events group by 1, 2")(lambda t: t.events.groupby("user_id").event_type.value_counts())
query("groupby_cov", "select l_returnflag, round(covar_samp(l_quantity, l_tax), 8) as v from lineitem group by 1")(lambda t: rounded(t.lineitem.groupby("l_returnflag")[["l_quantity", "l_tax"]].cov().sdf.where("variable = 'l_quantity'").select("l_returnflag", F.col("l_tax").alias("v")), 8))
query("groupby_transform", "select event_id, round(avg(value) over (partition by user_id), 6) as m from events")(lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("m")), 6))(_indexed(t).groupby("user_id").value.transform("mean")))
query("groupby_shift", "select event_id, lag(value) over (partition by user_id order by event_id) as p from events")(lambda t: (lambda s: s.base.sdf.select("event_id", s.col.alias("p")))(_indexed(t).groupby("user_id").value.shift(1)))
query("groupby_cumsum", "select event_id, round(sum(value) over (partition by user_id order by event_id), 6) as c from events")(lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("c")), 6))(_indexed(t).groupby("user_id").value.cumsum()))
query("groupby_cumcount", "select event_id, row_number() over (partition by user_id order by event_id) - 1 as c from events")(lambda t: (lambda s: s.base.sdf.select("event_id", s.col.cast("long").alias("c")))(_indexed(t).groupby("user_id").cumcount()))
query("groupby_ffill", "select event_id, last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by event_id) as f from events")(
    lambda t: (lambda s: s.base.sdf.select("event_id", s.col.alias("f")))(_indexed(t).assign(v=lambda d: d.value.where(d.value > 50)).groupby("user_id").v.ffill())
)
query("groupby_rolling", "select event_id, case when count(value) over w >= 3 then round(sum(value) over w, 6) end as r from events window w as (partition by user_id order by event_id rows between 2 preceding and current row)")(
    lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("r")), 6))(_indexed(t).groupby("user_id").value.rolling(3).sum())
)
query("groupby_apply", "select user_id, round(max(value) - min(value), 6) as spread from events group by 1")(
    lambda t: rounded(_indexed(t).groupby("user_id").apply(lambda p: p.iloc[:1][["user_id"]].assign(spread=p["value"].max() - p["value"].min()), meta="user_id long, spread double"), 6)
)
query("groupby_get_group", "select event_id from events where event_type = 'click'")(lambda t: t.events.groupby("event_type").get_group("click")[["event_id"]])
query("groupby_aggregation_class", "select event_type, round(sum(value * value), 4) as v from events group by 1")(
    lambda t: rounded(t.events.groupby("event_type").agg({"value": ts.Aggregation("squares", lambda c: F.sum(c * c))}).sdf.select(F.col("__idx").alias("event_type"), F.col("value").alias("v")))
)

# -- ordered
query("cumsum", "select event_id, round(sum(value) over (order by event_id), 4) as c from events")(lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("c"))))(_indexed(t).value.cumsum()))
query("cummax_cummin", "select event_id, max(value) over (order by event_id) as a, min(value) over (order by event_id) as b from events")(
    lambda t: (lambda d: d.assign(a=d.value.cummax(), b=d.value.cummin())[["event_id", "a", "b"]].sdf.select("event_id", "a", "b"))(_indexed(t))
)
query("shift", "select event_id, lag(value, 2) over (order by event_id) as p, lead(value, 1) over (order by event_id) as n from events")(
    lambda t: (lambda d: d.assign(p=d.value.shift(2), n=d.value.shift(-1)).sdf.select("event_id", "p", "n"))(_indexed(t))
)
query("diff", "select event_id, value - lag(value) over (order by event_id) as d from events")(lambda t: (lambda s: s.base.sdf.select("event_id", s.col.alias("d")))(_indexed(t).value.diff()))
query("ffill", "select event_id, last_value(case when value > 90 then value end ignore nulls) over (order by event_id) as f from events")(
    lambda t: _indexed(t).assign(f=lambda d: d.value.where(d.value > 90))[["event_id", "f"]].ffill().sdf.select("event_id", "f")
)
query("bfill_limit", "select event_id, coalesce(v, lead(v, 1) over (order by event_id), lead(v, 2) over (order by event_id)) as f from (select event_id, case when value > 80 then value end as v from events)")(
    lambda t: _indexed(t).assign(f=lambda d: d.value.where(d.value > 80))[["event_id", "f"]].bfill(limit=2).sdf.select("event_id", "f")
)
for _how, _cell in {"sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "var": "var_samp(value)", "std": "stddev_samp(value)", "median": "quantile_cont(value, 0.5)"}.items():
    query(f"rolling_{_how}", f"select event_id, case when count(value) over w >= 5 then round({_cell} over w, 6) end as r from events window w as (order by event_id rows between 4 preceding and current row)")(
        lambda t, how=_how: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("r")), 6))(getattr(_indexed(t).value.rolling(5), how)())
    )
query("rolling_time", "select ts, round(sum(value) over (order by ts range between interval 3599999999 microseconds preceding and current row), 4) as r from events")(
    lambda t: (lambda s: rounded(s.base.sdf.select("ts", s.col.alias("r"))))(t.events.set_index("ts", drop=False).value.rolling("1h").sum())
)
for _how, _cell, _empty in (("sum", "sum(value)", "0"), ("count", "count(value)", "0"), ("mean", "avg(value)", "null"), ("max", "max(value)", "null")):
    query(f"resample_{_how}", f"""select g.bin as bin, {'coalesce(round(v, 4), 0)' if _how == 'sum' else 'coalesce(v, 0)' if _how == 'count' else 'round(v, 4)'} as v
  from (select unnest(generate_series(min(time_bucket(interval 6 hours, ts)), max(time_bucket(interval 6 hours, ts)), interval 6 hours)) as bin from events) g left join (select time_bucket(interval 6 hours, ts) as bin, {_cell} as v from events group by 1) e on g.bin = e.bin""")(
        lambda t, how=_how: rounded(getattr(t.events.set_index("ts").value.resample("6h"), how)().base.sdf.select(F.col("__idx").alias("bin"), F.col("value").alias("v")))
    )
query("resample_ohlc", """select time_bucket(interval 1 day, ts) as bin, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close from events group by 1""")(
    lambda t: t.events.set_index("ts").value.resample("1D").ohlc().sdf.where("open is not null").select(F.col("__idx").alias("bin"), "open", "high", "low", "close")
)
query("sort_head", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 7")(lambda t: t.orders.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(7, compute=False).spark_frame().select("o_orderkey"))
query("sort_tail", "select o_orderkey from orders order by o_totalprice desc, o_orderkey desc limit 7")(lambda t: t.orders.sort_values(["o_totalprice", "o_orderkey"]).tail(7, compute=False).spark_frame().select("o_orderkey"))
query("sample")(lambda t: t.orders.sample(frac=0.1, random_state=1)[["o_orderkey"]])
query("loc_slice", "select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 500")(lambda t: t.orders.set_index("o_orderkey", drop=False).loc[100:500, ["o_orderkey", "o_totalprice"]].spark_frame().select("o_orderkey", "o_totalprice"))
query("iloc_columns", "select n_name, n_regionkey from nation")(lambda t: t.nation.iloc[:, [1, 2]])
query("map_overlap", "select event_id, round(value + coalesce(lag(value) over (order by event_id), 0), 6) as v from events")(
    lambda t: rounded(_indexed(t)[["event_id", "value"]].map_overlap(lambda p: p.assign(v=p["value"] + p["value"].shift(1).fillna(0))[["event_id", "v"]], 1, 0, meta="event_id long, v double"), 6)
)

# -- accessors
query("str_case", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) as c, length(c_name) as n from customer")(
    lambda t: t.customer.assign(u=lambda d: d.c_name.str.upper(), l=lambda d: d.c_mktsegment.str.lower(), c=lambda d: d.c_mktsegment.str.capitalize(), n=lambda d: d.c_name.str.len().astype("long"))[["c_custkey", "u", "l", "c", "n"]]
)
query("str_search", "select p_partkey, contains(p_type, 'STEEL') as a, starts_with(p_type, 'S') as b, regexp_matches(p_type, 'S[A-Z]+D') as c, (instr(p_type, ' ') - 1)::bigint as f from part")(
    lambda t: t.part.assign(a=lambda d: d.p_type.str.contains("STEEL", regex=False), b=lambda d: d.p_type.str.startswith("S"), c=lambda d: d.p_type.str.contains("S[A-Z]+D"), f=lambda d: d.p_type.str.find(" ").astype("long"))[["p_partkey", "a", "b", "c", "f"]]
)
query("str_cut", "select p_partkey, p_type[2:4] as s, replace(p_type, 'A', '_') as r, regexp_replace(p_type, '[AEIOU]+', '-', 'g') as x, lpad(p_size::varchar, 5, '0') as z from part")(
    lambda t: t.part.assign(s=lambda d: d.p_type.str[1:4], r=lambda d: d.p_type.str.replace("A", "_"), x=lambda d: d.p_type.str.replace("[AEIOU]+", "-", regex=True), z=lambda d: d.p_size.astype(str).str.zfill(5))[["p_partkey", "s", "r", "x", "z"]]
)
query("str_split_expand", "select o_orderkey, split_part(o_orderpriority, '-', 1) as a, split_part(o_orderpriority, '-', 2) as b from orders")(
    lambda t: (lambda d: d.assign(a=d.o_orderpriority.str.split("-", n=1).str.get(0), b=d.o_orderpriority.str.split("-", n=1).str.get(1))[["o_orderkey", "a", "b"]])(t.orders)
)
query("str_extract", "select c_custkey, nullif(regexp_extract(c_name, '([0-9]+)', 1), '') as d from customer")(lambda t: t.customer.assign(d=lambda x: x.c_name.str.extract("([0-9]+)", expand=False))[["c_custkey", "d"]])
query("str_cat", "select n_nationkey, n_name || '/' || n_regionkey::varchar as c from nation")(lambda t: t.nation.assign(c=lambda d: d.n_name.str.cat(d.n_regionkey.astype(str), sep="/"))[["n_nationkey", "c"]])
query("dt_parts", "select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d, (isodow(o_orderdate) - 1)::int as w, dayofyear(o_orderdate)::int as j, quarter(o_orderdate)::int as q from orders")(
    lambda t: t.orders.assign(y=lambda x: x.o_orderdate.dt.year, m=lambda x: x.o_orderdate.dt.month, d=lambda x: x.o_orderdate.dt.day, w=lambda x: x.o_orderdate.dt.dayofweek, j=lambda x: x.o_orderdate.dt.dayofyear, q=lambda x: x.o_orderdate.dt.quarter)[["o_orderkey", "y", "m", "d", "w", "j", "q"]]
)
query("dt_floor", "select event_id, date_trunc('hour', ts) as f, time_bucket(interval 15 minutes, ts) as b from events")(lambda t: t.events.assign(f=lambda d: d.ts.dt.floor("h"), b=lambda d: d.ts.dt.floor("15min"))[["event_id", "f", "b"]])
query("dt_format", "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as s, dayname(o_orderdate) as n, monthname(o_orderdate) as m from orders")(
    lambda t: t.orders.assign(s=lambda d: d.o_orderdate.dt.strftime("%Y/%m/%d"), n=lambda d: d.o_orderdate.dt.day_name(), m=lambda d: d.o_orderdate.dt.month_name())[["o_orderkey", "s", "n", "m"]]
)
query("dt_flags", "select o_orderkey, day(o_orderdate) = 1 as s, o_orderdate::date = last_day(o_orderdate) as e, day(last_day(o_orderdate))::int as n from orders")(
    lambda t: t.orders.assign(s=lambda d: d.o_orderdate.dt.is_month_start, e=lambda d: d.o_orderdate.dt.is_month_end, n=lambda d: d.o_orderdate.dt.days_in_month)[["o_orderkey", "s", "e", "n"]]
)
query("timedelta_seconds", "select event_id, round(date_diff('microsecond', lag(ts) over (order by event_id), ts) / 1000000.0, 6)::double as s from events")(
    lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("s")), 6))(_indexed(t).ts.diff().dt.total_seconds())
)
query("cat_codes", "select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 else -1 end::int as c from orders")(
    lambda t: (lambda d: d.assign(c=Series(d, d.o_orderstatus.cat.set_categories(["F", "O", "P"]).cat.codes.col))[["o_orderkey", "c"]])(t.orders.categorize(columns=["o_orderstatus"]))
)
query("get_dummies", "select r_regionkey, r_name = 'AFRICA' as r_name_AFRICA, r_name = 'ASIA' as r_name_ASIA from region")(lambda t: ts.get_dummies(t.region.categorize(columns=["r_name"]))[["r_regionkey", "r_name_AFRICA", "r_name_ASIA"]])
query("array_reduce", "select i1, round(sum(v), 4) as s from (select 0 as i1, p_size::double as v from part union all select 1, p_retailprice from part) group by 1")(
    lambda t: rounded(t.part.set_index("p_partkey")[_PART].to_array().sum(0).sdf.select(F.col("i0").cast("int").alias("i1"), F.col("v").alias("s")))
)
query("timeseries")(lambda t: ts.timeseries("2000-01-01", "2000-01-02", "1min"))

# -- more of the same families
query("groupby_prod", "select n_regionkey, product(n_nationkey + 1)::double as v from nation group by 1")(lambda t: t.nation.assign(v=lambda d: d.n_nationkey + 1).groupby("n_regionkey").v.prod().base.sdf.select(F.col("__idx").alias("n_regionkey"), "v"))
query("groupby_quantile", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) as v from lineitem group by 1")(
    lambda t: rounded(t.lineitem.groupby("l_returnflag").l_extendedprice.quantile(0.25).base.sdf.select(F.col("__idx").alias("l_returnflag"), F.col("l_extendedprice").alias("v")), 6)
)
query("groupby_keep_missing_keys", "select case when p_size > 25 then p_brand end as k, count(*) as n from part group by 1")(
    lambda t: t.part.assign(k=lambda d: d.p_brand.where(d.p_size > 25)).groupby("k", dropna=False).size().base.sdf.select(F.col("__idx").alias("k"), F.col("size").alias("n"))
)
query("groupby_drop_missing_keys", "select p_brand as k, count(*) as n from part where p_size > 25 group by 1")(
    lambda t: t.part.assign(k=lambda d: d.p_brand.where(d.p_size > 25)).groupby("k").size().base.sdf.select(F.col("__idx").alias("k"), F.col("size").alias("n"))
)
query("groupby_bfill", "select event_id, first_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as f from events")(
    lambda t: (lambda s: s.base.sdf.select("event_id", s.col.alias("f")))(_indexed(t).assign(v=lambda d: d.value.where(d.value > 50)).groupby("user_id").v.bfill())
)
query("groupby_corr", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 8) as v from lineitem group by 1")(
    lambda t: rounded(t.lineitem.groupby("l_returnflag")[["l_quantity", "l_extendedprice"]].corr().sdf.where("variable = 'l_quantity'").select("l_returnflag", F.col("l_extendedprice").alias("v")), 8)
)
query("merge_both_indexes", "select n_nationkey as k, n_name, s_name from nation join supplier on n_nationkey = s_suppkey")(
    lambda t: t.nation.set_index("n_nationkey")[["n_name"]].merge(t.supplier.set_index("s_suppkey")[["s_name"]], left_index=True, right_index=True).sdf.select(F.col("__idx").alias("k"), "n_name", "s_name")
)
query("concat_inner", "select k from (select c_custkey as k from customer union all select s_suppkey from supplier)")(
    lambda t: ts.concat([t.customer[["c_custkey", "c_name"]].set_columns(["k", "n"]), t.supplier[["s_suppkey"]].set_columns(["k"])], join="inner")
)
query("fillna_by_column", "select event_id, coalesce(case when value > 50 then value end, -1) as a, coalesce(case when value > 90 then value end, -2) as b from events")(
    lambda t: t.events.assign(a=lambda d: d.value.where(d.value > 50), b=lambda d: d.value.where(d.value > 90))[["event_id", "a", "b"]].fillna({"a": -1.0, "b": -2.0})
)
query("row_nunique", "select l_orderkey, l_linenumber, case when l_tax = l_discount then 1 else 2 end as n from lineitem")(lambda t: t.lineitem.assign(n=lambda d: d[["l_tax", "l_discount"]].nunique(axis=1))[["l_orderkey", "l_linenumber", "n"]])
query("rolling_centre", "select event_id, case when count(value) over w >= 3 then round(avg(value) over w, 6) end as r from events window w as (order by event_id rows between 1 preceding and 1 following)")(
    lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("r")), 6))(_indexed(t).value.rolling(3, center=True).mean())
)
query("rolling_quantile", "select event_id, case when count(value) over w >= 4 then round(quantile_cont(value, 0.25) over w, 6) end as r from events window w as (order by event_id rows between 3 preceding and current row)")(
    lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("r")), 6))(_indexed(t).value.rolling(4).quantile(0.25))
)
query("rolling_count", "select event_id, count(case when value > 50 then value end) over (order by event_id rows between 4 preceding and current row)::double as r from events")(
    lambda t: (lambda s: s.base.sdf.select("event_id", s.col.alias("r")))(_indexed(t).assign(v=lambda d: d.value.where(d.value > 50)).v.rolling(5).count())
)
query("resample_first_last", "select bin, a, b from (select time_bucket(interval 6 hours, ts) as bin, arg_min(value, ts) as a, arg_max(value, ts) as b from events group by 1)")(
    lambda t: (lambda r: r.agg({"value": ["first", "last"]}).sdf.where("value_first is not null").select(F.col("__idx").alias("bin"), F.col("value_first").alias("a"), F.col("value_last").alias("b")))(t.events.set_index("ts")[["value"]].resample("6h"))
)
query("resample_month", "select date_trunc('month', o_orderdate) as bin, count(*) as n from orders group by 1")(
    lambda t: t.orders.set_index("o_orderdate").resample("MS").size().base.sdf.where("size > 0").select(F.col("__idx").alias("bin"), F.col("size").alias("n"))
)
query("str_pad_strip", "select n_nationkey, lpad(n_name, 20, '*') as l, rpad(n_name, 20, '*') as r, trim('  ' || n_name || ' ') as s from nation")(
    lambda t: t.nation.assign(l=lambda d: d.n_name.str.rjust(20, "*"), r=lambda d: d.n_name.str.ljust(20, "*"), s=lambda d: d.n_name.str.center(30).str.strip())[["n_nationkey", "l", "r", "s"]]
)
query("str_tests", "select c_custkey, regexp_full_match(c_name[-3:], '[0-9]+') as d, c_mktsegment = upper(c_mktsegment) as u, len(regexp_extract_all(c_name, '0'))::int as n from customer")(
    lambda t: t.customer.assign(d=lambda x: x.c_name.str[-3:].str.isdigit(), u=lambda x: x.c_mktsegment.str.isupper(), n=lambda x: x.c_name.str.count("0"))[["c_custkey", "d", "u", "n"]]
)
query("str_partition", "select p_partkey, split_part(p_brand, '#', 1) as \"0\", '#' as \"1\", split_part(p_brand, '#', 2) as \"2\" from part")(
    lambda t: t.part.set_index("p_partkey").p_brand.str.partition("#").sdf.select(F.col("__idx").alias("p_partkey"), F.col("`0`"), F.col("`1`"), F.col("`2`"))
)
query("dt_isocalendar", "select o_orderkey, isoyear(o_orderdate)::int as year, week(o_orderdate)::int as week, isodow(o_orderdate)::int as day from orders")(
    lambda t: t.orders.set_index("o_orderkey").o_orderdate.dt.isocalendar().sdf.select(F.col("__idx").alias("o_orderkey"), "year", "week", "day")
)
query("to_datetime", "select o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') as d from orders")(
    lambda t: t.orders.assign(d=lambda x: ts.to_datetime(x.o_orderdate.dt.strftime("%d.%m.%Y"), format="%d.%m.%Y"))[["o_orderkey", "d"]]
)
query("map_function", "select s_suppkey, s_acctbal * 2 as v from supplier")(lambda t: t.supplier.assign(v=lambda d: d.s_acctbal.map(lambda x: x * 2))[["s_suppkey", "v"]])
query("frame_value_counts", "select l_returnflag, l_linestatus, count(*) as \"count\" from lineitem group by 1, 2")(lambda t: t.lineitem[["l_returnflag", "l_linestatus"]].value_counts())
query("frame_comparison", "select s_suppkey > 5 as s_suppkey, s_acctbal > 5 as s_acctbal from supplier")(lambda t: t.supplier[["s_suppkey", "s_acctbal"]] > 5)
query("memory_usage")(lambda t: t.customer.memory_usage())
query("autocorr", "select round(corr(value, p), 8) as value from (select value, lag(value) over (order by event_id) as p from events)")(lambda t: rounded(_indexed(t).value.autocorr(1).sdf, 8))
query("array_broadcast", "select p_size - (select avg(p_size) from part) as v from part")(lambda t: (lambda a: (a - a.mean(0, keepdims=True)).sdf.select("v"))(t.part.set_index("p_partkey")[["p_size"]].to_array()))


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The tumbling windows of the events, read as a stream and run to its end."""
    from tessera.streaming.windows import tumbling

    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    made = tumbling(stream, "ts", "6 hours", {"n": ("event_id", "count"), "v": ("value", "sum")}, ["event_type"])
    running = made.writeStream.outputMode("complete").format("memory").queryName("tessera_tumbling").trigger(availableNow=True).start()
    running.awaitTermination()
    return rounded(spark.table("tessera_tumbling").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v"))


_QUERIES["stream_tumbling"] = _streamed
_SQL["stream_tumbling"] = "select time_bucket(interval 6 hours, ts) as start, event_type, count(event_id) as n, round(sum(value), 4) as v from events group by 1, 2"


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _QUERIES["flagship"](spark, folder)


def queries() -> dict[str, Query]:
    from tessera.plans import members  # noqa: F401  registers more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera.plans import members  # noqa: F401

    return dict(_SQL)

