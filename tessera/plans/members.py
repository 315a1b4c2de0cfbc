"""Registered queries that hold several members of a family each, beside their SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

import tessera as ts
from tessera.plans.catalog import Tables, _indexed, query, rounded
from tessera.session import active


def _scratch() -> str:
    """A new folder where the cluster shares files; a local one only where no such place is set."""
    shared = active().sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='tessera-')}/{uuid.uuid4().hex}"


def _members(table: str, key: str, made: dict, sql: dict[str, str], name: str) -> None:
    """A query of one column for each member of an accessor, and the SQL of each."""
    query(name, f"select {key}, {', '.join(f'{v} as {k}' for k, v in sql.items())} from {table}")(
        lambda t: (lambda d: d.assign(**{k: f(d) for k, f in made.items()})[[key, *made]])(getattr(t, table))
    )


# -- readers and writers
def _round_trip(kind: str):
    def run(t: Tables):
        path, data = _scratch(), t.customer[["c_custkey", "c_name", "c_acctbal"]]
        if kind == "parquet":
            data.to_parquet(path)
            return ts.read_parquet(path, columns=["c_custkey", "c_name", "c_acctbal"])
        getattr(data, f"to_{kind}")(path)
        return getattr(ts, f"read_{kind}")(path)[["c_custkey", "c_name", "c_acctbal"]]

    return run


for _kind in ("csv", "json", "orc", "parquet"):
    query(f"io_{_kind}", "select c_custkey, c_name, c_acctbal from customer")(_round_trip(_kind))
query("io_table", "select n_nationkey, n_name from nation")(
    lambda t: (lambda path: (t.nation.sdf.select("n_nationkey", "n_name").write.option("sep", "\t").option("header", True).csv(path), ts.read_table(path))[1])(_scratch())
)

# -- strings
_N = "n_name"
_members(
    "nation", "n_nationkey",
    {
        "low": lambda d: d.n_name.str.casefold(), "title": lambda d: d.n_name.str.title(), "swap": lambda d: d.n_name.str.swapcase(), "ends": lambda d: d.n_name.str.endswith("A"), "starts": lambda d: d.n_name.str.match("[AEIOU]"),
        "full": lambda d: d.n_name.str.fullmatch("[A-Z]+"), "far": lambda d: d.n_name.str.rfind("A"), "alpha": lambda d: d.n_name.str.isalpha(), "alnum": lambda d: d.n_name.str.isalnum(), "lower": lambda d: d.n_name.str.islower(),
        "numeric": lambda d: d.n_name.str.isnumeric(), "decimal": lambda d: d.n_name.str.isdecimal(), "space": lambda d: d.n_name.str.isspace(), "istitle": lambda d: d.n_name.str.istitle(), "left": lambda d: d.n_name.str.lstrip("A"),
        "right": lambda d: d.n_name.str.rstrip("A"), "headless": lambda d: d.n_name.str.removeprefix("UNITED "), "tailless": lambda d: d.n_name.str.removesuffix("IA"), "twice": lambda d: d.n_name.str.repeat(2),
        "part": lambda d: d.n_name.str.slice(1, 4), "padded": lambda d: d.n_name.str.pad(16, side="left", fillchar="-"), "swapped": lambda d: d.n_name.str.slice_replace(0, 1, "_"), "normal": lambda d: d.n_name.str.normalize("NFC"),
        "mapped": lambda d: d.n_name.str.translate({ord("A"): "4", ord("E"): "3"}), "replaced": lambda d: d.n_name.str.replace("IA", "ia"), "third": lambda d: d.n_name.str.get(2), "joined": lambda d: d.n_name.str.join("."),
        "item": lambda d: d.n_name.str[0:3],
    },
    {
        "low": f"lower({_N})", "title": "array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')", "swap": f"lower({_N})", "ends": f"ends_with({_N}, 'A')",
        "starts": f"regexp_matches({_N}, '^[AEIOU]')", "full": f"regexp_full_match({_N}, '[A-Z]+')", "far": f"case when contains({_N}, 'A') then length({_N}) - strpos(reverse({_N}), 'A') else -1 end::int", "alpha": f"regexp_full_match({_N}, '[A-Za-z]+')",
        "alnum": f"regexp_full_match({_N}, '[A-Za-z0-9]+')", "lower": "false", "numeric": "false", "decimal": "false", "space": "false", "istitle": "false", "left": f"ltrim({_N}, 'A')", "right": f"rtrim({_N}, 'A')",
        "headless": f"regexp_replace({_N}, '^UNITED ', '')", "tailless": f"regexp_replace({_N}, 'IA$', '')", "twice": f"repeat({_N}, 2)", "part": f"{_N}[2:4]", "padded": f"lpad({_N}, 16, '-')", "swapped": f"'_' || {_N}[2:]",
        "normal": _N, "mapped": f"translate({_N}, 'AE', '43')", "replaced": f"replace({_N}, 'IA', 'ia')", "third": f"{_N}[3]", "joined": f"array_to_string(string_split({_N}, ''), '.')", "item": f"{_N}[1:3]",
    }, "str_members",
)
query("str_findall", "select n_nationkey, array_to_string(regexp_extract_all(n_name, '[AI]'), '-') as f from nation")(
    lambda t: t.nation.assign(f=lambda d: d.n_name.str.findall("[AI]").str.join("-"))[["n_nationkey", "f"]]
)
query("str_encode_decode", "select n_nationkey, n_name as f from nation")(lambda t: t.nation.assign(f=lambda d: d.n_name.str.encode("utf-8").str.decode("utf-8"))[["n_nationkey", "f"]])

# -- dates
_D = "o_orderdate"
_members(
    "orders", "o_orderkey",
    {
        "quarter_start": lambda d: d.o_orderdate.dt.is_quarter_start, "quarter_end": lambda d: d.o_orderdate.dt.is_quarter_end, "year_start": lambda d: d.o_orderdate.dt.is_year_start, "year_end": lambda d: d.o_orderdate.dt.is_year_end,
        "leap": lambda d: d.o_orderdate.dt.is_leap_year, "dim": lambda d: d.o_orderdate.dt.daysinmonth, "dow": lambda d: d.o_orderdate.dt.day_of_week, "weekday": lambda d: d.o_orderdate.dt.weekday, "doy": lambda d: d.o_orderdate.dt.day_of_year,
        "minute": lambda d: d.o_orderdate.dt.minute, "second": lambda d: d.o_orderdate.dt.second, "micro": lambda d: d.o_orderdate.dt.microsecond, "nano": lambda d: d.o_orderdate.dt.nanosecond,
        "midnight": lambda d: d.o_orderdate.dt.normalize(), "up": lambda d: d.o_orderdate.dt.ceil("D"),
    },
    {
        "quarter_start": f"day({_D}) = 1 and month({_D}) in (1, 4, 7, 10)", "quarter_end": f"{_D}::date = last_day({_D}) and month({_D}) in (3, 6, 9, 12)", "year_start": f"dayofyear({_D}) = 1", "year_end": f"month({_D}) = 12 and day({_D}) = 31",
        "leap": f"dayofyear(make_date(year({_D}), 12, 31)) = 366", "dim": f"day(last_day({_D}))::int", "dow": f"(isodow({_D}) - 1)::int", "weekday": f"(isodow({_D}) - 1)::int", "doy": f"dayofyear({_D})::int", "minute": f"minute({_D})::int",
        "second": f"second({_D})::int", "micro": f"(microsecond({_D}) % 1000000)::int", "nano": "0", "midnight": f"date_trunc('day', {_D})",
        "up": f"case when {_D} = date_trunc('day', {_D}) then {_D} else date_trunc('day', {_D}) + interval 1 day end",
    }, "dt_members",
)
_members(
    "events", "event_id", {"hour": lambda d: d.ts.dt.hour, "minute": lambda d: d.ts.dt.minute, "second": lambda d: d.ts.dt.second, "micro": lambda d: d.ts.dt.microsecond, "up": lambda d: d.ts.dt.ceil("h")},
    {"hour": "hour(ts)::int", "minute": "minute(ts)::int", "second": "second(ts)::int", "micro": "(microsecond(ts) % 1000000)::int", "up": "case when ts = date_trunc('hour', ts) then ts else date_trunc('hour', ts) + interval 1 hour end"},
    "dt_clock",
)

# -- elements
query("notnull_copy_pipe", "select event_id, value > 50 as n from events")(lambda t: t.events.copy().pipe(lambda d: d.assign(n=d.value.where(d.value > 50).notnull()))[["event_id", "n"]])
query("combine_columns", "select s_suppkey, greatest(s_acctbal, s_nationkey) as m from supplier")(lambda t: (lambda d: d.assign(m=np.maximum(d.s_acctbal, d.s_nationkey))[["s_suppkey", "m"]])(t.supplier))
query("divmod_columns", "select c_custkey, c_custkey // 7 as q, c_custkey % 7 as r from customer")(lambda t: (lambda d: (lambda qr: d.assign(q=qr[0], r=qr[1])[["c_custkey", "q", "r"]])(divmod(d.c_custkey, 7)))(t.customer))
query("large_integers", "select c_custkey, ((2::hugeint ** 60)::bigint + c_custkey) % 10 as r, ((2::hugeint ** 60)::bigint + c_custkey) // 10 as q from customer")(
    lambda t: (lambda d: d.assign(r=(d.c_custkey + 2**60) % 10, q=(d.c_custkey + 2**60) // 10)[["c_custkey", "r", "q"]])(t.customer)
)
query("missing_counts_without_skipping", "select case when bool_or(value <= 50) then null else sum(value) end as value from events")(lambda t: (lambda d: d.value.where(d.value > 50).sum(skipna=False))(t.events))
query("undefined_is_missing", "select count(*) as value from events where value >= 50")(lambda t: np.sqrt(t.events.value - 50).count())

# -- rows in other places
_EVERY = "select n_nationkey, n_regionkey from nation"
query("shuffle_rows", _EVERY)(lambda t: t.nation.shuffle("n_regionkey")[["n_nationkey", "n_regionkey"]])
query("repartition_rows", _EVERY)(lambda t: t.nation.repartition(npartitions=4)[["n_nationkey", "n_regionkey"]])
query("random_split_rows", _EVERY)(lambda t: ts.concat([x[["n_nationkey", "n_regionkey"]] for x in t.nation.random_split([0.3, 0.7], random_state=3)]))
query("sample_share", "select true as within")(lambda t: (lambda d: d.sample(frac=0.5, random_state=1).sdf.agg((F.abs(F.count("*") / F.lit(d.sdf.count()) - 0.5) < 0.05).alias("within")))(t.lineitem))
query("nunique_approx_within", "select true as within")(
    lambda t: (lambda d: d.nunique_approx().sdf.toDF("n").select((F.abs(F.col("n") / F.lit(d.sdf.select("l_partkey", "l_suppkey").distinct().count()) - 1) < 0.03).alias("within")))(t.lineitem[["l_partkey", "l_suppkey"]])
)

# -- windows
_W = "window w as (order by event_id rows between 4 preceding and current row)"
query("rolling_min_max", f"select event_id, case when count(value) over w = 5 then min(value) over w end as a, case when count(value) over w = 5 then max(value) over w end as b from events {_W}")(
    lambda t: (lambda r: r.sdf.select("event_id", F.col(r.columns[0]).alias("a"), F.col(r.columns[1]).alias("b")))(_indexed(t)[["event_id", "value"]].assign(a=lambda d: d.value.rolling(5).min(), b=lambda d: d.value.rolling(5).max())[["a", "b", "event_id"]])
)
query("rolling_skew", f"select event_id, case when count(value) over w = 5 then round(skewness(value) over w, 4) end as r from events {_W}")(
    lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("r"))))(_indexed(t).value.rolling(5).skew())
)
query("rolling_kurt", f"select event_id, case when count(value) over w = 5 then round(kurtosis(value) over w, 4) end as r from events {_W}")(
    lambda t: (lambda s: rounded(s.base.sdf.select("event_id", s.col.alias("r"))))(_indexed(t).value.rolling(5).kurt())
)
for _how, _f in (("std", "stddev_samp(value)"), ("median", "median(value)"), ("nunique", "count(distinct value)::bigint"), ("sem", "stddev_samp(value) / sqrt(count(value))")):
    query(f"resample_{_how}", f"select time_bucket(interval 6 hours, ts) as bin, round({_f}, 4) as v from events group by 1 having count(*) > 1")(
        lambda t, how=_how: rounded((lambda r, n: r.sdf.join(n, "__idx").where("n > 1").select(F.col("__idx").alias("bin"), F.col("value").alias("v")))(
            getattr(t.events.set_index("ts")[["value"]].resample("6h"), how)(), t.events.set_index("ts").resample("6h").size().base.sdf.select("__idx", F.col("size").alias("n")))
        )
    )

# -- more members
_members(
    "nation", "n_nationkey",
    {"at": lambda d: d.n_name.str.find("A"), "index": lambda d: d.n_name.str.slice(0, 1).str.index(""), "wrapped": lambda d: d.n_name.str.wrap(6), "enclosed": lambda d: d.n_name.str.center(3), "fold": lambda d: d.n_name.str.lower().str.title()},
    {"at": "strpos(n_name, 'A')::int - 1", "index": "0", "wrapped": "case when length(n_name) > 6 then n_name[1:6] || chr(10) || n_name[7:] else n_name end", "enclosed": "n_name",
     "fold": "array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"},
    "str_more",
)
_SPANS = "(o_orderdate - timestamp '1992-01-01 00:00:00')"
_members(
    "orders", "o_orderkey",
    {"days": lambda d: (d.o_orderdate - np.datetime64("1992-01-01T00:00:00").astype("datetime64[us]").item()).dt.days, "seconds": lambda d: (d.o_orderdate - np.datetime64("1992-01-01T00:00:00").astype("datetime64[us]").item()).dt.seconds,
     "micros": lambda d: (d.o_orderdate - np.datetime64("1992-01-01T00:00:00").astype("datetime64[us]").item()).dt.microseconds, "nanos": lambda d: (d.o_orderdate - np.datetime64("1992-01-01T00:00:00").astype("datetime64[us]").item()).dt.nanoseconds},
    {"days": f"floor(epoch({_SPANS}) / 86400)::int", "seconds": f"(epoch({_SPANS})::bigint % 86400)::int", "micros": "0", "nanos": "0"},
    "timedelta_members",
)
_SERIES = lambda s, n="r": rounded(s.base.sdf.select("event_id", s.col.alias(n)))
query("rolling_agg", f"select event_id, case when count(value) over w = 5 then round(sum(value) over w, 4) end as a, case when count(value) over w = 5 then max(value) over w end as b from events {_W}")(
    lambda t: (lambda r: rounded(r.sdf.select(F.col("__idx").alias("event_id"), F.col("value_sum").alias("a"), F.col("value_max").alias("b"))))(_indexed(t)[["value"]].rolling(5).agg({"value": ["sum", "max"]}))
)
query("rolling_apply", f"select event_id, case when count(value) over w = 5 then round(max(value) over w - min(value) over w, 4) end as r from events {_W}")(
    lambda t: _SERIES(_indexed(t).value.rolling(5).apply(lambda x: float(np.max(x) - np.min(x))))
)
query("rolling_cov", f"select event_id, case when count(value) over w = 5 then round(covar_samp(value, user_id) over w, 4) end as r from events {_W}")(
    lambda t: (lambda r: rounded(r.sdf.select(F.col("__idx").alias("event_id"), F.col("value_user_id").alias("r"))))(_indexed(t)[["value", "user_id"]].rolling(5).cov())
)
for _how, _f in (("prod", "product(value / 50)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(value)")):
    query(f"resample_by_{_how}", f"select time_bucket(interval 6 hours, ts) as bin, round({_f}, 4) as v from events group by 1 having count(*) > 1")(
        lambda t, how=_how: rounded((lambda r, n: r.sdf.join(n, "__idx").where("n > 1").select(F.col("__idx").alias("bin"), F.col("v")))(
            getattr(t.events.assign(v=lambda d: d.value / 50 if how == "prod" else d.value).set_index("ts")[["v"]].resample("6h"), how)(), t.events.set_index("ts").resample("6h").size().base.sdf.select("__idx", F.col("size").alias("n")))
        )
    )
query("resample_quantile", "select time_bucket(interval 6 hours, ts) as bin, round(quantile_cont(value, 0.5), 4) as v from events group by 1")(
    lambda t: rounded((lambda r: r.sdf.where("value is not null").select(F.col("__idx").alias("bin"), F.col("value").alias("v")))(t.events.set_index("ts")[["value"]].resample("6h").quantile()))
)
query("groupby_unique", "select n_regionkey as k, array_to_string(list_sort(list(distinct n_name)), ',') as v from nation group by 1")(
    lambda t: (lambda s: s.base.sdf.select(F.col("__idx").alias("k"), F.array_join(F.array_sort(s.col), ",").alias("v")))(t.nation.groupby("n_regionkey").n_name.unique())
)
query("rename_axis_squeeze", "select n_nationkey as k, n_name from nation")(lambda t: (lambda s: s.base.sdf.select(F.col("__idx").alias("k"), s.col.alias("n_name")))(t.nation.set_index("n_nationkey")[["n_name"]].rename_axis("k").squeeze()))
query("timeseries_shape", "select 1440::bigint as n, true as ids, true as xs")(
    lambda t: ts.timeseries("2000-01-01", "2000-01-02", "1min").sdf.agg(F.count("*").alias("n"), (F.min("id") >= 0).alias("ids"), ((F.min("x") >= -1) & (F.max("x") <= 1)).alias("xs"))
)
query("loc_label_and_list", "select n_nationkey as k, n_name from nation where n_nationkey in (3, 5, 7) union all select n_nationkey, n_name from nation where n_nationkey = 9")(
    lambda t: (lambda d: d.loc[[3, 5, 7]].sdf.unionByName(d.loc[9].sdf).select(F.col("__idx").alias("k"), "n_name"))(t.nation.set_index("n_nationkey")[["n_name"]])
)
_A = lambda t: t.part.set_index("p_partkey")[["p_size", "p_retailprice"]].to_array()
for _how, _f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop"), ("var", "var_pop")):
    query(f"array_{_how}", f"select i1, round({_f}(v), 4) as v from (select 0 as i1, p_size::double as v from part union all select 1, p_retailprice from part) group by 1")(
        lambda t, how=_how: rounded(getattr(_A(t), how)(0).sdf.select(F.col("i0").cast("int").alias("i1"), "v"))
    )
query("array_transpose", "select p_partkey as i1, p_size::double as v from part")(lambda t: _A(t).T.sdf.where("i0 = 0").select(F.col("i1"), "v"))
query("array_arithmetic", "select round(p_size * 2 + 1, 4)::double as v from part")(lambda t: (lambda a: rounded((a * 2 + 1).sdf.where("i1 = 0").select("v")))(_A(t)))
