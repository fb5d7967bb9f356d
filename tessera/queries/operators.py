"""One query for each operator, over whole tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import call, col, lit, row_number, when
from ..operators import LazyFrame
from ..plans import optimize_plan, signature, sql, validate_plan
from ..sources import from_arrow, from_pandas, read_csv
from ..streaming import windowed_events
from .star import REVENUE, Tables, day, tables, total

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable:
    def register(f: Callable[[Tables], LazyFrame]) -> Callable[[Tables], LazyFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(tables(spark, folder)).df
        ORACLES[f.__name__] = oracle
        return f

    return register


def simple(name: str, oracle: str, f: Callable[[Tables], LazyFrame]) -> None:
    QUERIES[name] = lambda spark, folder: f(tables(spark, folder)).df
    ORACLES[name] = oracle


# scans and projections
simple("scan_parquet", "select n_nationkey, n_name, n_regionkey from nation", lambda t: t("nation"))
simple("project", "select c_custkey, c_name as name, c_acctbal * 2 as twice from customer", lambda t: t("customer").select("c_custkey", col("c_name").alias("name"), (col("c_acctbal") * 2).alias("twice")))
simple("with_columns", "select p_partkey, p_name, p_brand, p_type, p_retailprice, p_size + 1 as p_size, p_retailprice * 0.5 as half from part", lambda t: t("part").with_columns((col("p_size") + 1).alias("p_size"), (col("p_retailprice") * 0.5).alias("half")))
simple("arith", "select s_suppkey, s_acctbal + 1.5 as a, 10 - s_acctbal as b, s_acctbal * -1 as c, s_acctbal / 4 as d, -s_nationkey as e, s_nationkey % 7 as f from supplier",
       lambda t: t("supplier").select("s_suppkey", (col("s_acctbal") + 1.5).alias("a"), (10 - col("s_acctbal")).alias("b"), (col("s_acctbal") * -1).alias("c"), (col("s_acctbal") / 4).alias("d"), (-col("s_nationkey")).alias("e"), (col("s_nationkey") % 7).alias("f")))
simple("case_when", "select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from orders",
       lambda t: t("orders").select("o_orderkey", when(col("o_totalprice") > 300000, "high", when(col("o_totalprice") > 100000, "mid", "low")).alias("band")))
simple("year", "select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(19970315 // 10000 as bigint) as from_int from orders",
       lambda t: t("orders").select("o_orderkey", col("o_orderdate").year().alias("y"), lit(19970315).year().alias("from_int")))
simple("string_functions", "select c_custkey, substr(c_mktsegment, 1, 2) as head, upper(c_name) as loud, length(c_name) as n from customer",
       lambda t: t("customer").select("c_custkey", col("c_mktsegment").substring(1, 2).alias("head"), call("upper", col("c_name")).alias("loud"), call("length", col("c_name")).cast("bigint").alias("n")))

# filters
simple("filter_cmp", "select l_orderkey, l_quantity from lineitem where l_quantity >= 30 and l_discount <> 0.05 and l_tax < 0.08 and l_linenumber <= 4 and l_returnflag = 'R' and l_extendedprice > 1000",
       lambda t: t("lineitem").filter((col("l_quantity") >= 30) & (col("l_discount") != 0.05) & (col("l_tax") < 0.08) & (col("l_linenumber") <= 4) & (col("l_returnflag") == "R") & (col("l_extendedprice") > 1000)).select("l_orderkey", "l_quantity"))
simple("filter_bool", "select o_orderkey from orders where (o_orderstatus = 'F' or o_totalprice > 400000) and not o_orderpriority = '5-LOW'",
       lambda t: t("orders").filter(((col("o_orderstatus") == "F") | (col("o_totalprice") > 400000)) & ~(col("o_orderpriority") == "5-LOW")).select("o_orderkey"))
simple("filter_isin", "select p_partkey from part where p_size in (1, 5, 9) and p_type in ('PROMO', 'SMALL')", lambda t: t("part").filter(col("p_size").isin([1, 5, 9]) & col("p_type").isin(["PROMO", "SMALL"])).select("p_partkey"))
simple("filter_between", "select p_partkey from part where p_size between 10 and 20", lambda t: t("part").filter(col("p_size").between(10, 20)).select("p_partkey"))
simple("filter_startswith", "select p_partkey, p_name from part where starts_with(p_name, 'red')", lambda t: t("part").filter(col("p_name").startswith("red")).select("p_partkey", "p_name"))
simple("filter_contains", "select p_partkey, p_name from part where contains(p_name, 'red')", lambda t: t("part").filter(col("p_name").contains("red")).select("p_partkey", "p_name"))
simple("filter_not", "select p_partkey from part where p_size not in (1, 2, 3) and not p_brand like 'Brand#1%'", lambda t: t("part").filter(~col("p_size").isin([1, 2, 3]) & ~col("p_brand").startswith("Brand#1")).select("p_partkey"))
simple("filter_columns", "select l_orderkey, l_partkey from lineitem where l_quantity < l_extendedprice * 0.001", lambda t: t("lineitem").filter(col("l_quantity") < col("l_extendedprice") * 0.001).select("l_orderkey", "l_partkey"))

# aggregation
simple("agg_global", "select round(sum(l_quantity), 2) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi, sum(l_quantity) / count(*) as m, count(*) as n from lineitem",
       lambda t: t("lineitem").agg(total(col("l_quantity"), "s", 2), col("l_extendedprice").min().alias("lo"), col("l_extendedprice").max().alias("hi"), col("l_quantity").mean().alias("m"), col("l_tax").count().alias("n")))
simple("agg_grouped", "select o_orderpriority, round(sum(o_totalprice), 2) as s, min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as n from orders group by 1",
       lambda t: t("orders").groupby("o_orderpriority").agg(total(col("o_totalprice"), "s", 2), col("o_totalprice").min().alias("lo"), col("o_totalprice").max().alias("hi"), col("o_orderkey").count().alias("n")))
simple("agg_multi_key", "select l_returnflag, l_linestatus, l_linenumber, count(*) as n, round(sum(l_quantity), 2) as s from lineitem group by 1, 2, 3",
       lambda t: t("lineitem").groupby("l_returnflag", "l_linestatus", "l_linenumber").agg(col("l_quantity").count().alias("n"), total(col("l_quantity"), "s", 2)))
simple("agg_expression_key", "select cast(year(l_shipdate) as bigint) as y, l_quantity >= 25 as large, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem group by 1, 2",
       lambda t: t("lineitem").groupby(col("l_shipdate").year().alias("y"), (col("l_quantity") >= 25).alias("large")).agg(total(REVENUE, "revenue")))
simple("agg_conditional", "select l_returnflag, cast(sum(case when l_quantity > 25 then 1 else 0 end) as bigint) as large, round(sum(case when l_discount > 0.05 then l_extendedprice else 0 end), 2) as cut from lineitem group by 1",
       lambda t: t("lineitem").groupby("l_returnflag").agg(when(col("l_quantity") > 25, 1).sum().alias("large"), total(when(col("l_discount") > 0.05, col("l_extendedprice"), 0.0), "cut", 2)))
simple("agg_distinct", "select p_brand, count(distinct p_type) as kinds, count(distinct p_size) as sizes from part group by 1", lambda t: t("part").groupby("p_brand").agg(col("p_type").count_distinct().alias("kinds"), col("p_size").count_distinct().alias("sizes")))
simple("agg_deviation", "select p_type, round(stddev_samp(p_retailprice), 4) as s, round(var_samp(p_retailprice), 2) as v, median(p_retailprice) as m from part group by 1",
       lambda t: t("part").groupby("p_type").agg(col("p_retailprice").std().round(4).alias("s"), col("p_retailprice").var().round(2).alias("v"), col("p_retailprice").median().alias("m")))
simple("having", "select l_orderkey, sum(l_quantity) as q from lineitem group by 1 having sum(l_quantity) > 150", lambda t: t("lineitem").groupby("l_orderkey").agg(col("l_quantity").sum().alias("q")).filter(col("q") > 150))

# joins
simple("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 400000", lambda t: t("orders").filter(col("o_totalprice") > 400000).join(t("customer"), left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "c_name"))
simple("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000", lambda t: t("customer").join(t("orders").filter(col("o_totalprice") > 400000), left_on="c_custkey", right_on="o_custkey", how="left").select("c_custkey", "o_orderkey"))
simple("join_right", "select s_suppkey, n_name from (select * from supplier where s_acctbal > 9000) s right join nation on s_nationkey = n_nationkey", lambda t: t("supplier").filter(col("s_acctbal") > 9000).join(t("nation"), left_on="s_nationkey", right_on="n_nationkey", how="right").select("s_suppkey", "n_name"))
simple("join_full", "select coalesce(a.k, b.k) as k, x, y from (select p_partkey as k, p_size as x from part where p_size < 25) a full join (select p_partkey as k, p_type as y from part where p_size > 20) b on a.k = b.k",
       lambda t: t("part").filter(col("p_size") < 25).select(col("p_partkey").alias("k"), col("p_size").alias("x")).join(t("part").filter(col("p_size") > 20).select(col("p_partkey").alias("k"), col("p_type").alias("y")), on="k", how="full"))
simple("join_cross", "select r_name, n_name from region cross join nation", lambda t: t("region").join(t("nation"), how="cross").select("r_name", "n_name"))
simple("join_multi_key", "select count(*) as n from lineitem a join (select distinct l_partkey as p, l_suppkey as s from lineitem where l_returnflag = 'R') b on a.l_partkey = b.p and a.l_suppkey = b.s",
       lambda t: t("lineitem").join(t("lineitem").filter(col("l_returnflag") == "R").distinct("l_partkey", "l_suppkey"), on=["l_partkey", "l_suppkey"]).agg(col("l_orderkey").count().alias("n")))
simple("join_chain", "select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
       lambda t: t("customer").join(t("nation"), left_on="c_nationkey", right_on="n_nationkey").join(t("region"), left_on="n_regionkey", right_on="r_regionkey").groupby("r_name").agg(col("c_custkey").count().alias("n")))
simple("join_string_key", "select a.p_brand, n, m from (select p_brand, count(*) as n from part group by 1) a join (select p_brand, max(p_size) as m from part where p_type = 'PROMO' group by 1) b on a.p_brand = b.p_brand",
       lambda t: t("part").groupby("p_brand").agg(col("p_size").count().alias("n")).join(t("part").filter(col("p_type") == "PROMO").groupby("p_brand").agg(col("p_size").max().alias("m")), on="p_brand"))
simple("join_self", "select count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey", lambda t: t("nation").join(t("nation"), on="n_regionkey", suffix="_2").agg(col("n_name_2").count().alias("n")))
simple("semi_join", "select o_orderkey from orders where exists(select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 50 and l_discount >= 0.1)", lambda t: t("orders").join(t("lineitem").filter((col("l_quantity") >= 50) & (col("l_discount") >= 0.1)), left_on="o_orderkey", right_on="l_orderkey", how="semi").select("o_orderkey"))
simple("anti_join", "select c_custkey from customer where not exists(select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)", lambda t: t("customer").join(t("orders").filter(col("o_totalprice") > 250000), left_on="c_custkey", right_on="o_custkey", how="anti").select("c_custkey"))


@query("select l_orderkey, l_suppkey from lineitem a where exists(select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey) and not exists(select 1 from lineitem c where c.l_orderkey = a.l_orderkey and c.l_suppkey <> a.l_suppkey and c.l_quantity > 10)")
def exists_not_exists(t: Tables) -> LazyFrame:
    """Inequality inside EXISTS becomes a comparison of the group's extremes: no self-join."""
    large = when(col("l_quantity") > 10, col("l_suppkey"), lit(None).cast("bigint"))
    span = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").with_columns(
        col("l_suppkey").min().over("l_orderkey").alias("s0"), col("l_suppkey").max().over("l_orderkey").alias("s1"),
        large.min().over("l_orderkey").alias("b0"), large.max().over("l_orderkey").alias("b1"),
    )
    none_else = col("b0").is_null() | ((col("b0") == col("l_suppkey")) & (col("b1") == col("l_suppkey")))
    return span.filter((col("s0") != col("s1")) & none_else).select("l_orderkey", "l_suppkey")


simple("scalar_subquery", "select s_suppkey, s_acctbal from supplier where s_acctbal > (select sum(s_acctbal) / count(*) from supplier)",
       lambda t: t("supplier").join(t("supplier").agg(col("s_acctbal").mean().alias("m")), how="cross").filter(col("s_acctbal") > col("m")).select("s_suppkey", "s_acctbal"))

# order, limits, distinct, sets
simple("sort_limit", "select event_id, value from events order by value desc nulls last, event_id limit 25", lambda t: t("events").sort("value", "event_id", descending=[True, False]).limit(25).select("event_id", "value"))
simple("sort_multi", "select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 40", lambda t: t("customer").select("c_custkey", "c_mktsegment", "c_acctbal").sort("c_mktsegment", "c_acctbal", "c_custkey", descending=[False, True, False]).limit(40))
simple("tail", "select event_id, value from events order by value desc, event_id desc limit 7", lambda t: t("events").select("event_id", "value").sort("value", "event_id").tail(7))
simple("distinct_all", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem", lambda t: t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct())
simple("distinct_subset", "select distinct l_returnflag, l_linestatus from lineitem", lambda t: t("lineitem").distinct("l_returnflag", "l_linestatus"))
simple("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier", lambda t: t("customer").select(col("c_nationkey").alias("k")).union(t("supplier").select(col("s_nationkey").alias("k")), distinct=True))
simple("set_intersect", "select l_partkey as k from lineitem where l_quantity > 45 intersect select p_partkey from part where p_size > 40", lambda t: t("lineitem").filter(col("l_quantity") > 45).select(col("l_partkey").alias("k")).intersect(t("part").filter(col("p_size") > 40).select(col("p_partkey").alias("k"))))
simple("set_except", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45", lambda t: t("part").select(col("p_partkey").alias("k")).except_(t("lineitem").filter(col("l_quantity") > 45).select(col("l_partkey").alias("k"))))
simple("describe", " union all ".join(
    f"select '{label}' as statistic, round({f('p_size')}, 6) as p_size, round({f('p_retailprice')}, 6) as p_retailprice from part"
    for label, f in {"count": lambda c: f"count({c})::double", "mean": lambda c: f"sum({c}::decimal(18,2))::double / count({c})", "std": lambda c: f"stddev_samp({c})", "min": lambda c: f"min({c})::double", "25%": lambda c: f"quantile_cont({c}::double, 0.25)", "50%": lambda c: f"quantile_cont({c}::double, 0.5)", "75%": lambda c: f"quantile_cont({c}::double, 0.75)", "max": lambda c: f"max({c})::double"}.items()
), lambda t: t("part").select("p_size", "p_retailprice").describe().select("statistic", col("p_size").round(6).alias("p_size"), col("p_retailprice").round(6).alias("p_retailprice")))

# windows
simple("win_sum", "select event_id, round(sum(value) over (partition by user_id), 4) as w from events", lambda t: t("events").select("event_id", col("value").sum().over("user_id").round(4).alias("w")))
simple("win_mean", "select event_id, sum(cast(value as decimal(18, 2))) over (partition by event_type)::double / count(*) over (partition by event_type) as w from events", lambda t: t("events").select("event_id", (col("value").cast("decimal(18,2)").sum().over("event_type").cast("double") / col("value").count().over("event_type")).alias("w")))
simple("win_min", "select event_id, min(value) over (partition by user_id) as w from events", lambda t: t("events").select("event_id", col("value").min().over("user_id").alias("w")))
simple("win_max", "select event_id, max(value) over (partition by user_id) as w from events", lambda t: t("events").select("event_id", col("value").max().over("user_id").alias("w")))
simple("win_rank", "select event_id, rank() over (partition by user_id order by value) as w from events", lambda t: t("events").select("event_id", col("value").rank().over("user_id").alias("w")))
simple("win_dense_rank", "select event_id, dense_rank() over (partition by event_type order by user_id) as w from events", lambda t: t("events").select("event_id", col("user_id").dense_rank().over("event_type").alias("w")))
simple("win_row_number", "select event_id, row_number() over (partition by user_id order by event_id desc) as w from events", lambda t: t("events").select("event_id", row_number().over("user_id", order_by="event_id", descending=True).alias("w")))
simple("win_lag", "select event_id, lag(value, 2) over (partition by user_id order by event_id) as w from events", lambda t: t("events").select("event_id", col("value").lag(2).over("user_id", order_by="event_id").alias("w")))
simple("win_lead", "select event_id, lead(value, 1, -1.0) over (partition by user_id order by event_id) as w from events", lambda t: t("events").select("event_id", col("value").lead(1, -1.0).over("user_id", order_by="event_id").alias("w")))
simple("win_cum_sum", "select event_id, round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 4) as w from events", lambda t: t("events").select("event_id", col("value").cum_sum().over("user_id", order_by="event_id").round(4).alias("w")))
simple("event_windows", "select time_bucket(interval 1 hour, ts)::timestamp as window_start, time_bucket(interval 1 hour, ts)::timestamp + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
       lambda t: LazyFrame(windowed_events(t("events").df)).with_columns(col("window_start").cast("timestamp_ntz").alias("window_start"), col("window_end").cast("timestamp_ntz").alias("window_end"), col("total").round(2).alias("total")))

# whole-table windows, spread over buckets of the order key
simple("whole_row_number", "select event_id, row_number() over (order by value desc nulls last, event_id desc) as w from events", lambda t: t("events").select("event_id", row_number().over(order_by=["value", "event_id"], descending=True).alias("w")))
simple("whole_rank", "select event_id, rank() over (order by user_id nulls last) as w from events", lambda t: t("events").select("event_id", col("user_id").rank().alias("w")))
simple("whole_dense_rank", "select event_id, dense_rank() over (order by user_id nulls last) as w from events", lambda t: t("events").select("event_id", col("user_id").dense_rank().alias("w")))
simple("whole_dense_rank_text", "select event_id, dense_rank() over (order by event_type nulls last) as w from events", lambda t: t("events").select("event_id", col("event_type").dense_rank().alias("w")))
simple("whole_lag", "select event_id, lag(value, 3) over (order by event_id) as w from events", lambda t: t("events").select("event_id", col("value").lag(3).over(order_by="event_id").alias("w")))
simple("whole_lead", "select event_id, lead(value, 1, -1.0) over (order by event_id desc) as w from events", lambda t: t("events").select("event_id", col("value").lead(1, -1.0).over(order_by="event_id", descending=True).alias("w")))
simple("whole_cum_sum", "select event_id, round(sum(value) over (order by event_id rows unbounded preceding), 2) as w from events", lambda t: t("events").select("event_id", col("value").cum_sum().over(order_by="event_id").round(2).alias("w")))


# converters, sinks and persisted frames
def _round_trip(t: Tables, back: Callable) -> LazyFrame:
    """Nation through another form of table and back."""
    return back(t("nation").select("n_nationkey", "n_name", "n_regionkey"))


_NATION = "select n_nationkey, n_name, n_regionkey from nation"
simple("from_arrow", _NATION, lambda t: _round_trip(t, lambda f: from_arrow(f.to_arrow())))
simple("from_pandas", _NATION, lambda t: _round_trip(t, lambda f: from_pandas(f.to_pandas())))
simple("compute", _NATION, lambda t: _round_trip(t, lambda f: LazyFrame(f.compute())))
simple("persisted", "select c_nationkey, count(*) as n from customer where c_acctbal > 0 group by 1", lambda t: t("customer").to_gpu().filter(col("c_acctbal") > 0).groupby("c_nationkey").agg(col("c_custkey").count().alias("n")))


@query("select c_custkey, c_mktsegment, c_nationkey from customer")
def csv_round_trip(t: Tables) -> LazyFrame:
    """Written as CSV to the folder that all machines share, and read with inferred types."""
    given = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    spark = given.df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top}/csv-{uuid.uuid4().hex}"
    given.write_csv(path)
    return read_csv(path, schema=given.schema)


@query("select signatures, errors, changed from (values (true, 0::bigint, true)) v(signatures, errors, changed)")
def plan_utilities(t: Tables) -> LazyFrame:
    """Equal plans have one signature, a good plan has no error, and two filters are merged."""
    one, two = (t("orders").filter(col("o_totalprice") > 1).filter(col("o_custkey") > 2) for _ in range(2))
    trace = optimize_plan(one).trace
    return from_arrow(pa.table({"signatures": [signature(one) == signature(two)], "errors": [len(validate_plan(one))], "changed": [any("Filter" in x for x in trace)]}))


# SQL
_SQL = {
    "sql_left_join": "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 400000",
    "sql_using": "select k, a.n as n, b.m as m from (select c_nationkey as k, count(*) as n from customer group by c_nationkey) a join (select s_nationkey as k, count(*) as m from supplier group by s_nationkey) b using (k)",
    "sql_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "sql_offset": "select c_custkey from customer order by c_acctbal desc, c_custkey limit 10 offset 5",
    "sql_exists": "select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity >= 49) and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')",
    "sql_sets": "(select c_nationkey as k from customer union select n_nationkey from nation) except select s_nationkey from supplier where s_acctbal < 0",
    "sql_intersect": "select l_suppkey as k from lineitem where l_quantity > 49 intersect select s_suppkey from supplier where s_acctbal > 0",
    "sql_arithmetic": "select s_suppkey, -s_acctbal as a, s_acctbal * 2 - 1.5 as b, (s_acctbal + s_nationkey) / 4 as c from supplier",
    "sql_from_subquery": "select flag, count(*) as n from (select l_returnflag as flag, l_quantity as q from lineitem) x where q > 40 group by flag",
    "sql_like": "select p_partkey from part where p_name like '%red%' or p_brand like 'Brand#1_'",
    "sql_select": "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as s from customer where c_acctbal > 0 and c_mktsegment not in ('MACHINERY') group by c_mktsegment having count(*) > 10 order by n desc, c_mktsegment limit 3",
    "sql_join": "select n.n_name, count(*) as n from supplier s join nation n on s.s_nationkey = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey where r.r_name like 'A%' group by n.n_name",
    "sql_case": "select o_orderstatus, cast(sum(case when o_totalprice > 200000 then 1 else 0 end) as bigint) as big, cast(sum(case when o_orderpriority between '1' and '3' then 1 end) as bigint) as urgent from orders group by o_orderstatus",
    "sql_subquery": "with top as (select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey) select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from top where q > (select 1.05 * avg(q) from top))",
    "sql_window": "select event_id, row_number() over (partition by user_id order by event_id) as rn from events where event_type = 'purchase'",
}
for _name, _text in _SQL.items():
    simple(_name, _text if _name != "sql_window" else _text, lambda t, text=_text: sql(text, **{n: t(n) for n in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem", "events")}))
QUERIES["sql_window"] = lambda spark, folder: sql(_SQL["sql_window"], events=tables(spark, folder)("events")).with_columns(col("rn").cast("bigint").alias("rn")).df

__all__ = ["ORACLES", "QUERIES", "day"]
