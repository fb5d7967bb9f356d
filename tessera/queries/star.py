"""22 decision-support queries over the star schema, in the frame API, with their SQL.

All stay lazy from end to end: scalars from subqueries are joined as one-row
aggregates, and nothing is collected between steps.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import call, col, lit, when
from ..operators import LazyFrame
from ..sources import table

Tables = Callable[[str], LazyFrame]


def tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: LazyFrame(table(spark, folder, name))


def day(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


REVENUE = col("l_extendedprice") * (1 - col("l_discount"))


def total(e, name: str, digits: int = 4):
    return e.sum().round(digits).alias(name)


def q1(t: Tables) -> LazyFrame:
    return (
        t("lineitem").filter(col("l_shipdate") <= day("1998-09-02")).groupby("l_returnflag", "l_linestatus")
        .agg(total(col("l_quantity"), "sum_qty", 2), total(col("l_extendedprice"), "sb", 2), total(REVENUE, "sd"), total(REVENUE * (1 + col("l_tax")), "sc", 6),
             col("l_quantity").mean().round(6).alias("aq"), col("l_discount").mean().round(8).alias("ad"), col("l_quantity").count().alias("n"))
    )


def q2(t: Tables) -> LazyFrame:
    part = t("part").filter((col("p_size") == 15) & (col("p_type") == "PROMO")).select("p_partkey")
    place = t("nation").join(t("region").filter(col("r_name") == "EUROPE"), left_on="n_regionkey", right_on="r_regionkey")
    supplier = t("supplier").join(place, left_on="s_nationkey", right_on="n_nationkey", how="semi")
    cost = (
        t("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").join(part, left_on="l_partkey", right_on="p_partkey", how="semi")
        .join(supplier.select("s_suppkey", "s_name", "s_acctbal"), left_on="l_suppkey", right_on="s_suppkey")
        .groupby(col("l_partkey").alias("p_partkey"), "l_suppkey", "s_name", "s_acctbal").agg(col("l_extendedprice").min().alias("cost"))
    )
    least = cost.with_columns(col("cost").min().over("p_partkey").alias("least")).filter(col("cost") == col("least"))
    return least.select("s_acctbal", "s_name", "p_partkey", "cost").sort("s_acctbal", "s_name", "p_partkey", descending=[True, False, False]).limit(100)


def q3(t: Tables) -> LazyFrame:
    cut = day("1997-03-15")
    orders = t("orders").filter(col("o_orderdate") < cut).join(t("customer").filter(col("c_mktsegment") == "BUILDING"), left_on="o_custkey", right_on="c_custkey", how="semi")
    lines = t("lineitem").filter(col("l_shipdate") > cut).join(orders.select("o_orderkey", "o_orderdate"), left_on="l_orderkey", right_on="o_orderkey")
    return lines.groupby("l_orderkey", "o_orderdate").agg(total(REVENUE, "revenue")).select("l_orderkey", "revenue", "o_orderdate").sort("revenue", "l_orderkey", descending=[True, False]).limit(10)


def q4(t: Tables) -> LazyFrame:
    orders = t("orders").filter((col("o_orderdate") >= day("1996-07-01")) & (col("o_orderdate") < day("1996-10-01")))
    late = t("lineitem").filter(col("l_returnflag") == "R")
    return orders.join(late, left_on="o_orderkey", right_on="l_orderkey", how="semi").groupby("o_orderpriority").agg(col("o_orderkey").count().alias("order_count"))


def q5(t: Tables) -> LazyFrame:
    nation = t("nation").join(t("region").filter(col("r_name") == "ASIA"), left_on="n_regionkey", right_on="r_regionkey").select("n_nationkey", "n_name")
    supplier = t("supplier").join(nation, left_on="s_nationkey", right_on="n_nationkey").select("s_suppkey", "s_nationkey", "n_name")
    orders = t("orders").filter((col("o_orderdate") >= day("1996-01-01")) & (col("o_orderdate") < day("1997-01-01"))).join(t("customer"), left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "c_nationkey")
    lines = t("lineitem").join(supplier, left_on="l_suppkey", right_on="s_suppkey")  # a fifth is left before anything large moves
    return lines.join(orders, left_on=["l_orderkey", "s_nationkey"], right_on=["o_orderkey", "c_nationkey"]).groupby("n_name").agg(total(REVENUE, "revenue"))


def q6(t: Tables) -> LazyFrame:
    kept = (col("l_shipdate") >= day("1996-01-01")) & (col("l_shipdate") < day("1997-01-01")) & col("l_discount").between(0.05, 0.07) & (col("l_quantity") < 24)
    return t("lineitem").filter(kept).agg(total(col("l_extendedprice") * col("l_discount"), "revenue"))


def q7(t: Tables) -> LazyFrame:
    lines = t("lineitem").filter((col("l_shipdate") >= day("1996-01-01")) & (col("l_shipdate") < day("1998-01-01")))
    nation = t("nation")
    supplier = t("supplier").join(nation, left_on="s_nationkey", right_on="n_nationkey").select("s_suppkey", col("n_name").alias("supp_nation"))
    customer = t("customer").join(nation, left_on="c_nationkey", right_on="n_nationkey").select("c_custkey", col("n_name").alias("cust_nation"))
    orders = t("orders").join(customer, left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "cust_nation")
    joined = lines.join(supplier, left_on="l_suppkey", right_on="s_suppkey").join(orders, left_on="l_orderkey", right_on="o_orderkey")
    return joined.groupby("supp_nation", "cust_nation", col("l_shipdate").year().alias("l_year")).agg(total(REVENUE, "revenue"))


def q8(t: Tables) -> LazyFrame:
    nation = t("nation").join(t("region").filter(col("r_name") == "AMERICA"), left_on="n_regionkey", right_on="r_regionkey")
    customer = t("customer").join(nation, left_on="c_nationkey", right_on="n_nationkey", how="semi")
    orders = t("orders").join(customer, left_on="o_custkey", right_on="c_custkey", how="semi").select("o_orderkey", "o_orderdate")
    lines = t("lineitem").join(t("part").filter(col("p_type") == "ECONOMY"), left_on="l_partkey", right_on="p_partkey", how="semi")
    joined = lines.join(orders, left_on="l_orderkey", right_on="o_orderkey").join(t("supplier").select("s_suppkey", "s_nationkey"), left_on="l_suppkey", right_on="s_suppkey")
    return joined.groupby(col("o_orderdate").year().alias("o_year")).agg(total(when(col("s_nationkey") == 2, REVENUE, 0.0), "nation_vol"), total(REVENUE, "total_vol"))


def q9(t: Tables) -> LazyFrame:
    part = t("part").filter(col("p_name").contains("red")).select("p_partkey", "p_retailprice")
    supplier = t("supplier").join(t("nation"), left_on="s_nationkey", right_on="n_nationkey").select("s_suppkey", "n_name")
    lines = t("lineitem").join(part, left_on="l_partkey", right_on="p_partkey").join(supplier, left_on="l_suppkey", right_on="s_suppkey")
    joined = lines.join(t("orders").select("o_orderkey", "o_orderdate"), left_on="l_orderkey", right_on="o_orderkey")
    return joined.groupby("n_name", col("o_orderdate").year().alias("o_year")).agg(total(REVENUE - col("p_retailprice") * 0.5 * col("l_quantity"), "sum_profit"))


def q10(t: Tables) -> LazyFrame:
    orders = t("orders").filter((col("o_orderdate") >= day("1996-10-01")) & (col("o_orderdate") < day("1997-01-01"))).select("o_orderkey", "o_custkey")
    lines = t("lineitem").filter(col("l_returnflag") == "R").join(orders, left_on="l_orderkey", right_on="o_orderkey")
    customer = t("customer").join(t("nation"), left_on="c_nationkey", right_on="n_nationkey").select("c_custkey", "c_name", "n_name")
    joined = lines.join(customer, left_on="o_custkey", right_on="c_custkey").groupby(col("o_custkey").alias("c_custkey"), "c_name", "n_name")
    return joined.agg(total(REVENUE, "revenue")).sort("revenue", "c_custkey", descending=[True, False]).limit(20)


def q11(t: Tables) -> LazyFrame:
    lines = t("lineitem").join(t("supplier").filter(col("s_nationkey") == 7), left_on="l_suppkey", right_on="s_suppkey", how="semi")
    value = lines.groupby("l_partkey").agg((col("l_extendedprice") * col("l_quantity")).sum().alias("value"))
    bar = value.agg((col("value").sum()).alias("all")).select((col("all") * 0.001).alias("bar"))
    return value.join(bar, how="cross").filter(col("value") > col("bar")).select("l_partkey", col("value").round(4).alias("value"))


def q12(t: Tables) -> LazyFrame:
    lines = t("lineitem").filter(col("l_returnflag").isin(["A", "R"]) & (col("l_shipdate") >= day("1996-01-01")) & (col("l_shipdate") < day("1997-01-01")))
    joined = lines.join(t("orders"), left_on="l_orderkey", right_on="o_orderkey").filter(col("o_orderdate") < col("l_shipdate"))
    urgent = col("o_orderpriority").isin(["1-URGENT", "2-HIGH"])
    return joined.groupby("l_linestatus").agg(when(urgent, 1, 0).sum().alias("high"), when(~urgent, 1, 0).sum().alias("low"))


def q13(t: Tables) -> LazyFrame:
    big = t("orders").filter(col("o_totalprice") > 250000).groupby("o_custkey").agg(col("o_orderkey").count().alias("n"))
    counted = t("customer").join(big, left_on="c_custkey", right_on="o_custkey", how="left").select(col("n").fill_null(0).cast("bigint").alias("c_count"))
    return counted.groupby("c_count").agg(col("c_count").count().alias("custdist"))


def q14(t: Tables) -> LazyFrame:
    lines = t("lineitem").filter((col("l_shipdate") >= day("1996-09-01")) & (col("l_shipdate") < day("1996-10-01")))
    joined = lines.join(t("part").select("p_partkey", "p_type"), left_on="l_partkey", right_on="p_partkey")
    return joined.agg(total(when(col("p_type").startswith("PROMO"), REVENUE, 0.0), "promo"), total(REVENUE, "tot"))


def q15(t: Tables) -> LazyFrame:
    revenue = t("lineitem").filter((col("l_shipdate") >= day("1996-01-01")) & (col("l_shipdate") < day("1996-04-01"))).groupby("l_suppkey").agg(total(REVENUE, "tr"))
    best = revenue.join(revenue.agg(col("tr").max().alias("most")), how="cross").filter(col("tr") == col("most"))
    return best.join(t("supplier"), left_on="l_suppkey", right_on="s_suppkey").select(col("l_suppkey").alias("s_suppkey"), "s_name", "tr")


def q16(t: Tables) -> LazyFrame:
    part = t("part").filter((col("p_brand") != "Brand#15") & ~col("p_type").startswith("MEDIUM") & col("p_size").isin([49, 14, 23, 45, 19, 3, 36, 9]))
    lines = t("lineitem").select("l_partkey", "l_suppkey").join(t("supplier").filter(col("s_acctbal") < 0), left_on="l_suppkey", right_on="s_suppkey", how="anti")
    joined = lines.join(part, left_on="l_partkey", right_on="p_partkey")
    return joined.groupby("p_brand", "p_type", "p_size").agg(col("l_suppkey").count_distinct().alias("supplier_cnt"))


def q17(t: Tables) -> LazyFrame:
    lines = t("lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(t("part").filter(col("p_brand") == "Brand#23"), left_on="l_partkey", right_on="p_partkey", how="semi")
    small = lines.with_columns(col("l_quantity").mean().over("l_partkey").alias("mean")).filter(col("l_quantity") < lit(0.5) * col("mean"))
    return small.agg((col("l_extendedprice").sum() / 7.0).round(4).alias("v"))


def q18(t: Tables) -> LazyFrame:
    large = t("lineitem").groupby("l_orderkey").agg(col("l_quantity").sum().alias("q")).filter(col("q") > 200)
    return large.join(t("orders"), left_on="l_orderkey", right_on="o_orderkey").select("o_custkey", "l_orderkey", "q")


def q19(t: Tables) -> LazyFrame:
    joined = t("lineitem").join(t("part").select("p_partkey", "p_brand", "p_type", "p_size"), left_on="l_partkey", right_on="p_partkey")

    def case(brand, types, low, size):
        return (col("p_brand") == brand) & col("p_type").isin(types) & col("l_quantity").between(low, low + 10) & col("p_size").between(1, size)

    any_case = case("Brand#12", ["SMALL", "PROMO"], 1, 15) | case("Brand#23", ["MEDIUM", "LARGE"], 10, 25) | case("Brand#4", ["LARGE", "ECONOMY"], 20, 35)
    return joined.filter(any_case).agg(total(REVENUE, "revenue"))


def q20(t: Tables) -> LazyFrame:
    lines = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate").join(t("part").filter(col("p_name").startswith("red")), left_on="l_partkey", right_on="p_partkey", how="semi")
    before = when(col("l_shipdate") < day("1997-01-01"), col("l_quantity"), lit(None).cast("double")).sum().over("l_partkey", "l_suppkey").alias("before")
    surplus = lines.with_columns(before).filter(col("l_quantity") > lit(0.5) * col("before"))
    return t("supplier").filter(col("s_nationkey").isin([3, 15, 7])).join(surplus, left_on="s_suppkey", right_on="l_suppkey", how="semi").select("s_name", "s_acctbal")


def q21(t: Tables) -> LazyFrame:
    """An order's other suppliers, and its other suppliers with returns, from one pass over the lines."""
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(t("orders").filter(col("o_orderstatus") == "F"), left_on="l_orderkey", right_on="o_orderkey", how="semi")
    late = when(col("l_returnflag") == "R", col("l_suppkey"), lit(None).cast("bigint"))
    span = lines.with_columns(
        col("l_suppkey").min().over("l_orderkey").alias("s0"), col("l_suppkey").max().over("l_orderkey").alias("s1"),
        late.min().over("l_orderkey").alias("r0"), late.max().over("l_orderkey").alias("r1"),
    )
    alone = span.filter((col("l_returnflag") == "R") & (col("s0") != col("s1")) & (col("r0") == col("r1")))
    return alone.groupby("l_suppkey").agg(col("l_suppkey").count().alias("n"))


def q22(t: Tables) -> LazyFrame:
    bar = t("customer").filter(col("c_acctbal") > 0).agg(col("c_acctbal").mean().alias("bar"))
    rich = t("customer").join(bar, how="cross").filter(col("c_acctbal") > col("bar"))
    idle = rich.join(t("orders").filter(col("o_totalprice") > 300000), left_on="c_custkey", right_on="o_custkey", how="anti")
    return idle.groupby(col("c_nationkey").alias("cc")).agg(col("c_acctbal").count().alias("n"), total(col("c_acctbal"), "t", 2))


def _registered(f: Callable[[Tables], LazyFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(tables(spark, folder)).df


QUERIES = {f.__name__: _registered(f) for f in (q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22)}

_R = "l_extendedprice*(1-l_discount)"
ORACLES = {
    "q1": f"select l_returnflag,l_linestatus,round(sum(l_quantity),2) sum_qty,round(sum(l_extendedprice),2) sb,round(sum({_R}),4) sd,round(sum({_R}*(1+l_tax)),6) sc,round(avg(l_quantity),6) aq,round(avg(l_discount),8) ad,count(*) n from lineitem where l_shipdate<=timestamp '1998-09-02 00:00:00' group by l_returnflag,l_linestatus",
    "q2": "with c as (select p_partkey,l_suppkey,min(l_extendedprice) cost from part join lineitem on l_partkey=p_partkey join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey where r_name='EUROPE' and p_size=15 and p_type='PROMO' group by p_partkey,l_suppkey), m as (select p_partkey pk,min(cost) mc from c group by p_partkey) select s_acctbal,s_name,p_partkey,cost from c join m on p_partkey=pk and cost=mc join supplier on s_suppkey=l_suppkey order by s_acctbal desc,s_name,p_partkey limit 100",
    "q3": f"select l_orderkey,round(sum({_R}),4) revenue,o_orderdate from customer join orders on c_custkey=o_custkey join lineitem on l_orderkey=o_orderkey where c_mktsegment='BUILDING' and o_orderdate<timestamp '1997-03-15 00:00:00' and l_shipdate>timestamp '1997-03-15 00:00:00' group by l_orderkey,o_orderdate order by revenue desc,l_orderkey limit 10",
    "q4": "select o_orderpriority,count(*) order_count from orders where o_orderdate>=timestamp '1996-07-01 00:00:00' and o_orderdate<timestamp '1996-10-01 00:00:00' and exists(select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R') group by o_orderpriority",
    "q5": f"select n_name,round(sum({_R}),4) revenue from customer join orders on c_custkey=o_custkey join lineitem on l_orderkey=o_orderkey join supplier on l_suppkey=s_suppkey and c_nationkey=s_nationkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey where r_name='ASIA' and o_orderdate>=timestamp '1996-01-01 00:00:00' and o_orderdate<timestamp '1997-01-01 00:00:00' group by n_name",
    "q6": "select round(sum(l_extendedprice*l_discount),4) revenue from lineitem where l_shipdate>=timestamp '1996-01-01 00:00:00' and l_shipdate<timestamp '1997-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity<24",
    "q7": f"select n1.n_name supp_nation,n2.n_name cust_nation,cast(year(l_shipdate) as bigint) l_year,round(sum({_R}),4) revenue from supplier join lineitem on s_suppkey=l_suppkey join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey join nation n1 on s_nationkey=n1.n_nationkey join nation n2 on c_nationkey=n2.n_nationkey where l_shipdate>=timestamp '1996-01-01 00:00:00' and l_shipdate<timestamp '1998-01-01 00:00:00' group by n1.n_name,n2.n_name,year(l_shipdate)",
    "q8": f"select cast(year(o_orderdate) as bigint) o_year,round(sum(case when s_nationkey=2 then {_R} else 0 end),4) nation_vol,round(sum({_R}),4) total_vol from lineitem join part on p_partkey=l_partkey join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey join supplier on s_suppkey=l_suppkey where r_name='AMERICA' and p_type='ECONOMY' group by year(o_orderdate)",
    "q9": f"select n_name,cast(year(o_orderdate) as bigint) o_year,round(sum({_R}-p_retailprice*0.5*l_quantity),4) sum_profit from lineitem join part on p_partkey=l_partkey join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey join orders on o_orderkey=l_orderkey where p_name like '%red%' group by n_name,year(o_orderdate)",
    "q10": f"select c_custkey,c_name,n_name,round(sum({_R}),4) revenue from customer join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey join nation on n_nationkey=c_nationkey where l_returnflag='R' and o_orderdate>=timestamp '1996-10-01 00:00:00' and o_orderdate<timestamp '1997-01-01 00:00:00' group by c_custkey,c_name,n_name order by revenue desc,c_custkey limit 20",
    "q11": "with v as (select l_partkey,sum(l_extendedprice*l_quantity) value from lineitem join supplier on s_suppkey=l_suppkey where s_nationkey=7 group by l_partkey) select l_partkey,round(value,4) as value from v where value>(select sum(value)*0.001 from v)",
    "q12": "select l_linestatus,cast(sum(case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 0 end) as bigint) high,cast(sum(case when o_orderpriority not in ('1-URGENT','2-HIGH') then 1 else 0 end) as bigint) low from lineitem join orders on o_orderkey=l_orderkey where l_returnflag in ('A','R') and o_orderdate<l_shipdate and l_shipdate>=timestamp '1996-01-01 00:00:00' and l_shipdate<timestamp '1997-01-01 00:00:00' group by l_linestatus",
    "q13": "select c_count,count(*) custdist from (select c_custkey,count(o_orderkey) c_count from customer left join orders on c_custkey=o_custkey and o_totalprice>250000 group by c_custkey) t group by c_count",
    "q14": f"select round(sum(case when p_type like 'PROMO%' then {_R} else 0 end),4) promo,round(sum({_R}),4) tot from lineitem join part on l_partkey=p_partkey where l_shipdate>=timestamp '1996-09-01 00:00:00' and l_shipdate<timestamp '1996-10-01 00:00:00'",
    "q15": f"with r as (select l_suppkey,round(sum({_R}),4) tr from lineitem where l_shipdate>=timestamp '1996-01-01 00:00:00' and l_shipdate<timestamp '1996-04-01 00:00:00' group by l_suppkey) select s_suppkey,s_name,tr from supplier join r on s_suppkey=l_suppkey where tr=(select max(tr) from r)",
    "q16": "select p_brand,p_type,p_size,count(distinct l_suppkey) supplier_cnt from lineitem join part on p_partkey=l_partkey where p_brand<>'Brand#15' and p_type not like 'MEDIUM%' and p_size in (49,14,23,45,19,3,36,9) and l_suppkey not in (select s_suppkey from supplier where s_acctbal<0) group by p_brand,p_type,p_size",
    "q17": "select round(sum(l_extendedprice)/7.0,4) v from lineitem join part on p_partkey=l_partkey where p_brand='Brand#23' and l_quantity<(select 0.5*avg(l_quantity) from lineitem x where x.l_partkey=p_partkey)",
    "q18": "select o_custkey,l_orderkey,sum(l_quantity) q from lineitem join orders on l_orderkey=o_orderkey where l_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity)>200) group by o_custkey,l_orderkey",
    "q19": f"select round(sum({_R}),4) revenue from lineitem join part on p_partkey=l_partkey where (p_brand='Brand#12' and p_type in ('SMALL','PROMO') and l_quantity between 1 and 11 and p_size between 1 and 15) or (p_brand='Brand#23' and p_type in ('MEDIUM','LARGE') and l_quantity between 10 and 20 and p_size between 1 and 25) or (p_brand='Brand#4' and p_type in ('LARGE','ECONOMY') and l_quantity between 20 and 30 and p_size between 1 and 35)",
    "q20": "select s_name,s_acctbal from supplier where s_nationkey in (3,15,7) and s_suppkey in (select l_suppkey from lineitem l where l_partkey in (select p_partkey from part where p_name like 'red%') and l_quantity>(select 0.5*sum(x.l_quantity) from lineitem x where x.l_partkey=l.l_partkey and x.l_suppkey=l.l_suppkey and x.l_shipdate<timestamp '1997-01-01 00:00:00'))",
    "q21": "select l_suppkey,count(*) n from lineitem l1 join orders on o_orderkey=l_orderkey where o_orderstatus='F' and l_returnflag='R' and exists(select 1 from lineitem l2 where l2.l_orderkey=l1.l_orderkey and l2.l_suppkey<>l1.l_suppkey) and not exists(select 1 from lineitem l3 where l3.l_orderkey=l1.l_orderkey and l3.l_suppkey<>l1.l_suppkey and l3.l_returnflag='R') group by l_suppkey",
    "q22": "select c_nationkey cc,count(*) n,round(sum(c_acctbal),2) t from customer where c_acctbal>(select avg(c_acctbal) from customer where c_acctbal>0) and not exists(select 1 from orders where o_custkey=c_custkey and o_totalprice>300000) group by c_nationkey",
}

__all__ = ["ORACLES", "QUERIES", "REVENUE", "call", "day", "tables", "total"]
