"""Operators of the lazy frame on small tables: values, nulls and errors."""

import pyarrow as pa
import pytest

import tessera as ts
from tessera import LazyFrame, col, lit, row_number, when


#: (depot, kilograms) of parcels, most of them at one depot.
LOADS = [("north", 0.5), ("north", 2.25), ("north", 4.0), ("east", 1.75), ("north", 8.5), ("south", 6.0), ("east", 3.5)]
#: (parcel, van, fee); vans 7 and 9 carry parcels, van 8 none, and no van 12 is known.
PARCELS = [(101, 7, 2.5), (102, 9, 4.0), (103, 7, 1.25), (104, 12, 9.0), (105, 7, 3.0), (106, 9, 0.75), (107, 7, 6.5)]
VANS = [(7, "blue"), (8, "grey"), (9, "red")]


@pytest.fixture
def grouped(spark):
    return ts.from_arrow(pa.table({"g": [g for g, _ in LOADS], "v": [v for _, v in LOADS]}))


@pytest.fixture
def parcels(spark):
    return ts.from_arrow(pa.table({n: [p[i] for p in PARCELS] for i, n in enumerate(("parcel", "van", "fee"))}))


@pytest.fixture
def vans(spark):
    return ts.from_arrow(pa.table({n: [v[i] for v in VANS] for i, n in enumerate(("van", "paint"))}))


@pytest.fixture
def nulls(spark):
    return ts.from_arrow(pa.table({"k": pa.array([1, None, 2, None], pa.int64()), "v": pa.array([None, 1.0, 2.0, 3.0])}))


def got(frame, *sort):
    return frame.sort(*sort).to_arrow().to_pylist() if sort else frame.to_arrow().to_pylist()


def test_five_grouped_aggregates(grouped):
    found = got(grouped.groupby("g").agg(col("v").sum().alias("s"), col("v").min().alias("a"), col("v").max().alias("z"), col("v").mean().alias("m"), col("v").count().alias("n")), "g")
    by = {g: [v for k, v in LOADS if k == g] for g in sorted({g for g, _ in LOADS})}
    assert found == [{"g": g, "s": sum(v), "a": min(v), "z": max(v), "m": sum(v) / len(v), "n": len(v)} for g, v in by.items()]


def test_default_names(grouped):
    assert grouped.select("v", col("v") + 1).columns == ["v", "col_1"]
    assert grouped.groupby("g").agg(col("v").sum(), col("v").max()).columns == ["g", "agg_0", "agg_1"]


def test_filter_then_global(grouped):
    sums = [col("v").sum().alias("s"), col("v").count().alias("n")]
    over = [v for _, v in LOADS if v > 3]
    assert got(grouped.filter(col("v") > 3).agg(*sums)) == [{"s": sum(over), "n": len(over)}]
    assert got(grouped.filter(col("v") > 99).agg(*sums)) == [{"s": None, "n": 0}]


def test_unknown_operation(grouped):
    with pytest.raises(NotImplementedError, match="stddev"):
        grouped.groupby("g").agg(ts.Expr("stddev", col("v")))
    with pytest.raises(NotImplementedError, match="year"):
        grouped.select(col("v").year().over("g").alias("w"))


def test_joins(parcels, vans):
    known = {v for v, _ in VANS}
    assert parcels.join(vans, on="van").to_arrow().num_rows == sum(v in known for _, v, _ in PARCELS)
    left = got(vans.join(parcels, on="van", how="left"), "van", "parcel")
    wanted = [{"van": v, "paint": c, "parcel": p, "fee": f} for v, c in VANS for p, f in ([(p, f) for p, w, f in PARCELS if w == v] or [(None, None)])]
    assert left == wanted
    assert got(vans.join(parcels, on="van", how="anti")) == [{"van": 8, "paint": "grey"}]
    assert vans.join(parcels, on="van", how="semi").columns == ["van", "paint"]
    other = ts.from_arrow(pa.table({"id": [7, 99], "w": [1, 2]}))
    assert parcels.join(other, left_on="van", right_on="id").columns == ["parcel", "van", "fee", "w"]
    full = got(vans.join(other.select(col("id").alias("van"), "w"), on="van", how="full"), "van")
    assert [r["van"] for r in full] == [7, 8, 9, 99]


def test_many_to_many_and_strings(spark):
    a, b = ts.from_arrow(pa.table({"k": [1, 1, 2], "a": [1, 2, 3]})), ts.from_arrow(pa.table({"k": [1, 1, 2], "b": [4, 5, 6]}))
    assert a.join(b, on="k").to_arrow().num_rows == 5
    c, d = ts.from_arrow(pa.table({"s": ["a", "b"]})), ts.from_arrow(pa.table({"s": ["b", "a", "c"], "n": [1, 2, 3]}))
    assert got(c.join(d, on="s"), "s") == [{"s": "a", "n": 2}, {"s": "b", "n": 1}]


def test_join_errors(parcels, vans):
    for bad in ({"on": "van", "left_on": "van"}, {}, {"left_on": ["a", "b"], "right_on": ["a"]}, {"on": "zzz"}, {"on": "van", "how": "asof"}, {"how": "cross", "on": "van"}):
        with pytest.raises(ValueError):
            parcels.join(vans, **bad)
    with pytest.raises(ValueError, match="suffix"):
        parcels.join(parcels, on="van")
    assert parcels.join(parcels, on="van", suffix="_r").columns == ["parcel", "van", "fee", "parcel_r", "fee_r"]


def test_null_semantics(nulls):
    assert nulls.join(nulls, on="k", suffix="_r").to_arrow().num_rows == 2
    assert [r["k"] for r in got(nulls.sort("k"))] == [1, 2, None, None]
    assert [r["k"] for r in got(nulls.sort("k", descending=True))] == [2, 1, None, None]
    assert len(got(nulls.groupby("k").agg(col("v").sum().alias("s")))) == 3
    assert got(nulls.agg(col("v").count().alias("n"))) == [{"n": 4}]
    assert len(got(nulls.filter((col("v") > 0) | (lit(1) == 1)))) == 4
    assert len(got(nulls.filter(~col("k").isin([1])))) == 1
    assert [r["w"] for r in got(nulls.select(when(col("v") > 1, 1).alias("w")))] == [0, 0, 1, 1]


def test_division(nulls):
    assert got(nulls.filter(col("v") == 1).select((col("v") / 0).alias("z"), (lit(7) / 2).alias("h"))) == [{"z": None, "h": 3.5}]


def test_sort_limit_tail(grouped):
    assert [r["v"] for r in got(grouped.sort("v", descending=True).limit(2))] == sorted((v for _, v in LOADS), reverse=True)[:2]
    assert [r["v"] for r in got(grouped.sort("v").tail(2))] == sorted(v for _, v in LOADS)[-2:]
    assert [r["v"] for r in got(grouped.sort("g", "v", descending=[True, False]))] == [v for g in ("south", "north", "east") for v in sorted(v for k, v in LOADS if k == g)]
    assert grouped.head().to_arrow().num_rows == 5 and grouped.tail(99).to_arrow().num_rows == len(LOADS)
    for bad in (lambda: grouped.limit(-1), lambda: grouped.tail(-1), lambda: grouped.sort(), lambda: grouped.sort("v", descending=[True, False]), lambda: grouped.select(), lambda: grouped.filter(None), lambda: grouped.distinct("g", "g"), lambda: grouped.groupby("g").agg(), lambda: LazyFrame(3)):
        with pytest.raises(ValueError):
            bad()


def test_tail_of_an_unsorted_frame_is_lazy(spark):
    """The last rows by position, without a job while it is built and without moving the others."""
    frame = LazyFrame(spark.range(0, 1000, 1, 7))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    last = frame.tail(3)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert [r["id"] for r in got(last)] == [997, 998, 999]
    assert "TakeOrderedAndProject" in last.df._jdf.queryExecution().executedPlan().toString()


def test_distinct_returns_the_subset(grouped):
    assert got(grouped.distinct("g"), "g") == [{"g": g} for g in sorted({g for g, _ in LOADS})]


def test_with_columns_moves_replaced(grouped):
    frame = grouped.with_columns((col("g")).alias("g"), row_number().alias("n"))
    assert frame.columns == ["v", "g", "n"] and sorted(r["n"] for r in got(frame)) == list(range(1, len(LOADS) + 1))


def test_windows(grouped):
    found = got(grouped.with_columns(col("v").sum().over("g", order_by="v").alias("s"), col("v").rank().over("g", order_by="v", descending=True).alias("r"), col("v").lag().over("g", order_by="v").alias("p"), col("v").cum_sum().over("g", order_by="v").alias("c")), "v")
    for r in found:
        own = sorted(v for g, v in LOADS if g == r["g"])
        k = own.index(r["v"])
        assert (r["s"], r["r"], r["p"], r["c"]) == (sum(own), k + 1, own[k - 1] if k else None, sum(own[: k + 1]))


def test_describe(spark):
    frame = ts.from_arrow(pa.table({"a": pa.array([1.0, 2.0, 4.0, None, float("nan")]), "b": [5, 5, 5, 5, 5], "s": list("abcde")}))
    found = {r["statistic"]: r for r in got(frame.describe())}
    assert found["count"]["a"] == 3 and found["25%"]["a"] == 1.5 and found["max"]["a"] == 4.0 and found["std"]["b"] == 0.0 and "s" not in found["count"]
    one = {r["statistic"]: r for r in got(frame.limit(1).select("b").describe())}
    assert one["std"]["b"] == 0.0


def test_expressions_are_values():
    e = col("a")
    e.alias("b")
    assert e.name is None and (col("a") + 1).signature() == (col("a") + 1).alias("x").signature()
    with pytest.raises(TypeError):
        bool(col("a") == 1)


def test_sql_binds_names_for_the_call_only(spark, grouped):
    spark.range(1).createOrReplaceTempView("g1")
    assert ts.sql("select sum(v) as s from g1", g1=grouped).to_arrow().to_pylist() == [{"s": sum(v for _, v in LOADS)}]
    assert spark.table("g1").columns == ["id"]


def test_readers(spark, grouped, tmp_path):
    grouped.write_parquet(str(tmp_path / "p"))
    grouped.write_csv(str(tmp_path / "c"))
    assert ts.read_parquet(str(tmp_path / "p")).schema["v"].dataType.simpleString() == "double"
    assert got(ts.read_csv(str(tmp_path / "c")), "v") == got(grouped, "v")
    assert got(ts.from_pandas(grouped.to_pandas()), "v") == got(grouped, "v")


def test_plans(spark, grouped, tmp_path):
    grouped.write_parquet(str(tmp_path / "g"))
    grouped = ts.read_parquet(str(tmp_path / "g"))
    frame = grouped.filter(col("v") > 1).filter(col("v") > 2).limit(5).limit(3)
    assert ts.validate_plan(frame) == []
    assert "Filter: 2 -> 1" in ts.optimize_plan(frame).trace
    assert "PhysicalPlan" in frame.explain(validate=True, include_runtime=True)
    assert ts.signature(grouped.filter(col("v") > 1)) == ts.signature(grouped.filter(col("v") > 1))
    frame.compute(device="cpu")
    assert frame.last_compile_provenance["rows"] == 3
    cached = grouped.to_gpu()
    assert got(cached.filter(col("v") > 1).agg(col("v").sum().alias("s"))) == [{"s": sum(v for _, v in LOADS if v > 1)}]
    cached.release()
    assert ts.warmup() > 0


def test_year_of_integers_and_dates(spark):
    import datetime

    frame = ts.from_arrow(pa.table({"i": pa.array([19970315], pa.int32()), "d": [datetime.date(1998, 1, 2)]}))
    assert got(frame.select(col("i").year().alias("a"), col("d").year().alias("b"))) == [{"a": 1997, "b": 1998}]


def test_pushdown(spark):
    from oracle import DATA

    plan = ts.read_parquet(f"{DATA}/lineitem.parquet").filter(col("l_quantity") > 49).select("l_orderkey").explain()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_plan_nodes(parcels, vans):
    paid = ts.Aggregate(ts.Join(ts.Filter(parcels, col("fee") > 2), vans, ["van"], ["van"]), ["paint"], [col("fee").sum().alias("s")])
    sums = {c: sum(f for _, w, f in PARCELS if w == v and f > 2) for v, c in VANS}
    assert got(LazyFrame(ts.Limit(ts.Sort(paid, ["s"], [True]), 2))) == [{"paint": c, "s": x} for c, x in sorted(sums.items(), key=lambda x: -x[1])[:2]]
    assert [r["van"] for r in got(ts.Distinct(ts.Project(ts.Scan(parcels), ["van"])), "van")] == sorted({v for _, v, _ in PARCELS})
    assert got(ts.Tail(ts.Sort(parcels, ["parcel"]), 1))[0]["parcel"] == max(p for p, *_ in PARCELS)


def test_whole_table_windows_are_spread(spark):
    import random

    rng = random.Random(3)
    values = [None if rng.random() < 0.1 else float(rng.randint(0, 60)) for _ in range(500)]
    frame = LazyFrame(spark.createDataFrame([(i, v, str(v)) for i, v in enumerate(values)], "i long, v double, s string").repartition(4))
    found = frame.select("i", "v", col("v").rank().alias("rank"), row_number().over(order_by=["v", "i"], descending=True).alias("down"), (col("v").cum_sum().over(order_by="i") + 0).alias("run"), row_number().alias("any"), col("s").rank().alias("text"), col("v").dense_rank().alias("dense"))
    plan = frame.select(col("v").rank().alias("r")).df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan
    for e in (col("v").dense_rank(), col("s").rank(), col("v").lag(2).over(order_by="i"), col("v").lead().over(order_by="i")):
        found_plan = frame.select(e.alias("x")).df._jdf.queryExecution().executedPlan().toString()
        assert "Window" in found_plan and not any("Exchange SinglePartition" in a and "HashAggregate" not in b for a, b in zip(found_plan.splitlines(), found_plan.splitlines()[1:], strict=False))
    rows = got(found, "i")
    order = sorted(range(500), key=lambda i: (values[i] is None, values[i]))
    total = 0.0
    for r in rows:
        total += r["v"] or 0.0
        less = sum(x is not None and (r["v"] is None or x < r["v"]) for x in values)
        assert r["rank"] == less + 1 and r["run"] == total
    assert [values[i] for i in order] == [r["v"] for r in sorted(rows, key=lambda r: r["rank"])]
    down = sorted(rows, key=lambda r: r["down"])
    assert [r["down"] for r in down] == list(range(1, 501)) and [r["i"] for r in down] == [i for i in sorted(range(500), key=lambda i: (values[i] is None, -(values[i] or 0), -i))]
    assert sorted(r["any"] for r in rows) == list(range(1, 501)) and {r["dense"] for r in rows} == set(range(1, len(set(values)) + 1))
