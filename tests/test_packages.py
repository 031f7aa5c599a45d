"""Packages, outcomes, batches, and what the plans show."""

import pytest
from pyspark.sql import functions as F

from basalt import packages
from basalt.packages import Blob, Profiler, outcome, routine
from basalt.plans.catalogue import QUERIES
from basalt.sources import Batch, Links

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_blob_handles():
    b = routine("rdb$blob_util.new_blob")()
    b.append(b"hello ")
    b.append(b"world")
    assert b.is_writable() and b.close() == b"hello world" and not b.is_writable()
    r = Blob(b"hello world")
    assert r.seek(2, -5) == 6 and r.read(3) == b"wor" and r.seek(1, -1) == 8 and r.read() == b"rld" and r.read(1) is None
    with pytest.raises(ValueError):
        r.append(b"x")
    r.close()
    with pytest.raises(ValueError):
        r.read()


def test_profiler(spark):
    p = Profiler(spark)
    p.run("SELECT 1")
    assert p.start_session("one") == 1
    p.run("SELECT explode(sequence(1, 5))")
    p.pause()
    p.run("SELECT 2")
    p.resume()
    p.run("SELECT 3")
    p.finish_session()
    assert [(r["statement"], r["row_count"]) for r in p.statements().orderBy("statement").collect()] == [(1, 5), (2, 1)]
    p.start_session("two")
    p.run("SELECT 4")
    p.cancel_session()
    p.flush()
    assert p.statements().count() == 2


def test_outcomes(spark):
    assert outcome(lambda: spark.range(7)).row_count == 7
    bad = outcome(lambda: spark.sql("SELECT 1 / 0 AS x, id FROM range(3)").where("x > 1"))
    assert (bad.sqlcode, bad.sqlstate, bad.gdscode) == (-1, "22012", "DIVIDE_BY_ZERO")
    assert outcome(lambda: spark.sql("SELECT nothing")).sqlstate == "42703"


def test_package_names(spark):
    assert sorted(packages.PACKAGES) == ["RDB$BLOB_UTIL", "RDB$PROFILER", "RDB$SQL", "RDB$TIME_ZONE_UTIL"]
    assert packages.database_version(spark)[:2] == "20"
    assert routine("RDB$SQL.EXPLAIN")(spark, "SELECT 1").count() > 0


def test_batch_stops_at_the_first_error(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    for multi, want in ((False, [1, 2]), (True, [1, 2, 4])):
        b = Batch(t, multi_error=multi, most=3)
        for row in ((2, "b"), ("x", "c"), (4, "d")):
            b.add(*row)
        with pytest.raises(ValueError):
            b.add(5, "e")
        new, status = b.execute()
        assert sorted(r["k"] for r in new.collect()) == want and status[0] == 1 and isinstance(status[1], str)


def test_predicates_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        text = plan(QUERIES["pushed_and_or_in"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(x for x in text.splitlines() if "PushedFilters" in x)
    pushed, read = scan.split("PushedFilters")[1].split("ReadSchema")
    for part in ("Or(", "And(", "EqualTo(o_orderstatus,F)", "GreaterThan(o_totalprice,150000", "In(o_orderkey, [", "In(o_custkey, [", "GreaterThanOrEqual(o_orderkey,20)", "Not(EqualTo(o_orderstatus,O))"):
        assert part in pushed, part
    assert "o_orderpriority" not in read


def test_hints_choose_the_join(spark):
    for name, join in (("join_broadcast_hint", "BroadcastHashJoin"), ("join_hash_hint", "ShuffledHashJoin"), ("join_loop_hint", "CartesianProduct"), ("join_merge_hint", "SortMergeJoin")):
        assert join in plan(QUERIES[name](spark, DATA)), name


def test_an_invariant_subquery_runs_once(spark):
    spark.range(100).createOrReplaceTempView("hundred")
    df = spark.sql("SELECT id, (SELECT max(id) FROM hundred) AS a FROM hundred WHERE id > (SELECT max(id) FROM hundred) - 3")
    assert df.count() == 3
    df.collect()
    assert "ReusedSubquery" in plan(df)


def test_approximate_counts_are_partial(spark):
    df = spark.range(1000).groupBy((F.col("id") % 3).alias("k")).agg(F.approx_count_distinct("id"))
    assert plan(df).count("HashAggregate") >= 2


def test_link_names():
    links = Links(current="a.b", home="h", user="u")
    links.add("l", "/x", mode="hierarchical", local="a.b", remote="r")
    assert links.remote_name("a.b.c.t", "L") == "r.c.t" and links.remote_name("a.b.t", "l") == "r.t"
    with pytest.raises(ValueError):
        links.remote_name("a.bc.t", "l")
    links.alter("l", "none")
    assert links.remote_name("a.b.t", "l") == "t"
    links.add("j", mode="context_aware", remote="CURRENT.x.HOME", url="jdbc:none")
    assert links.remote_name("t", "j") == "a.b.x.h.t"
    for bad in ({"root": "/x", "url": "y"}, {}, {"root": "/x", "mode": "odd"}):
        with pytest.raises(ValueError):
            links.add("k", **bad)
