"""What grows with the tables: joins of whole keys, keys past one address group, vectors of long texts."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from basalt.functions import scalar, types
from basalt.operators import relational
from basalt.plans.catalogue import QUERIES, SQL

LARGE = ["cidr6_left_join", "inet6_classes", "inet6_functions"]


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["inner", "full"])
def test_cells_give_every_pair_once(spark, monkeypatch, how, null_safe):
    monkeypatch.setattr(relational, "CELL_ROWS", 3)
    keys_a, keys_b = [1] * 20 + [2] * 7 + [None] * 5 + [8], [1] * 10 + [2] + [None] * 4 + [9, 9]
    a = spark.createDataFrame(list(enumerate(keys_a)), "a int, j int").union(spark.createDataFrame([(0, 1)], "a int, j int"))
    b = spark.createDataFrame(list(enumerate(keys_b)), "b int, k int")
    same = lambda x, y: x == y and (null_safe or x is not None)
    rows_a, rows_b = [*enumerate(keys_a), (0, 1)], list(enumerate(keys_b))
    want = [x + y for x in rows_a for y in rows_b if same(x[1], y[1])]
    if how == "full":
        want += [(*x, None, None) for x in rows_a if not any(same(x[1], y[1]) for y in rows_b)] + [(None, None, *y) for y in rows_b if not any(same(x[1], y[1]) for x in rows_a)]
    out = relational.cell_join(a, b, ("j", "k"), how, null_safe)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_a_hot_key_is_dealt_over_partitions(spark):
    a, b = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") % 1).alias("j")), spark.range(9_000).select(F.col("id").alias("b"), (F.col("id") % 1).alias("k"))
    parts = relational.cell_join(a, b, ("j", "k"), null_safe=True).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 90_000_000 and max(r["count"] for r in parts) < 60_000_000


def test_cells_of_empty_tables(spark):
    a, b = spark.createDataFrame([(1, 1)], "a int, j int"), spark.createDataFrame([], "b int, k int")
    assert [tuple(r) for r in relational.cell_join(a, b, ("j", "k"), "full").collect()] == [(1, 1, None, None)]
    assert relational.cell_join(b, a, ("k", "j")).count() == 0


def test_addresses_of_large_keys(spark, tmp_path):
    """Customers past one group of an IPv6 address (65,535)."""
    keys = [1, 2, 4, 65534, 65535, 65536, 65542, 65543, 65544, 65545, 70001, 899_999, 5_399_998]
    spark.createDataFrame([(k, k % 25) for k in keys], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in range(25)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    c = duckdb.connect()
    for t in ("customer", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in LARGE:
        df = QUERIES[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)), name


def test_a_phrase_in_a_text_of_many_hits(spark):
    """80,000 hits of each word: pairs of hits would be 6.4 thousand million."""
    df = spark.range(1).select(types.tsvector(F.concat(F.repeat(F.lit("of x the y "), 80_000), F.lit("of the"))).alias("v"))
    started = time.time()
    got = df.select(types.ts_matches(F.col("v"), types.phraseto_tsquery("of the")), types.ts_matches(F.col("v"), types.phraseto_tsquery("the of x")), types.ts_matches(F.col("v"), types.to_tsquery("x <2> y <1> of"))).collect()[0]
    assert tuple(got) == (True, False, True) and time.time() - started < 60


def test_the_sketch_is_apart_from_the_exact_count(spark):
    plan = QUERIES["approximate_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "HashAggregate" in line and "l_orderkey" in line.split("functions=")[0]]
    assert keys and not any("approx_count_distinct" in line for line in keys)
    assert "approx_count_distinct" in plan


@pytest.mark.parametrize("name", ["inet_functions", "fn_cast_from_format_zone"])
def test_long_expressions_run_on_all_cores(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_parts_of_a_time_are_matched_once(spark):
    df = spark.createDataFrame([("2023-05-06 07:08 +02:30",), ("2023-05-06 07:08",), ("\x01",), (None,)], "t string").select(scalar.parse_datetime(F.col("t"), "YYYY-MM-DD HH24:MI TZH:TZM").alias("p"))
    assert [str(r["p"]) for r in df.collect()] == ["2023-05-06 04:38:00", "None", "None", "None"]
    assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()
