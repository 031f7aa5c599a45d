"""Rewrites against brute force on literal rows."""

import itertools
import operator

import pytest
from pyspark.sql import functions as F

from basalt.functions import scalar, types
from basalt.operators import dml, numbering, relational
from basalt.operators.quantified import quantified

OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _holds(x, op, kind, values):
    told = [None if x is None or v is None else OPS[op](x, v) for v in values]
    return {"any": any(t is True for t in told), "all": all(t is True for t in told), "not any": all(t is False for t in told), "not all": any(t is False for t in told)}[kind]


def test_quantified_truth_table(spark):
    sets = [s for n in range(3) for s in itertools.combinations_with_replacement((None, 1, 2, 3), n)]
    left = spark.createDataFrame([(i, x) for i in range(len(sets)) for x in (None, 2)], "g int, x int")
    right = spark.createDataFrame([(i, v) for i, s in enumerate(sets) for v in s], "g int, v int")
    for op in OPS:
        for kind in ("any", "all", "not any", "not all"):
            got = {(r["g"], r["x"]) for r in quantified(left, "x", op, kind, right, "v", ["g"]).collect()}
            want = {(i, x) for i, s in enumerate(sets) for x in (None, 2) if _holds(x, op, kind, s)}
            assert got == want, (op, kind)


def test_unlist(spark):
    rows = [("1,2,3",), ("1,,2,",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    out = [r[0] for r in df.select(relational.unlist(F.col("s"))).collect()]
    assert out == [["1", "2", "3"], ["1", "2"], [], None]
    assert df.select(F.explode(relational.unlist(F.col("s"), ""))).count() == 3
    assert df.select(F.explode(relational.unlist(F.col("s"), None))).count() == 0


def test_ranges_by_brute_force(spark):
    texts = [f"{a}{lo},{hi}{b}" for a in "[(" for b in "])" for lo in ("", 0, 1, 2) for hi in ("", 0, 1, 2)] + ["empty"]
    points = [x / 2 for x in range(-4, 9)]

    def members(t):
        if t == "empty":
            return set()
        lo, hi = t[1:-1].split(",")
        return {p for p in points if (lo == "" or p > int(lo) or (t[0] == "[" and p == int(lo))) and (hi == "" or p < int(hi) or (t[-1] == "]" and p == int(hi)))}

    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = types.parse_range(F.col("a"), "double"), types.parse_range(F.col("b"), "double")
    for r in df.select("a", "b", types.range_overlaps(a, b).alias("o"), types.range_contains_range(a, b).alias("c"), types.range_left(a, b).alias("l")).collect():
        x, y = members(r["a"]), members(r["b"])
        assert r["o"] == bool(x & y), (r["a"], r["b"])
        assert r["l"] == bool(x and y and max(x) < min(y)), (r["a"], r["b"])
        assert r["c"] == bool(y and y <= x), (r["a"], r["b"])


def test_union_types_and_nulls(spark):
    a, b = spark.createDataFrame([(1, 2.5)], "x int, y double"), spark.createDataFrame([("z", None)], "x string, y int")
    out = relational.union(a, b)
    assert dict(out.dtypes) == {"x": "string", "y": "double"}
    with pytest.raises(TypeError):
        relational.union(a, spark.createDataFrame([(True, 1.0)], "x boolean, y double"))


def test_merge_rejects_two_sources(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="more than one source row"):
        dml.merge(t, s, "t.k = s.k", [dml.Clause("matched", "update", {"v": "s.v"})])[0].collect()
    assert {tuple(r) for r in dml.merge(t, s, "t.k = s.k", [dml.Clause("not matched by source", "delete")])[0].collect()} == {(1, "a")}


def test_limited_rows_among_equal_ones(spark):
    """Repeated rows and nulls: exactly the rows asked for change, whatever is equal to them."""
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b")], "k int, v string")
    new, told = dml.update(t, {"v": "'x'"}, "v = 'a'", ["k desc"], (2, 3))
    assert sorted(map(str, (tuple(r) for r in new.collect()))) == sorted(map(str, [(1, "x"), (1, "x"), (1, "a"), (None, "a"), (None, None), (2, "b")]))
    assert told.count() == 2
    left, gone = dml.delete(t, None, ["k"], (1, 3))
    assert sorted(map(str, (tuple(r) for r in gone.collect()))) == sorted(map(str, [(None, None), (None, "a"), (1, "a")])) and left.count() == 3
    assert dml.delete(t, "false", ["k"], (1, 3))[0].count() == 6


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN null ELSE id END AS k", "id")
    got = sorted((r["n"], r["k"]) for r in numbering.numbered(rows, "n", ["k desc nulls last"], 10, 2).collect())
    assert [n for n, _ in got] == list(range(10, 10010, 2))
    known = [k for _, k in got if k is not None]
    assert known == sorted(known, reverse=True) and all(k is None for _, k in got[len(known) :])
    assert numbering.numbered(rows.limit(0), "n").count() == 0


def test_upsert_matches_null(spark):
    t = spark.createDataFrame([(None, "a"), (2, "b")], "k int, v string")
    new, told = dml.update_or_insert(t, spark.createDataFrame([(None, "n")], "k int, v string"), ["k"])
    assert {tuple(r) for r in new.collect()} == {(None, "n"), (2, "b")} and told.count() == 1


def test_singleton(spark):
    assert relational.singleton(spark.range(1)).count() == 1
    with pytest.raises(Exception, match="multiple rows"):
        relational.singleton(spark.range(3)).collect()


def test_format_patterns(spark):
    row = spark.sql("SELECT timestamp_ntz '2023-05-09 13:04:05.678900' AS t").select(
        *(scalar.format_datetime(F.col("t"), p).alias(p) for p in ("DDDDD", "RM", "HH12 A.M.", "SSSSS", "FF2", "J", "W", '"Y"YY', "DY"))
    )
    assert list(row.first()) == ["12909", "V", "01 P.M.", "47045", "67", "2460074", "2", "Y23", "Tue"]


def test_text_query(spark):
    df = spark.createDataFrame([("the quick brown fox",), ("quick the fox",), ("",), (None,)], "s string")
    v = types.tsvector(F.col("s"))
    ask = lambda q: [r[0] for r in df.select(types.ts_matches(v, types.to_tsquery(q))).collect()]
    assert ask("quick & fox") == [True, True, False, None]
    assert ask("the <-> quick") == [True, False, False, None]
    assert ask("quick <2> fox | (the & !quick)") == [True, True, False, None]
    assert types.to_tsquery("a & !b").nodes() == 4
