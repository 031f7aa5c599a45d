"""Scalar functions and extension types against plain Python on literal rows, odd values included."""

import datetime as dt
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from basalt.functions import routines, scalar, types
from basalt.operators import dml, numbering, relational, windows
from basalt.streaming import apply_changes


def addresses():
    rnd = random.Random(6)
    out = ["::", "::1", "1::", "::ffff:1.2.3.4", "1:0:0:2::", "0:0:1::0:0:1", "2001:db8::1:0:0:1", "fe80::", "10.0.0.1", "255.255.255.255", "0.0.0.0"]
    for _ in range(60):
        groups = [rnd.choice([0, 0, 0, 1, 0xABCD, rnd.randrange(65536)]) for _ in range(8)]
        out.append(ipaddress.IPv6Address(int.from_bytes(b"".join(g.to_bytes(2, "big") for g in groups), "big")).exploded)
    return out + [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(30)]


BAD = ["", "1.2.3", "1.2.3.256", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":::", "1:2:3:4:5:6:7:8::", "10.0.0.1/33", "::1/129", "1.2.3.4.5", "a.b.c.d", None]


def test_addresses_against_the_standard_library(spark):
    rnd = random.Random(7)
    rows = []
    for a in addresses():
        ip = ipaddress.ip_address(a)
        rows.append((a, f"{a}/{rnd.randint(0, ip.max_prefixlen)}"))
    df = spark.createDataFrame(rows, "a string, c string")
    c = F.col("c")
    told = df.select("a", "c", types.inet_key(F.col("a")).alias("k"), types.key_text(types.inet_key(F.col("a")), types.is_ip6(F.col("a"))).alias("t"), types.network(c).alias("n"), types.broadcast_address(c).alias("b"), types.supernet(c).alias("s")).collect()
    for r in told:
        ip, net = ipaddress.ip_address(r["a"]), ipaddress.ip_network(r["c"], strict=False)
        text = lambda x: str(x) if x.version == 4 else ipaddress.IPv6Address(int(x)).compressed
        want = "0" * 20 + "f" * 4 + ip.packed.hex() if ip.version == 4 else ip.packed.hex()
        assert r["k"] == want
        if "ffff:1.2" not in r["a"] and ":ffff:" not in text(ip):
            assert (r["t"], r["n"], r["b"]) == (text(ip), text(net.network_address), text(net.broadcast_address)), r
            up = net.supernet() if net.prefixlen else net
            assert r["s"] == f"{text(up.network_address)}/{up.prefixlen}"
    bad = spark.createDataFrame([(b,) for b in BAD], "a string").select(types.inet_key(F.col("a")).alias("k"), types.network(F.col("a")).alias("n"), types.cidr_contains(F.lit("10.0.0.0/8"), F.col("a")).alias("c")).collect()
    assert all(r["k"] is None and r["n"] is None and r["c"] is None for r in bad)


def test_blocks_against_the_standard_library(spark):
    rnd = random.Random(8)
    nets = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.64.0.0/10", "2001:db8::/32", "2001:db8:8000::/33", "fe80::/10", "10.0.0.1/32", "::1/128"]
    ips = ["10.0.0.1", "10.64.1.1", "11.0.0.0", "2001:db8::5", "2001:db8:ffff::", "fe80::1", "::1", None, "nonsense"] + [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(5)]
    a, b = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "i int, ip string"), spark.createDataFrame([(j, x) for j, x in enumerate(nets)], "j int, net string")

    def within(ip, net):
        try:
            return ipaddress.ip_address(ip) in ipaddress.ip_network(net)
        except ValueError:
            return False

    want = {(i, j) for i, x in enumerate(ips) for j, n in enumerate(nets) if x and within(x, n)}
    assert {(r["i"], r["j"]) for r in types.cidr_join(a, "ip", b, "net").collect()} == want
    left = [(r["i"], r["j"]) for r in types.cidr_join(a, "ip", b.where("j > 2"), "net", how="left").collect()]
    some = {(i, j) for i, j in want if j > 2}
    assert sorted(left, key=str) == sorted([*some, *((i, None) for i in range(len(ips)) if i not in {x for x, _ in some})], key=str)
    pairs = [(m, n) for m in nets for n in nets]
    told = spark.createDataFrame(pairs, "m string, n string").select("m", "n", types.cidr_contains(F.col("m"), F.col("n")).alias("c"), types.cidr_overlaps(F.col("m"), F.col("n")).alias("o")).collect()
    for r in told:
        m, n = ipaddress.ip_network(r["m"]), ipaddress.ip_network(r["n"])
        assert r["c"] == (m.version == n.version and n.subnet_of(m)) and r["o"] == (m.version == n.version and m.overlaps(n))


def test_similar_to_is_a_whole_match(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("xabc",)], "s string")
    assert [r[0] for r in df.select(scalar.similar_to(F.col("s"), "abc")).collect()] == [True, False, False]


def test_numbers(spark):
    df = spark.createDataFrame([(1e30, "x"), (-2.719, "2.675"), (0.29, "NaN"), (None, None)], "d double, s string")
    got = df.select(scalar.trunc_number(F.col("d"), 2), scalar.trunc_number(F.col("d"), -1), scalar.quantize("s", F.lit("0.01")), scalar.compare_decfloat("s", F.lit("1"))).collect()
    assert [tuple(r) for r in got] == [(1e30, 1e30, None, None), (-2.71, 0.0, "2.68", 2), (0.29, 0.0, "NaN", 3), (None, None, None, None)]


def test_json(spark):
    texts = ['{"a":1,"b":{"c":true,"d":[1,null]}}', "{}", "[1]", '"x"', "{", "1,2", '{"a":1}}', "", "nul", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalar.json_valid(F.col("t"))).collect()] == [True, True, True, True, False, False, False, False, False, None]
    row = spark.range(1).select(
        scalar.json_merge(F.lit(texts[0]), F.lit('{"d":2.5,"b":null}')), scalar.json_set(F.lit(texts[0]), "$.b.c", F.lit("x")), scalar.json_set(F.lit("{}"), "$.a.b", F.lit(1), "$.a.c", F.lit(None).cast("int")), scalar.json_array(F.lit('q"'), F.lit(1), F.lit(None))
    ).first()
    assert [json.loads(x) for x in row] == [{"a": 1, "d": 2.5, "b": None}, {"a": 1, "b": {"c": "x", "d": [1, None]}}, {"a": {"b": 1, "c": None}}, ['q"', 1, None]]


def test_parse_formats(spark):
    today = F.lit("1974-03-09").cast("date")
    rows = [("49-01-02", "RR-MM-DD", dt.datetime(2049, 1, 2)), ("50-01-02", "RR-MM-DD", dt.datetime(1950, 1, 2)), ("2001 5", "RRRR MM", dt.datetime(2001, 5, 9)), ("999", "YYY", dt.datetime(1999, 3, 9)), ("12 a.m.", "HH A.M.", dt.datetime(1974, 3, 9)), ("31.02.2020", "DD.MM.YYYY", None), ("x", "DD", None), ("10", "MM", dt.datetime(1974, 10, 9))]
    for text, pattern, want in rows:
        assert spark.range(1).select(scalar.parse_datetime(F.lit(text), pattern, today)).first()[0] == want, pattern


def test_zone_transitions_to_the_second(spark):
    got = [tuple(r) for r in relational.zone_transitions(spark, "Africa/Monrovia", "1971-12-01", "1972-02-01").collect()]
    assert [g[1] for g in got] == [dt.datetime(1972, 1, 7, 0, 44, 30), dt.datetime(1972, 2, 1)]


def test_refusals(spark):
    n = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="mixed"):
        relational.limited(n, first=1, rows_from=1)
    with pytest.raises(ValueError, match="ordinals"):
        relational.ordered_union(n, "k")
    with pytest.raises(ValueError, match="generated always"):
        dml.insert(n, n, identity={"k": "always"})
    with pytest.raises(Exception, match="(?i)recurs"):
        relational.recursive(spark, "t", ["n"], "SELECT CAST(1 AS BIGINT)", "SELECT count(*) FROM t", "SELECT * FROM t").collect()
    with pytest.raises(Exception):
        relational.recursive(spark, "t", ["n"], "SELECT 1", "SELECT n + 1 FROM t", "SELECT count(*) FROM t", depth=50).collect()


def test_plan_rows(spark):
    spark.range(10).createOrReplaceTempView("ten")
    lines = [r["text"] for r in relational.explain(spark, "SELECT count(*) FROM ten WHERE id > 3").orderBy("line").collect()]
    assert any("HashAggregate" in x for x in lines) and any("Filter" in x for x in lines)


def test_own_columns_clash_with_none(spark):
    names = ["k", "__hit", "__t", "__n", "__s", "__tie", "__range", "__at", "__row", "__state", "__clause"]
    t = spark.createDataFrame([tuple(range(i, i + len(names))) for i in range(6)], ", ".join(f"{n} int" for n in names))
    out, told = dml.update(t, {"__n": "0"}, "k < 4", ["k desc"], (1, 2))
    assert out.columns == names and sorted(r["k"] for r in out.where("__n = 0").collect()) == [2, 3] and told.count() == 2
    assert dml.delete(t, "k < 4", ["k"], (1, 3))[0].count() == 3
    merged = dml.merge(t, t.where("k > 3"), "t.k = s.k", [dml.Clause("matched", "delete"), dml.Clause("not matched by source", "update", {"__hit": "t.__hit + 100"})])[0]
    assert merged.columns == names and merged.where("__hit > 100").count() == 4 == merged.count()
    assert sorted(r["x"] for r in numbering.numbered(t, "x", ["k"]).collect()) == [1, 2, 3, 4, 5, 6]
    assert relational.singleton(t.limit(1)).columns == names
    assert apply_changes(t.withColumn("op", F.lit("U")), ["k"], "__n").count() == 6


def test_distinct_over_null_partitions(spark):
    t = spark.createDataFrame([(None, 1), (None, 1), (1, 2), (1, 3)], "g int, v int")
    got = windows.distinct_over(t, ["g"], n=F.count_distinct("v")).collect()
    assert sorted((r["g"] or 0, r["v"], r["n"]) for r in got) == [(0, 1, 1), (0, 1, 1), (1, 2, 2), (1, 3, 2)]


def test_merge_keeps_rows_that_no_clause_takes(spark):
    t, s = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y"), (7, "z"), (None, "n")], "k int, v string")
    out = dml.merge(t, s, "t.k = s.k", [dml.Clause("matched", "update", {"v": "s.v"}, "s.v = 'y'"), dml.Clause("not matched", "insert", {"k": "s.k", "v": "s.v"}, "s.k = 7")])[0]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "y"), (2, "b"), (None, "c"), (7, "z")]))


def test_uuids(spark):
    a, b = spark.range(1).select(routines.gen_uuid(1), routines.gen_uuid(7)).first()
    import uuid

    assert uuid.UUID(a).version == 1 and uuid.UUID(b).version == 7
    at = dt.datetime(1582, 10, 15) + dt.timedelta(microseconds=uuid.UUID(a).time // 10)
    assert abs(at - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(minutes=10)
