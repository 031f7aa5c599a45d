"""The registered queries of the relational surface, each with the SQL that gives the same rows.

``both`` registers a text that the two dialects share; ``pair`` a function
of DataFrames and the other side's text.  Amounts are summed as decimals, so
results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt import streaming
from basalt.functions import routines, scalar, types
from basalt.operators import dml, numbering, quantified, relational, windows
from basalt.plans.registry import QUERIES, SQL, both, pair
from basalt.sources import Links, Schemas, read_table, register, virtual

# --- scans, projections, filters

both(
    "flagship_revenue",
    """WITH r AS (SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n_name HAVING count(*) > 1)
       SELECT n_name, revenue, CAST(rank() OVER (ORDER BY revenue DESC) AS BIGINT) AS rnk FROM r ORDER BY revenue DESC, n_name LIMIT 10""",
)
both("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
both("where_between_in_like", r"SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_size IN (5, 7, 9, 11, 15) AND p_type LIKE '%E%' AND p_name NOT LIKE 'x!_%' ESCAPE '!'")
both("is_true_unknown", "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS pos, (nullif(c_acctbal, c_acctbal) > 0) IS NULL AS unk FROM customer WHERE (c_nationkey = 3) IS NOT FALSE")
both("is_distinct_from", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL OR nullif(c_nationkey, 4) IS DISTINCT FROM c_nationkey")
both("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("fromless_select", "SELECT 1 AS one, 'a' AS a, 2 + 3 AS five")
both("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
both("derived_table", "SELECT k, n FROM (SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey) AS d(k, n) WHERE n > 3")


@pair("SELECT n_name FROM nation WHERE starts_with(n_name, 'A') OR n_name LIKE 'N%1%'")
def starting_with(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return n.where(F.col("n_name").startswith("A") | F.col("n_name").like("N%1%")).select("n_name")


@pair("SELECT p_partkey FROM part WHERE contains(lower(p_name), lower('A')) AND NOT contains(lower(p_type), 'b')")
def containing(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.where(scalar.containing(F.col("p_name"), F.lit("A")) & ~scalar.containing(F.col("p_type"), F.lit("b"))).select("p_partkey")


@pair("SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, '[A-Z][a-z]*[\\s\\S]*[0-4]+[0-9]')")
def similar_to(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.where(scalar.similar_to(F.col("c_name"), "[[:UPPER:]][a-z]*%[0-4]+[[:DIGIT:]]")).select("c_custkey", "c_name")


@pair("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS FIRST, c_custkey NULLS FIRST LIMIT 40")
def nulls_order(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").selectExpr("c_custkey", "nullif(c_nationkey, 3) AS k")
    return relational.first_skip(relational.ordered(c, "k desc", "c_custkey"), 40)


@pair("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 11 OFFSET 4")
def rows_m_to_n(spark, sf_dir):
    return relational.rows(relational.ordered(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 5, 15)


@pair("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")
def first_skip(spark, sf_dir):
    return relational.first_skip(relational.ordered(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey"), 7, 3)


@pair("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
def offset_fetch(spark, sf_dir):
    return relational.offset_fetch(relational.ordered(read_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), 10, 5)


# --- joins

both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
both("join_left_gate", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000")
both("join_right", "SELECT c_custkey, n_name FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal < 0")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey <> r_regionkey")
both("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
both("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_custkey AS b FROM customer) y")
both("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) y USING (k)")
both("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_merge_hint", "SELECT l_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50", "SELECT /*+ MERGE(orders) */ l_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50")
both("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
both("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
both("exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)")
both("not_in_nulls", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
both("lateral_top1", "SELECT c_custkey, k FROM customer, LATERAL (SELECT max(o_orderkey) AS k FROM orders WHERE o_custkey = c_custkey) t")


@pair("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey")
def join_full(spark, sf_dir):
    s, c = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return relational.cell_join(s, c, ("s_nationkey", "c_nationkey"), "full").select("s_suppkey", "c_custkey")


@pair("SELECT a.c_custkey AS x, b.s_suppkey AS y FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_nullsafe(spark, sf_dir):
    a = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS x", "nullif(c_nationkey, 3) AS j")
    b = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS y", "nullif(s_nationkey, 3) AS k")
    return relational.cell_join(a, b, ("j", "k"), null_safe=True).select("x", "y")


@pair("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) = 1")
def singular(spark, sf_dir):
    return quantified.singular(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


def _quantified(name: str, op: str, kind: str, where: str, sql: str) -> None:
    def run(spark, sf_dir):
        values = read_table(spark, sf_dir, "supplier").where(where).selectExpr("nullif(s_nationkey, 30) AS v")
        return quantified.quantified(read_table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", op, kind, values, "v")

    QUERIES[name], SQL[name] = run, f"SELECT n_nationkey FROM nation WHERE {sql} (SELECT s_nationkey FROM supplier WHERE {where}))"


_quantified("any_gt", ">", "any", "s_suppkey < 9", "(n_nationkey > ANY")
_quantified("all_gt", ">=", "all", "s_suppkey < 5", "(n_nationkey >= ALL")
_quantified("not_any", "<", "not any", "s_suppkey < 5", "NOT (n_nationkey < ANY")
_quantified("not_all", "=", "not all", "s_suppkey = 3", "NOT (n_nationkey = ALL")
_quantified("all_empty_set", "<", "all", "s_suppkey < 0", "(n_nationkey < ALL")


@pair("SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice >= ALL (SELECT p.o_totalprice FROM orders p WHERE p.o_custkey = o.o_custkey)")
def all_correlated(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return quantified.quantified(o, "o_totalprice", ">=", "all", o.select("o_custkey", "o_totalprice"), "o_totalprice", ["o_custkey"]).select("o_orderkey")


# --- aggregates

_MONEY = "CAST(sum(CAST({} AS DECIMAL(12,2))) AS DOUBLE)"
both("group_by_expr", f"SELECT l_quantity > 25 AS big, {_MONEY.format('l_extendedprice')} AS total FROM lineitem GROUP BY l_quantity > 25")
both("group_by_ordinal", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
both("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) < 50000")
both("count_sum_avg_min_max", f"SELECT l_returnflag, count(*) AS n, {_MONEY.format('l_extendedprice')} AS s, round(avg(l_linenumber), 6) AS a, min(l_shipdate) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
both("distinct_aggs", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_linenumber), 6) AS a FROM lineitem GROUP BY l_returnflag")
both("filter_clause", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS r, CAST(sum(l_linenumber) FILTER (WHERE l_quantity < 10) AS BIGINT) AS q FROM lineitem GROUP BY l_linestatus")
both("stddev_var", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s1, round(stddev_pop(l_quantity), 6) AS s2, round(var_samp(l_quantity), 6) AS v1, round(var_pop(l_quantity), 6) AS v2 FROM lineitem GROUP BY l_returnflag")
both("covar_corr", "SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 2) AS c1, round(covar_pop(l_quantity, l_extendedprice), 2) AS c2, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag")
both("regr_all", "SELECT l_linestatus, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx FROM lineitem GROUP BY l_linestatus")
both("regr_sums", "SELECT round(regr_sxy(s_acctbal, s_nationkey) / 1000, 4) AS sxy, round(regr_syy(s_acctbal, s_nationkey) / 1000000, 4) AS syy FROM supplier")
both("global_agg_empty", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
both("null_group", "SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY nullif(c_nationkey, 3)")


@pair("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, (SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer) AS segments FROM nation GROUP BY n_regionkey")
def list_agg(spark, sf_dir):
    segments = read_table(spark, sf_dir, "customer").agg(relational.listing("c_mktsegment", distinct=True).alias("segments"))
    names = read_table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(relational.listing("n_name", ";").alias("names"))
    return names.crossJoin(F.broadcast(segments))  # one row


@pair("SELECT c_nationkey, any_value(CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey * 10 END) AS v FROM customer GROUP BY c_nationkey")
def any_value(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.any_value(F.expr("CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey * 10 END"), True).alias("v"))


# --- windows

both("row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders")
both("rank_dense", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS d FROM lineitem")
both("percent_cume", "SELECT l_orderkey, l_linenumber, round(percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity), 6) AS p, round(cume_dist() OVER (PARTITION BY l_orderkey ORDER BY l_quantity), 6) AS c FROM lineitem")
both("ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q FROM customer")
both("lag_lead_default", "SELECT o_orderkey, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders")
both("first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
both("rows_frame", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM lineitem")
both("range_frame_numeric", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey RANGE BETWEEN 50 PRECEDING AND 10 FOLLOWING) AS n FROM customer")
both("range_frame_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
both("named_window", "SELECT s_suppkey, CAST(sum(s_suppkey) OVER w AS BIGINT) AS t, max(s_suppkey) OVER (w) AS m FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")


@pair("SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders")
def nth_from_last(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", windows.nth_from_last(F.col("o_orderkey"), 2, ["o_custkey"], ["o_orderkey"]).alias("n"))


@pair("SELECT o_orderkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
def win_filter(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", windows.filtered(F.count, F.col("o_orderkey"), F.col("o_orderstatus") == "F", w).alias("n"))


@pair("SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) OVER (PARTITION BY l_orderkey) AS n, CAST(sum(DISTINCT l_suppkey) OVER (PARTITION BY l_orderkey) AS BIGINT) AS s FROM lineitem")
def win_distinct(spark, sf_dir):
    s = F.col("l_suppkey")
    rows = windows.distinct_over(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], n=F.count_distinct(s), s=F.sum_distinct(s))
    return rows.select("l_orderkey", "l_linenumber", "n", "s")


@pair("SELECT n_nationkey, string_agg(n_name, ',' ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS names FROM nation")
def win_list(spark, sf_dir):
    w = Window.partitionBy("n_regionkey")
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.sort_array(F.collect_list("n_name").over(w)), ",").alias("names"))


# --- composition

both("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
both("union_distinct", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
both("intersect_except", "(SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -900")
both("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("cte_multi", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT k, n FROM a WHERE n = (SELECT m FROM b)")
both("scalar_subquery", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer")
both("scalar_top1", "SELECT n_nationkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) AS best FROM nation")


@pair("SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_name FROM nation")
def type_unified_union(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return relational.union(n.select(F.col("n_nationkey").alias("v")), n.select("n_name"))


@pair("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 1000) SELECT count(*) AS n, max(n) AS m FROM t")
def cte_recursive_chain(spark, sf_dir):
    return relational.recursive(spark, "t", ["n"], "SELECT 1", "SELECT n + 1 FROM t WHERE n < 1000", "SELECT count(*) AS n, max(n) AS m FROM t")


_TREE = "SELECT CAST(r_regionkey AS BIGINT), CAST(r_name AS {s}), 0 FROM region", "SELECT CAST(100 + n_nationkey AS BIGINT), p || '/' || n_name, d + 1 FROM nation JOIN t ON n_regionkey = id AND d = 0"


@pair(f"WITH RECURSIVE t(id, p, d) AS ({_TREE[0].format(s='VARCHAR')} UNION ALL {_TREE[1]}) SELECT id, p, d FROM t")
def cte_recursive_tree(spark, sf_dir):
    register(spark, sf_dir, ["region", "nation"])
    return relational.recursive(spark, "t", ["id", "p", "d"], _TREE[0].format(s="STRING"), _TREE[1], "SELECT id, p, d FROM t")


@pair("SELECT n_nationkey, unnest(list_filter(string_split(replace(n_name, 'A', ','), ','), lambda x: x <> '')) AS token FROM nation")
def unlist_basic(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.explode(relational.unlist(F.replace("n_name", F.lit("A"), F.lit(",")))).alias("token"))


@pair("SELECT p_partkey, CAST(unnest(list_filter([p_size, p_partkey, 7], lambda x: x IS NOT NULL)) AS BIGINT) AS v FROM part")
def unlist_typed(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit(",,"), F.col("p_partkey").cast("string"), F.lit(",7,"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.explode(relational.unlist(text, ",", "bigint")).alias("v"))


# --- scalar functions

both("fn_conditional", "SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS s, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS q, coalesce(nullif(c_nationkey, 3), -1) AS k, CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'n' END AS i FROM customer")
both("fn_string_case", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, char_length(c_name) AS n, bit_length(c_name) AS b, octet_length(encode(c_name)) AS o, reverse(c_name) AS r, left(c_name, 3) AS lf, right(c_name, 2) AS rt FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(char_length(c_name) AS BIGINT) AS n, CAST(bit_length(c_name) AS BIGINT) AS b, CAST(octet_length(c_name) AS BIGINT) AS o, reverse(c_name) AS r, left(c_name, 3) AS lf, right(c_name, 2) AS rt FROM customer")
both("fn_string_cut", "SELECT p_partkey, substring(p_name, 2, 3) AS s, CAST(position('a' IN p_name) AS BIGINT) AS p, replace(p_name, 'a', 'zz') AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, p_name || '/' || p_type AS c FROM part")
both("fn_math_basic", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INTEGER) AS s, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 6) AS q, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS l10, c_custkey % 7 AS m FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INT) AS s, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 6) AS q, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS l10, c_custkey % 7 AS m FROM customer")
both("fn_math_trig", "SELECT s_suppkey, round(sin(s_suppkey), 6) AS si, round(cos(s_suppkey), 6) AS co, round(tan(s_suppkey), 4) AS ta, round(asin(1.0 / s_suppkey), 6) AS asi, round(acos(1.0 / s_suppkey), 6) AS aco, round(atan(s_suppkey), 6) AS at, round(atan2(s_suppkey, 3), 6) AS a2, round(cot(s_suppkey), 4) AS ct, round(asinh(s_suppkey), 6) AS ash, round(acosh(s_suppkey), 6) AS ach, round(tanh(s_suppkey), 6) AS th, round(exp(1.0 / s_suppkey), 6) AS e, round(power(s_suppkey, 2), 3) AS p FROM supplier WHERE s_suppkey > 0")
both("fn_hyperbolic", "SELECT s_suppkey, round(sinh(s_suppkey % 10 / 7e0), 6) AS s, round(cosh(s_suppkey % 10 / 7e0), 6) AS c, round(atanh(s_suppkey % 10 / 11e0), 6) AS a, round(pi() * s_suppkey, 6) AS p FROM supplier")
both("fn_bitwise", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 3 AS o, xor(c_custkey, 5) AS x, ~c_custkey AS n, c_custkey << 2 AS l, c_custkey >> 1 AS r FROM customer", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 3 AS o, c_custkey ^ 5 AS x, ~c_custkey AS n, shiftleft(c_custkey, 2) AS l, shiftright(c_custkey, 1) AS r FROM customer")
both("fn_hash_encode", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name)) AS h, base64(encode(c_name)) AS b FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, lower(hex(c_name)) AS h, base64(c_name) AS b FROM customer")
both("fn_division", "SELECT c_custkey, c_custkey // 7 AS d, c_custkey / 8 AS q FROM customer", "SELECT c_custkey, c_custkey div 7 AS d, c_custkey / 8 AS q FROM customer")


@pair("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS fm, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS fq, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS fy, strftime(last_day(o_orderdate), '%Y-%m-%d') AS lm, strftime(CAST(o_orderdate AS DATE) - CAST(extract(dow FROM o_orderdate) AS INTEGER), '%Y-%m-%d') AS fw FROM orders")
def fn_datetime_first_last(spark, sf_dir):
    d = F.col("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text(scalar.first_day("month", d)).alias("fm"), text(scalar.first_day("quarter", d)).alias("fq"), text(scalar.first_day("year", d)).alias("fy"), text(scalar.last_day("month", d)).alias("lm"), text(scalar.first_day("week", d)).alias("fw"))


@pair("SELECT row_number() OVER (ORDER BY n_nationkey) + 99 AS id, n_name FROM nation")
def sequence_next_value(spark, sf_dir):
    return numbering.numbered(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "id", ["n_nationkey"], 100).select("id", "n_name")


@pair("SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1) * 10 + 5 AS id FROM lineitem")
def sequence_ordered_step(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return numbering.numbered(rows, "id", ["l_shipdate", "l_orderkey", "l_linenumber"], 5, 10).drop("l_shipdate")


@pair("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE NOT (o_orderstatus = 'F' AND n BETWEEN 3 AND 40)")
def dml_delete_order_rows(spark, sf_dir):
    return dml.delete(read_table(spark, sf_dir, "orders"), "o_orderstatus = 'F'", ["o_totalprice desc", "o_orderkey"], (3, 40))[0].select("o_orderkey")


# --- extension types


@pair("SELECT lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY lower(c_mktsegment)")
def citext_group(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("s"))
    return c.groupBy(F.collate("s", "UTF8_LCASE").alias("s")).agg(F.count("*").alias("n")).select(F.collate(F.lower("s"), "UTF8_BINARY").alias("s"), "n")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@pair(f"WITH w AS (SELECT doc_id, {_WORDS} AS v FROM documents) SELECT doc_id, round(list_count(list_filter(v, lambda x: x IN ('the', 'and'))) / len(v), 9) AS rank FROM w WHERE list_contains(v, 'the') AND list_contains(v, 'and') AND NOT list_contains(v, 'with')")
def tsvector_match(spark, sf_dir):
    query = types.to_tsquery("the & and & !with")
    d = read_table(spark, sf_dir, "documents").select("doc_id", types.tsvector(F.col("text")).alias("v"))
    return d.where(types.ts_matches(F.col("v"), query)).select("doc_id", F.round(types.ts_rank(F.col("v"), query), 9).alias("rank"))


@pair("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)')")
def tsvector_phrase(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", types.tsvector(F.col("text")).alias("v"))
    return d.where(types.ts_matches(F.col("v"), types.phraseto_tsquery("of the"))).select("doc_id")


@pair("SELECT n_name FROM nation WHERE n_regionkey = 1")
def schema_path(spark, sf_dir):
    s = Schemas(["finance.reports"])
    s.create("finance")
    s.create("finance.reports")
    s.add("finance.reports", "nation", read_table(spark, sf_dir, "nation"))
    return spark.table(s.resolve("nation")).where("n_regionkey = 1").select("n_name")


@pair("SELECT r_name FROM region WHERE r_regionkey > 1")
def link_read(spark, sf_dir):
    links = Links()
    links.add("remote", root=sf_dir)
    return links.read(spark, "region", "REMOTE").where("r_regionkey > 1").select("r_name")


@pair("SELECT * FROM (VALUES (1, 'EUR'), (2, 'USD')) AS t(id, code)")
def virtual_table(spark, sf_dir):
    return virtual(spark, [(1, "EUR"), (2, "USD")], "id int, code string")


@pair("SELECT * FROM (VALUES ('A'), ('b c'), ('D')) AS t(name)")
def parse_unqualified_names(spark, sf_dir):
    return relational.unqualified_names(spark, 'a, "b c", d')


# --- routines


@pair("SELECT p_partkey, p_size * 2 + length(p_name) AS v FROM part WHERE p_size * 2 + length(p_name) > 40")
def routine_scalar(spark, sf_dir):
    routines.scalar_function(spark, "twice_plus_length", lambda n, s: n * 2 + s.str.len(), "bigint")
    register(spark, sf_dir, ["part"])
    return spark.sql("SELECT p_partkey, twice_plus_length(p_size, p_name) AS v FROM part WHERE twice_plus_length(p_size, p_name) > 40")


@pair("SELECT s_suppkey, i AS step, s_suppkey * i AS product FROM supplier, LATERAL (SELECT unnest(generate_series(1, s_nationkey % 4)) AS i)")
def routine_procedure(spark, sf_dir):
    routines.procedure(spark, "multiples", lambda k, n: ((i, k * i) for i in range(1, n + 1)), "step bigint, product bigint")
    register(spark, sf_dir, ["supplier"])
    return spark.sql("SELECT s_suppkey, step, product FROM supplier, LATERAL multiples(s_suppkey, s_nationkey % 4)")


@pair("SELECT n_name FROM nation WHERE n_regionkey = 2")
def context_variables(spark, sf_dir):
    routines.set_context(spark, "wanted_region", 2)
    register(spark, sf_dir, ["nation"])
    return spark.sql("SELECT n_name FROM nation WHERE n_regionkey = CAST(wanted_region AS INT)")


@pair("SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS credit, c_nationkey FROM customer")
def bind_output(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 0).alias("credit"), "c_nationkey")
    return routines.bind(rows, {"bigint": "string", "boolean": "string"})


@pair("SELECT c_custkey, substring(c_name, 3, 4) AS part, c_name AS back, to_base64(encode(c_name)) AS b64, sha1(c_name) AS s1 FROM customer")
def blob_and_cipher(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    back = F.aes_decrypt(F.aes_encrypt(F.col("c_name"), key), key).cast("string")
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", routines.blob_read(F.col("c_name"), 2, 4).cast("string").alias("part"), back.alias("back"), F.base64(F.col("c_name").cast("binary")).alias("b64"), F.sha1("c_name").alias("s1"))


both("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("cube", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
both("max_pushed", "SELECT max(o_orderdate) AS last, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F'")


@pair("""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') AS a FROM part)
SELECT p_partkey, len(a) AS n, a[1] AS first, list_contains(a, 'of') AS has, list_reverse(a)[1] AS last, list_sort(a)[1] AS least, list_position(a, a[2]) AS at FROM w""")
def array_more(spark, sf_dir):
    v = types.tsvector(F.concat_ws(" ", "p_name", "p_type"))
    a = F.col("a")
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.transform(v, lambda x: x["lexeme"]).alias("a"), v.alias("v"))
    return rows.select("p_partkey", F.size(a).cast("bigint").alias("n"), types.element(a, F.lit(1)).alias("first"), types.has_lexeme(F.col("v"), "of").alias("has"), F.reverse(a)[0].alias("last"), F.array_sort(a)[0].alias("least"), F.array_position(a, a[1]).cast("int").alias("at"))


# --- data modification


@pair("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(s_suppkey + 100 AS INTEGER), s_name, 9 FROM supplier WHERE s_suppkey < 5")
def dml_insert_select(spark, sf_dir):
    new = read_table(spark, sf_dir, "supplier").where("s_suppkey < 5").select((F.col("s_suppkey") + 100).alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return dml.insert(read_table(spark, sf_dir, "nation"), new, {"n_regionkey": "9"})[0]


@pair("SELECT s_suppkey, CASE WHEN rn <= 3 THEN 0.5 ELSE s_acctbal END AS s_acctbal FROM (SELECT *, CASE WHEN s_acctbal < 5000 THEN row_number() OVER (PARTITION BY s_acctbal < 5000 ORDER BY s_suppkey) ELSE 99 END AS rn FROM supplier)")
def dml_update_rows(spark, sf_dir):
    return dml.update(read_table(spark, sf_dir, "supplier"), {"s_acctbal": "0.5"}, "s_acctbal < 5000", ["s_suppkey"], (1, 3))[0].select("s_suppkey", "s_acctbal")


@pair("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def dml_delete_rows(spark, sf_dir):
    return dml.delete(read_table(spark, sf_dir, "customer"), "nullif(c_nationkey, 3) > 10")[0].select("c_custkey")


_SOURCE = "(SELECT n_nationkey + 10 AS k, upper(n_name) || '!' AS v FROM nation)"


def _merged(spark, sf_dir):
    s = read_table(spark, sf_dir, "nation").selectExpr("n_nationkey + 10 AS k", "upper(n_name) || '!' AS v")
    return dml.merge(
        read_table(spark, sf_dir, "nation"), s, "t.n_nationkey = s.k",
        [dml.Clause("matched", "delete", condition="s.k = 12"), dml.Clause("matched", "update", {"n_name": "s.v"}), dml.Clause("not matched", "insert", {"n_nationkey": "s.k", "n_name": "s.v"}, "s.k < 30"), dml.Clause("not matched by source", "update", {"n_regionkey": "-1"}, "t.n_nationkey < 5")],
    )


@pair(f"""SELECT CAST(coalesce(n_nationkey, k) AS INTEGER) AS n_nationkey, CASE WHEN k IS NOT NULL THEN v ELSE n_name END AS n_name, CASE WHEN k IS NULL AND n_nationkey < 5 THEN -1 ELSE n_regionkey END AS n_regionkey
FROM nation FULL JOIN {_SOURCE} ON n_nationkey = k WHERE NOT (n_nationkey IS NOT NULL AND k IS NOT NULL AND k = 12) AND (n_nationkey IS NOT NULL OR k < 30)""")
def merge_full(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@pair(f"""SELECT CASE WHEN n_nationkey IS NULL THEN 'insert' WHEN k = 12 THEN 'delete' ELSE 'update' END AS action, n_name AS old_n_name, CASE WHEN k IS NULL THEN n_name WHEN n_nationkey IS NOT NULL AND k = 12 THEN NULL ELSE v END AS new_n_name
FROM nation FULL JOIN {_SOURCE} ON n_nationkey = k WHERE (n_nationkey IS NOT NULL AND k IS NOT NULL) OR k < 30 OR (k IS NULL AND n_nationkey < 5)""")
def returning_old_new(spark, sf_dir):
    return _merged(spark, sf_dir)[1].select("action", "old_n_name", "new_n_name")


@pair("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'new' ELSE r_name END AS r_name FROM region UNION ALL SELECT 77, 'added'")
def upsert_matching(spark, sf_dir):
    rows = virtual(spark, [(2, "new"), (77, "added")], "r_regionkey int, r_name string")
    return dml.update_or_insert(read_table(spark, sf_dir, "region"), rows, ["r_regionkey"])[0]


# --- change logs and event windows


@pair("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 5 <> 0")
def change_log_apply(spark, sf_dir):
    changes = read_table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_id") % 5 == 0, "D").otherwise("U"))
    return streaming.apply_changes(changes, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@pair("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    w = streaming.windowed(read_table(spark, sf_dir, "events"), "ts", "1 hour", by=["event_type"])
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("h"), "event_type", "n")


@pair("SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY w")
def event_sliding(spark, sf_dir):
    return streaming.windowed(read_table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes").select("window_start", "n")


@pair("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return streaming.sessions(read_table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "n")


from basalt.plans import scalar_queries, surface_queries, type_queries  # noqa: E402, F401
