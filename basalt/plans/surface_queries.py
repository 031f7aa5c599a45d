"""Laterals, frame exclusion, join methods, sources, blocks, inserts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt import streaming
from basalt.functions import routines
from basalt.operators import dml, relational, windows
from basalt.plans.registry import both, pair
from basalt.session import scratch_folder
from basalt.sources import Batch, Links, read_table, record_file, register, write_table

# --- joins

both("lateral_top_two", "SELECT c_custkey, k, p FROM customer, LATERAL (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
both("lateral_left", "SELECT c_custkey, k FROM customer LEFT JOIN LATERAL (SELECT o_orderkey AS k FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1) t ON true")
for _hint, _name in (("BROADCAST", "join_broadcast_hint"), ("SHUFFLE_HASH", "join_hash_hint"), ("SHUFFLE_REPLICATE_NL", "join_loop_hint")):
    _text = "SELECT {}s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0"
    both(_name, _text.format(""), _text.format(f"/*+ {_hint}(nation) */ "))


# --- windows

both("win_nulls_placed", "SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY nullif(n_nationkey % 7, 3) DESC NULLS LAST, n_nationkey) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY nullif(n_nationkey % 7, 3) NULLS FIRST, n_nationkey DESC) AS BIGINT) AS b FROM nation")
both("nulls_placed_asc", "SELECT n_nationkey, k FROM (SELECT n_nationkey, nullif(n_nationkey % 5, 2) AS k FROM nation) ORDER BY k ASC NULLS LAST, n_nationkey LIMIT 23")

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
_KINDS = ("sum", "count", "min", "max")


def _over(kind: str, exclude: str, frame: str) -> str:
    rows = "o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS" if exclude == "CURRENT ROW" else "l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3 GROUPS"
    value = f"{kind}({rows} BETWEEN {frame} EXCLUDE {exclude})"
    return f"CAST({value} AS BIGINT)" if kind == "sum" else value


@pair("SELECT o_orderkey, " + ", ".join(f"{_over(k, 'CURRENT ROW', 'UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')} AS {k}_all, {_over(k, 'CURRENT ROW', '2 PRECEDING AND 1 FOLLOWING')} AS {k}_near" for k in _KINDS) + " FROM orders")
def win_exclude_current(spark, sf_dir):
    v, by = F.col("o_orderkey") % 97, (["o_custkey"], ["o_orderkey"])
    cols = [windows.excluding(k, v, *by, frame).alias(f"{k}_{n}") for k in _KINDS for n, frame in (("all", _ALL), ("near", (-2, 1)))]
    return read_table(spark, sf_dir, "orders").select("o_orderkey", *cols)


@pair("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_over(k, e.upper(), 'UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')} AS {k}_{e}, {_over(k, e.upper(), '1 PRECEDING AND CURRENT ROW')} AS {k}_{e}_near" for k in _KINDS for e in ("group", "ties")) + " FROM lineitem")
def win_exclude_peers(spark, sf_dir):
    rows = windows.peers(read_table(spark, sf_dir, "lineitem"), "peer", ["l_orderkey"], [F.col("l_linenumber") % 3])
    cols = [windows.excluding(k, F.col("l_suppkey"), ["l_orderkey"], ["peer"], frame, e).alias(f"{k}_{e}{n}") for k in _KINDS for e in ("group", "ties") for n, frame in (("", _ALL), ("_near", (-1, 0)))]
    return rows.select("l_orderkey", "l_linenumber", *cols)


# --- limits and unions


@pair("SELECT v FROM (SELECT n_name AS v, n_nationkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey + 100 FROM region) ORDER BY k DESC, v LIMIT 9")
def union_by_ordinals(spark, sf_dir):
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    both_ = relational.union(n.select(F.col("n_name").alias("v"), F.col("n_nationkey").alias("k")), r.select("r_name", F.col("r_regionkey") + 100))
    return relational.limited(relational.ordered_union(both_, "2 desc", "1"), fetch=9).select("v")


@pair("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def singleton_select(spark, sf_dir):
    one = relational.singleton(read_table(spark, sf_dir, "region").where("r_name = 'ASIA'").select("r_regionkey"))
    return read_table(spark, sf_dir, "nation").join(F.broadcast(one), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")  # one row by definition


@pair("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def conditional_stream(spark, sf_dir):
    """One of two plans: the shorter scan where the parameter allows it."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    status = "F"
    return relational.conditional(status is not None, orders.where(F.col("o_orderstatus") == status), orders).drop("o_orderstatus")


# --- sources and sinks


@pair("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def record_file_scan(spark, sf_dir):
    """An external file of fixed-length records, written from the table and read back."""
    folder = f"{scratch_folder(spark)}/records-{uuid.uuid4().hex}"
    line = F.concat(F.lpad(F.col("n_nationkey").cast("string"), 6, " "), F.rpad("n_name", 30, " "), F.lpad(F.col("n_regionkey").cast("string"), 4, " "))
    read_table(spark, sf_dir, "nation").select(line.alias("value")).write.text(folder)
    return record_file(spark, folder, [("n_nationkey", 6, "int"), ("n_name", 30, "string"), ("n_regionkey", 4, "int")])


@pair("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def write_and_read_partitions(spark, sf_dir):
    folder = f"{scratch_folder(spark)}/tables-{uuid.uuid4().hex}"
    write_table(read_table(spark, sf_dir, "nation"), folder, "nation", partition_by=["n_regionkey"])
    return read_table(spark, folder, "nation").select("n_regionkey", "n_nationkey", "n_name")


@pair("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def link_execute(spark, sf_dir):
    links = Links()
    links.add("remote", root=sf_dir)
    return links.execute(spark, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "remote")


@pair("SELECT mode, n_nationkey, n_name FROM nation, (VALUES ('context_aware', 1), ('fixed', 2), ('hierarchical', 3), ('mirror', 4), ('none', 0)) AS m(mode, region) WHERE n_regionkey = region")
def link_schema_modes(spark, sf_dir):
    """A region's nations in each of five schemas of the other side, found by the five ways to map a schema."""
    root = f"{scratch_folder(spark)}/linked-{uuid.uuid4().hex}"
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for region, schema in enumerate(("", "users/ann", "fixed/one", "far/reports/daily", "near/reports")):
        write_table(nation.where(F.col("n_regionkey") == region).drop("n_regionkey"), f"{root}/{schema}".rstrip("/"), "nation")
    links = Links(user="ann")
    links.add("none", root)
    links.add("fixed", root, mode="fixed", remote="fixed.one")
    links.add("context_aware", root, mode="context_aware", remote="users.USER")
    links.add("hierarchical", root, mode="hierarchical", local="near", remote="far")
    links.add("mirror", root, mode="mirror")
    names = {"none": "any.nation", "fixed": "any.nation", "context_aware": "nation", "hierarchical": "near.reports.daily.nation", "mirror": "near.reports.nation"}
    return relational.union(*(links.read(spark, name, mode).select(F.lit(mode).alias("mode"), "n_nationkey", "n_name") for mode, name in names.items()))


@pair("SELECT n_nationkey, unnest(list_filter(string_split(n_name, 'I'), lambda x: x <> '')) AS token FROM nation")
def unlist_blob(spark, sf_dir):
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("b"))
    return rows.select("n_nationkey", F.explode(relational.unlist(F.col("b").cast("string"), "I")).alias("token"))


@pair("SELECT n_nationkey, n_name, code FROM nation JOIN (VALUES (0, 'zero'), (3, 'three'), (3, 'drei')) AS l(k, code) ON n_nationkey = k")
def local_table_scan(spark, sf_dir):
    local = spark.createDataFrame([(0, "zero"), (3, "three"), (3, "drei")], "k int, code string")
    return read_table(spark, sf_dir, "nation").join(local, F.col("n_nationkey") == F.col("k")).select("n_nationkey", "n_name", "code")


@pair("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 20, 'twenty' UNION ALL SELECT 22, NULL")
def batch_ingest(spark, sf_dir):
    batch = Batch(read_table(spark, sf_dir, "region"), multi_error=True)
    for row in ((20, "twenty"), ("no number", "refused"), (22, None)):
        batch.add(*row)
    return batch.execute()[0]


@pair("SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def approximate_distinct(spark, sf_dir):
    """Within three of its standard errors of the exact count."""
    flags = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    # apart: in one aggregate Spark would keep a sketch for each different order
    near, exact = flags.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a")), flags.agg(F.count_distinct("l_orderkey").alias("e")).withColumnRenamed("l_returnflag", "flag")
    rows = near.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return rows.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e") + 1).alias("near"))


both(
    "pushed_and_or_in",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 150000 AND o_orderkey IN (1, 5, 9, 33, 100, 500, 1000)) OR o_custkey IN (3, 7, 11) OR (o_orderkey BETWEEN 20 AND 25 AND NOT o_orderstatus = 'O')",
)

# --- routines


@pair("SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_regionkey BETWEEN 1 AND 3 GROUP BY n_regionkey")
def routine_block(spark, sf_dir):
    """A block with a loop over regions, each of which gives a row."""
    nation = read_table(spark, sf_dir, "nation")
    one = lambda region, low: nation.where((F.col("n_regionkey") == region) & (F.col("n_nationkey") >= low)).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return routines.for_range(1, 3, lambda i: routines.call(one, {"region": 0, "low": 0}, region=i))


@pair("SELECT CAST(sum(CASE WHEN n_regionkey = 1 THEN 10 ELSE 1 END) AS BIGINT) AS total, 5 AS rounds, 'caught' AS state, CAST(length(string_agg(n_name, '')) AS BIGINT) AS letters FROM nation")
def routine_script(spark, sf_dir):
    """EXECUTE BLOCK: IF, WHILE, FOR SELECT, LEAVE and a handler."""
    register(spark, sf_dir, ["nation"])
    return routines.execute_block(
        spark,
        """
        DECLARE total BIGINT DEFAULT 0;
        DECLARE letters BIGINT DEFAULT 0;
        DECLARE rounds INT DEFAULT 0;
        DECLARE state STRING DEFAULT 'none';
        FOR row AS SELECT n_regionkey, n_name FROM nation DO
          IF row.n_regionkey = 1 THEN
            SET total = total + 10;
          ELSE
            SET total = total + 1;
          END IF;
          SET letters = letters + length(row.n_name);
        END FOR;
        counting: WHILE true DO
          SET rounds = rounds + 1;
          IF rounds >= 5 THEN
            LEAVE counting;
          END IF;
        END WHILE;
        BEGIN
          DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO
          BEGIN
            SET state = 'caught';
          END;
          SET total = total div (rounds - 5);
        END;
        SELECT total, rounds, state, letters;
        """,
    )


@pair("SELECT s_suppkey, s_acctbal * 2 + 1 AS v FROM supplier")
def routine_sql_function(spark, sf_dir):
    register(spark, sf_dir, ["supplier"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice_and(x DOUBLE, more DOUBLE DEFAULT 1) RETURNS DOUBLE RETURN x * 2 + more")
    return spark.sql("SELECT s_suppkey, twice_and(s_acctbal) AS v FROM supplier")


# --- data modification


@pair("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (10, 'ten'), (11, NULL)) UNION ALL SELECT 99, 'none'")
def dml_insert_values(spark, sf_dir):
    region = read_table(spark, sf_dir, "region")
    out = dml.insert_values(region, [(10, "ten"), (11, None)])[0]
    return dml.insert_values(out, [()], defaults={"r_regionkey": "99", "r_name": "'none'"})[0]


@pair("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50 + r_regionkey, 'kept' FROM region UNION ALL SELECT 7, 'own' FROM region")
def dml_insert_overriding(spark, sf_dir):
    region = read_table(spark, sf_dir, "region")
    kept = region.select((F.col("r_regionkey") + 50).alias("r_regionkey"), F.lit("kept").alias("r_name"))
    own = region.select((F.col("r_regionkey") + 50).alias("r_regionkey"), F.lit("own").alias("r_name"))
    identity, defaults = {"r_regionkey": "always"}, {"r_regionkey": "7"}
    out = dml.insert(region, kept, defaults, identity, overriding="system")[0]
    return dml.insert(out, own, defaults, identity, overriding="user")[0]


# --- streams


def _event_stream(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@pair("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_stream(spark, sf_dir):
    """The events as a stream, counted by type to the end of the input; each batch writes its counts as a version of a table."""
    root = f"{scratch_folder(spark)}/event-stream-{uuid.uuid4().hex}"
    counts = _event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    last = [0]

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/v={number}")
        last[0] = number

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/v={last[0]}")


@pair("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 5 <> 0")
def change_stream_apply(spark, sf_dir):
    """The change log of ``change_log_apply`` as a stream."""
    root = f"{scratch_folder(spark)}/change-stream-{uuid.uuid4().hex}"
    changes = _event_stream(spark, sf_dir).withColumn("op", F.when(F.col("event_id") % 5 == 0, "D").otherwise("U"))
    query = streaming.apply_stream(changes, f"{root}/state", f"{root}/checkpoint", ["user_id"], "event_id").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.schema(changes.schema).parquet(f"{root}/state/v={query.lastProgress['batchId']}")
    return streaming.apply_changes(state, ["user_id"], "event_id").select("user_id", "event_id", "event_type")
