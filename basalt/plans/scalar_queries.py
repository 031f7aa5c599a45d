"""Scalar functions over columns of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import routines, scalar
from basalt.operators import relational
from basalt.plans.registry import both, pair
from basalt.sources import read_table, spread

# --- text


@pair("SELECT p_partkey, p_name AS a, p_name || 'xy' AS b, 'xyxy' || p_name AS c, ltrim(p_name, 'aboecs') AS d, rtrim(p_name, 'tedg') AS e, trim(p_name, 'clst') AS f, p_name AS g FROM part")
def fn_trim(spark, sf_dir):
    t = F.concat(F.lit("xyxy"), "p_name", F.lit("xy"))
    name = F.col("p_name")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", scalar.trim_text(t, "xy").alias("a"), scalar.trim_text(t, "xy", "leading").alias("b"), scalar.trim_text(t, "xy", "trailing").alias("c"), scalar.trim_set(name, "aboecs", "leading").alias("d"),
        scalar.trim_set(name, "tedg", "trailing").alias("e"), scalar.trim_set(name, "clst").alias("f"), scalar.trim_text(F.concat(F.lit("  "), name, F.lit(" "))).alias("g"),
    )


@pair("""SELECT p_partkey, CASE WHEN length(p_name) >= 5 THEN substring(p_name, 3, 3) END AS sub, left(p_name, 3) || 'XX' || substring(p_name, 6) AS over, chr(65 + p_size % 26) AS ch, ascii(p_name) AS v,
       chr(8364 + p_size) AS uni, 8364 + p_size AS code, p_name || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || p_type AS ap, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS d1,
       CASE p_size % 3 WHEN 0 THEN 'zero' END AS d2, CASE WHEN p_size % 10 <> 3 THEN greatest(p_size, 20) END AS mx, CASE WHEN p_size % 10 <> 3 THEN least(p_size, 20) END AS mn,
       CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS i, greatest(p_size, 10, 20) AS g, least(p_size, 10) AS l FROM part""")
def fn_string_more(spark, sf_dir):
    name, size = F.col("p_name"), F.col("p_size")
    odd = F.when(size % 10 != 3, size)
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", scalar.substring_similar(name, '_{2}#"_{3}#"%', "#").alias("sub"), F.overlay(name, F.lit("XX"), 4, 2).alias("over"), F.char(65 + size % 26).alias("ch"), F.ascii(name).alias("v"),
        scalar.unicode_char(8364 + size).alias("uni"), scalar.unicode_val(scalar.unicode_char(8364 + size)).alias("code"), scalar.blob_append(name, F.when(size % 2 == 0, F.col("p_brand")), F.col("p_type")).alias("ap"),
        scalar.decode(size % 3, 0, "zero", 1, "one", default="other").alias("d1"), scalar.decode(size % 3, 0, "zero").alias("d2"), scalar.max_value(odd, F.lit(20)).alias("mx"), scalar.min_value(odd, F.lit(20)).alias("mn"),
        scalar.iif(size > 25, F.lit("big"), F.lit("small")).alias("i"), F.greatest(size, F.lit(10), F.lit(20)).alias("g"), F.least(size, F.lit(10)).alias("l"),
    )


@pair(r"""SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{8}[0-4]') AS a, c_mktsegment IN ('MACHINERY', 'FURNITURE') AS b, false AS newline, c_name LIKE '%#0%1' AS c FROM customer""")
def similar_to_whole(spark, sf_dir):
    name = F.col("c_name")
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.similar_to(name, "Customer\\#[[:DIGIT:]]{8}[0-4]", "\\").alias("a"), scalar.similar_to(F.col("c_mktsegment"), "(MACHINERY|FURNITURE)").alias("b"),
        scalar.similar_to(F.concat(name, F.lit("\n")), "Customer#[0-9]{9}").alias("newline"), scalar.similar_to(name, "%#0%1").alias("c"),
    )


# --- numbers


@pair("""SELECT c_custkey, trunc(c_acctbal) AS t0, CASE WHEN c_acctbal < 0 THEN ceil(CAST(c_acctbal AS DECIMAL(18,4)) * 10) / 10 ELSE floor(CAST(c_acctbal AS DECIMAL(18,4)) * 10) / 10 END AS t1, trunc(c_acctbal / 100) * 100 AS h,
       (12345678901234567890 + c_custkey) || '.1234' AS d, trunc(c_acctbal) * 1e30 AS big FROM customer""")
def fn_trunc(spark, sf_dir):
    a = F.col("c_acctbal")
    d = F.expr("CAST('12345678901234567890.1234567891' AS DECIMAL(38,10)) + CAST(c_custkey AS DECIMAL(17,0))").cast("decimal(38,10)")
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.trunc_number(a).alias("t0"), scalar.trunc_number(a, 1).alias("t1"), scalar.trunc_number(a, -2).alias("h"), scalar.trunc_number(d, 4, "decimal(34,4)").cast("string").alias("d"),
        scalar.trunc_number(scalar.trunc_number(a) * 1e30, 2).alias("big"),
    )


@pair("SELECT c_custkey, round(ln(abs(c_acctbal) + 1) / ln(3), 6) AS l3, round(log2(c_custkey + 1), 6) AS l2 FROM customer")
def fn_log_base(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.round(scalar.log(F.lit(3), F.abs("c_acctbal") + 1), 6).alias("l3"), F.round(scalar.log(F.lit(2), F.col("c_custkey") + 1), 6).alias("l2"))


@pair("SELECT count(*) AS n, count(*) AS in_range, count(*) > 1 AS differ FROM customer")
def fn_rand(spark, sf_dir):
    r = read_table(spark, sf_dir, "customer").select(scalar.rand().alias("r"))
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("r").between(0, 1)).alias("in_range"), (F.count_distinct("r") > 1).alias("differ"))


_CENTS = "SELECT *, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS a, c_acctbal < 0 AS neg FROM customer"


@pair(f"""SELECT c_custkey, upper(printf('%08x-0000-4000-8000-%012x', c_custkey, c_custkey * 7)) AS u, CASE WHEN neg THEN '-' ELSE '' END || (t // 10) || '.' || (t % 10) AS q, c_custkey || '.5' AS n,
       CASE WHEN c_acctbal < 5000 THEN 1 WHEN c_acctbal > 5000 THEN 2 ELSE 0 END AS c, 3 AS un, CASE WHEN c_custkey = 0 THEN 1 ELSE -1 END AS o, CAST(NULL AS VARCHAR) AS bad
FROM (SELECT *, a // 10 + CASE WHEN a % 10 > 5 OR (a % 10 = 5 AND (a // 10) % 2 = 1) THEN 1 ELSE 0 END AS t FROM ({_CENTS}))""")
def fn_uuid_decfloat(spark, sf_dir):
    text = lambda c: c.cast("string")
    k, bal = F.col("c_custkey"), text(F.col("c_acctbal").cast("decimal(18,2)"))
    uuid = F.format_string("%08x-0000-4000-8000-%012x", k, k * 7)
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.uuid_to_char(scalar.char_to_uuid(uuid)).alias("u"), scalar.quantize(bal, F.lit("0.1")).alias("q"), scalar.normalize_decfloat(F.concat(text(k), F.lit(".500"))).alias("n"),
        scalar.compare_decfloat(bal, F.lit("5000")).alias("c"), scalar.compare_decfloat(bal, F.lit("NaN")).alias("un"), scalar.total_order(F.concat(text(k), F.lit(".0")), F.when(k == 0, "-1").otherwise(text(k))).alias("o"),
        scalar.quantize(F.col("c_mktsegment"), F.lit("1")).alias("bad"),
    )


# --- dates and times

_PARTS = {"YEAR": "year", "MONTH": "month", "DAY": "day", "HOUR": "hour", "MINUTE": "minute", "SECOND": "second", "QUARTER": "quarter", "WEEK": "week"}
_SUMMER = "(extract(year FROM ts) = 2024 AND ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00')"


@pair(
    "SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS INTEGER) AS {n}_" for p, n in _PARTS.items()) + ", CAST(extract(dow FROM ts) AS INTEGER) AS weekday, CAST(extract(doy FROM ts) AS INTEGER) - 1 AS yearday, "
    f"CAST(extract(millisecond FROM ts) AS INTEGER) % 1000 AS ms, CASE WHEN {_SUMMER} THEN 2 ELSE 1 END AS zh, -30 AS zm, 'Europe/Berlin' AS zn FROM events"
)
def fn_datetime_extract(spark, sf_dir):
    d = F.col("ts")
    return read_table(spark, sf_dir, "events").select(
        "event_id", *(scalar.extract(p, d).alias(f"{n}_") for p, n in _PARTS.items()), scalar.extract("WEEKDAY", d).alias("weekday"), scalar.extract("YEARDAY", d).alias("yearday"), scalar.extract("MILLISECOND", d).alias("ms"),
        scalar.extract("TIMEZONE_HOUR", d, zone="Europe/Berlin").alias("zh"), scalar.extract("TIMEZONE_MINUTE", d, zone="America/St_Johns").alias("zm"), scalar.extract("TIMEZONE_NAME", d, zone="Europe/Berlin").alias("zn"),
    )


_COARSE, _FINE = ("month", "year", "day", "quarter", "hour"), ("week", "minute", "second", "millisecond")


@pair("SELECT l_orderkey, l_linenumber, " + ", ".join(f"date_diff('{u}', o_orderdate, l_shipdate) AS {u}s" for u in _COARSE) + ", strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fn_datetime_diff(spark, sf_dir):
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    rows = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", *(scalar.datediff(u, a, b).alias(f"{u}s") for u in _COARSE), F.date_format(F.expr("dateadd(DAY, 40, o_orderdate)"), "yyyy-MM-dd").alias("a"))


@pair("SELECT event_id, " + ", ".join(f"date_diff('{u}', TIMESTAMP '2023-12-31 23:59:59.9996', ts) AS {u}s" for u in _FINE[1:]) + ", date_diff('day', DATE '2023-12-25', date_trunc('week', ts)) // 7 AS weeks FROM events")
def fn_datetime_diff_fine(spark, sf_dir):
    start = F.lit("2023-12-31 23:59:59.9996").cast("timestamp_ntz")
    return read_table(spark, sf_dir, "events").select("event_id", *(scalar.datediff(u, start, F.col("ts")).alias(f"{u}s") for u in _FINE))


@pair("SELECT count(*) AS n, count(*) AS one_moment, count(*) AS whole_ms, count(*) AS same_day, count(*) AS same_time FROM nation")
def fn_current_moments(spark, sf_dir):
    now, local = scalar.current_timestamp(3), scalar.current_timestamp(3, local=True)
    rows = read_table(spark, sf_dir, "nation").select(now.alias("now"), local.alias("local"), F.current_date().alias("day"), scalar.current_time(3).alias("time"), scalar.current_time().alias("short"))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("now") == F.col("local").cast("timestamp")).alias("one_moment"), F.count_if(F.unix_micros("now") % 1000 == 0).alias("whole_ms"),
        F.count_if(F.col("now").cast("date") == F.col("day")).alias("same_day"), F.count_if(F.date_format("now", "HH:mm:ss.SSS").eqNullSafe(F.col("time")) & F.col("time").startswith(F.col("short"))).alias("same_time"),
    )


@pair("""SELECT event_id, extract(year FROM ts) || '/' || strftime(ts, '%Y-') || right(strftime(ts, '%Y'), 3) || ',' || strftime(ts, '%y') || ';' || right(strftime(ts, '%Y'), 1) AS y, quarter(ts) || strftime(ts, ' %m %b ') || upper(strftime(ts, '%B')) AS m,
       list_extract(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'], CAST(month(ts) AS BIGINT)) AS rm, lpad(CAST((dayofyear(ts) - 1) // 7 + 1 AS VARCHAR), 2, '0') || '.' || ((day(ts) - 1) // 7 + 1) AS w,
       (dayofweek(ts) + 1) || upper(strftime(ts, ' %A ')) || strftime(ts, '%d %j %a') AS d, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 2440588 AS VARCHAR) AS j,
       strftime(ts, '%I %I %H:%M:%S') AS h, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS VARCHAR) AS s, strftime(ts, '%f')[1:1] || ' ' || strftime(ts, '%f')[1:4] || ' ' || strftime(ts, '%f') || '000' AS f,
       CASE WHEN hour(ts) < 12 THEN 'A.M.' ELSE 'P.M.' END || strftime(ts, ' %p') AS p, 'Today "is" ' || upper(strftime(ts, '%A')) AS raw FROM events""")
def fn_cast_format(spark, sf_dir):
    d = F.col("ts")
    f = lambda p: scalar.format_datetime(d, p)
    return read_table(spark, sf_dir, "events").select(
        "event_id", f("YEAR/YYYY-YYY,YY;Y").alias("y"), f("Q MM MON month").alias("m"), f("RM").alias("rm"), f("WW.W").alias("w"), f("D DAY DD DDD DY").alias("d"), f("J").alias("j"), f("HH HH12 HH24:MI:SS").alias("h"), f("SSSSS").alias("s"),
        f("FF1 FF4 FF9").alias("f"), f("P.M. AM").alias("p"), f('"Today \\"is\\" "DAY').alias("raw"),
    )


@pair(f"""SELECT event_id, strftime(ts + INTERVAL 1 HOUR * CASE WHEN {_SUMMER} THEN 2 ELSE 1 END, '%H:%M ') || CASE WHEN {_SUMMER} THEN '+02:00' ELSE '+01:00' END || ' Europe/Berlin' AS berlin,
       strftime(ts + INTERVAL 345 MINUTE, '%d %H:%M ') || '+05 45' AS nepal FROM events""")
def fn_cast_format_zone(spark, sf_dir):
    d = F.col("ts")
    return read_table(spark, sf_dir, "events").select("event_id", scalar.format_datetime(d, "HH24:MI TZH:TZM TZR", "Europe/Berlin").alias("berlin"), scalar.format_datetime(d, "DD HH24:MI TZH TZM", "Asia/Kathmandu").alias("nepal"))


@pair("""SELECT o_orderkey, o_orderdate AS rr, o_orderdate + INTERVAL 13 HOUR + INTERVAL 7 MINUTE AS half, o_orderdate AS julian, o_orderdate + INTERVAL 3723 SECOND AS sec, o_orderdate AS roman, o_orderdate + INTERVAL 500 MILLISECOND AS frac,
       TIMESTAMP '2050-01-01 00:00:00' + INTERVAL 1 DAY * (day(o_orderdate) - 1) + INTERVAL 1 YEAR * (year(o_orderdate) % 10 - 0) AS short, CAST(NULL AS TIMESTAMP) AS bad FROM orders""")
def fn_cast_from_format(spark, sf_dir):
    d = F.col("o_orderdate")
    text = lambda f: F.upper(F.date_format(d, f))
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    parse = lambda t, p, today="2023-06-15": scalar.parse_datetime(t, p, F.lit(today).cast("date"))
    julian = (F.datediff(d, F.lit("1970-01-01").cast("date")) + 2440588).cast("string")
    return spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(
        "o_orderkey", parse(text("dd.MM.yy"), "DD.MM.RR").alias("rr"), parse(put(text("MMM dd yyyy"), " 01:07 p.m."), "MON DD YYYY HH12:MI A.M.").alias("half"), parse(julian, "J").alias("julian"),
        parse(put(text("yyyyMMdd"), " 3723"), "YYYYMMDD SSSSS").alias("sec"), parse(scalar.format_datetime(d, "DD-RM-YEAR"), "DD-RM-YEAR").alias("roman"), parse(put(text("MMMM/d/yyyy"), " 00:00:00.5"), "MONTH/DD/YEAR HH24:MI:SS.FF4").alias("frac"),
        parse(put(F.right(text("yyyy"), F.lit(1)), text(" dd")), "Y DD", "2055-01-31").alias("short"), parse(put(text("dd.MM.yyyy"), "\nx"), "DD.MM.YYYY").alias("bad"),
    )


@pair("SELECT event_id, date_trunc('second', ts) - INTERVAL 150 MINUTE AS offset_, date_trunc('second', ts) AS named, date_trunc('second', ts) + INTERVAL 90 MINUTE AS minus FROM events")
def fn_cast_from_format_zone(spark, sf_dir):
    d = F.col("ts")
    wall = F.date_format(d, "yyyy-MM-dd HH:mm:ss")
    pattern = "YYYY-MM-DD HH24:MI:SS "
    return spread(read_table(spark, sf_dir, "events").select("event_id", "ts")).select(
        "event_id", scalar.parse_datetime(F.concat(wall, F.lit(" +02:30")), pattern + "TZH:TZM").alias("offset_"),
        scalar.parse_datetime(F.concat(F.date_format(scalar.in_zone(d, "Asia/Kathmandu"), "yyyy-MM-dd HH:mm:ss"), F.lit(" Asia/Kathmandu")), pattern + "TZR").alias("named"),
        scalar.parse_datetime(F.concat(wall, F.lit(" -1:30")), pattern + "TZH:TZM").alias("minus"),
    )


@pair(f"SELECT event_id, ts + INTERVAL 1 HOUR * CASE WHEN {_SUMMER} THEN 2 ELSE 1 END AS berlin, ts - INTERVAL 1 HOUR * CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN 4 ELSE 5 END AS york FROM events")
def zone_conversion(spark, sf_dir):
    d = F.col("ts")
    return read_table(spark, sf_dir, "events").select("event_id", scalar.in_zone(d, "Europe/Berlin").alias("berlin"), scalar.in_zone(d, "America/New_York").alias("york"))


@pair("""SELECT * FROM (VALUES (TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-03-26 01:00:00', 60, 0), (TIMESTAMP '2023-03-26 01:00:00', TIMESTAMP '2023-10-29 01:00:00', 120, 60),
       (TIMESTAMP '2023-10-29 01:00:00', TIMESTAMP '2024-01-01 00:00:00', 60, 0)) AS t("start", "end", offset_minutes, dst_minutes)""")
def zone_transitions(spark, sf_dir):
    return relational.zone_transitions(spark, "Europe/Berlin", "2023-01-01", "2024-01-01")


# --- JSON, encodings, context


@pair("""SELECT event_id, json_extract_string(props, '$.k') AS v, json_extract_string(props, '$.none') AS none, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) AS ok,
       '{"k":"' || event_type || '","u":' || user_id || ',"z":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE 'true' END || '}' AS obj, '["' || event_type || '\\"",' || user_id || ',' || (event_id % 2 = 0) || ',null]' AS arr FROM events""")
def fn_json(spark, sf_dir):
    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id", scalar.json_extract(F.col("props"), "$.k").alias("v"), scalar.json_extract(F.col("props"), "$.none").alias("none"), scalar.json_valid(F.when(i % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("ok"),
        scalar.json_object(k=F.col("event_type"), u=F.col("user_id"), z=F.when(i % 2 == 1, True)).alias("obj"), scalar.json_array(F.concat("event_type", F.lit('"')), F.col("user_id"), i % 2 == 0, F.lit(None).cast("string")).alias("arr"),
    )


@pair("""SELECT event_id, CAST(json_merge_patch(props, json_object('t', json_object('a', user_id, 'b', [event_type]), 'u', CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 2.25 END)) AS VARCHAR) AS merged,
       CAST(json_merge_patch(props, json_object('k', user_id)) AS VARCHAR) AS changed, CAST(json_merge_patch(props, json_object('t', json_object('x', json_object('y', event_type)))) AS VARCHAR) AS deep,
       CAST(json_merge_patch(props, json_object('k', json_object('x', event_id % 2 = 0))) AS VARCHAR) AS over FROM events""")
def fn_json_edit(spark, sf_dir):
    p, i, u = F.col("props"), F.col("event_id"), F.col("user_id")
    other = F.to_json(F.struct(F.struct(u.alias("a"), F.array("event_type").alias("b")).alias("t"), F.when(i % 2 == 0, 1.5).otherwise(2.25).alias("u")))
    return read_table(spark, sf_dir, "events").select(
        "event_id", scalar.json_merge(p, other).alias("merged"), scalar.json_set(p, "$.k", u).alias("changed"), scalar.json_set(p, "$.t.x.y", F.col("event_type")).alias("deep"), scalar.json_set(p, "$.k", F.lit(1), "$.k.x", i % 2 == 0).alias("over")
    )


@pair("SELECT c_custkey, c_name AS h, c_name AS b FROM customer")
def fn_decode(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", scalar.hex_decode(F.hex("c_name")).cast("string").alias("h"), scalar.base64_decode(F.base64(F.col("c_name").cast("binary"))).cast("string").alias("b"))


@pair("SELECT count(*) AS n, count(*) AS sevens, count(*) AS variants, count(*) AS fours, count(*) AS ones, count(*) AS sixes, count(*) AS eights, count(*) AS times FROM nation")
def gen_uuid_versions(spark, sf_dir):
    rows = read_table(spark, sf_dir, "nation").select(*(routines.gen_uuid(v).alias(f"v{v}") for v in (1, 4, 6, 7, 8)))
    is_version = lambda v: F.count_if(F.col(f"v{v}").rlike(rf"\A[0-9a-f]{{8}}-[0-9a-f]{{4}}-{v}[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}\z"))
    # versions 1 and 6 hold one moment in different orders
    same = F.concat(F.substring("v6", 1, 8), F.substring("v6", 10, 4), F.substring("v6", 16, 3)) == F.concat(F.substring("v1", 16, 3), F.substring("v1", 10, 4), F.substring("v1", 1, 8))
    return rows.agg(F.count_distinct("v7").alias("n"), is_version(7).alias("sevens"), F.count_if(F.substring("v7", 20, 1).isin(*"89ab")).alias("variants"), is_version(4).alias("fours"), is_version(1).alias("ones"), is_version(6).alias("sixes"), is_version(8).alias("eights"), F.count_if(same).alias("times"))


@pair("SELECT count(*) AS users, count(*) AS roles, 1 AS connections, 1 AS transactions FROM nation")
def fn_who(spark, sf_dir):
    rows = read_table(spark, sf_dir, "nation").select(routines.current_user().alias("u"), routines.current_role().alias("r"), routines.current_connection(spark).alias("c"), routines.current_transaction(spark).alias("t"))
    return rows.agg(F.count_if(F.length("u") > 0).alias("users"), F.count_if(F.col("r") == "NONE").alias("roles"), F.count_distinct("c").cast("int").alias("connections"), F.count_distinct("t").cast("int").alias("transactions"))


both("fn_iif_sql", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'n' END AS i FROM customer", "SELECT c_custkey, if(c_acctbal > 0, 'p', 'n') AS i FROM customer")
