"""Row limits, set operations with type rules, table functions, recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.names import free

MAX_DEPTH = 1024


def first_skip(df: DataFrame, first: int | None = None, skip: int = 0) -> DataFrame:
    out = df.offset(skip) if skip else df
    return out.limit(first) if first is not None else out


def rows(df: DataFrame, m: int, n: int | None = None) -> DataFrame:
    """ROWS m, or ROWS m TO n: from the m-th to the n-th row."""
    return df.limit(m) if n is None else df.offset(m - 1).limit(max(0, n - m + 1))


def limited(df: DataFrame, first: int | None = None, skip: int | None = None, rows_from: int | None = None, rows_to: int | None = None, offset: int | None = None, fetch: int | None = None) -> DataFrame:
    """The limits of one SELECT: FIRST/SKIP, or ROWS, or OFFSET/FETCH; mixing them is refused."""
    forms = [first is not None or skip is not None, rows_from is not None or rows_to is not None, offset is not None or fetch is not None]
    if sum(forms) > 1:
        raise ValueError("FIRST/SKIP, ROWS and OFFSET/FETCH cannot be mixed")
    if any(x is not None and x < 0 for x in (first, skip, rows_from, rows_to, offset, fetch)):
        raise ValueError("a negative limit")
    if forms[1]:
        return rows(df, rows_from, rows_to)
    out = df.offset(skip or offset or 0)
    size = first if forms[0] else fetch
    return out if size is None else out.limit(size)


# Rows of a side in one cell of a join by cells, and cells that one partition takes.
CELL_ROWS, CELLS = 2048, 4


def cell_join(left: DataFrame, right: DataFrame, on: tuple[str, str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """An equi-join of columns with few different values, where each key meets a large share of both tables.

    The pairs of a key are a grid: each side's rows are dealt over CELL_ROWS at
    a time by the hash of the row, one side over the grid's rows and the other
    over its columns, and each row is repeated along the other side.  A cell
    holds a bounded number of pairs (more only for copies of one row), so no
    task takes a whole key and none has to hold it.  how="full" adds each side's
    rows without a partner.  ``null_safe``: null meets null.
    """
    if how not in ("inner", "full"):
        raise ValueError(f"no such join: {how!r}")
    x, y = on
    if set(left.columns) & set(right.columns):
        raise ValueError(f"columns of both sides: {sorted(set(left.columns) & set(right.columns))}")
    key, other, across, down, i, j, to_i, to_j, mine, yours = free("key", "other", "across", "down", "i", "j", "to_i", "to_j", "mine", "yours", of=(left, right))
    met = lambda a, b: F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
    whole = lambda c: F.struct(F.col(c).alias(key)) if null_safe else F.col(c)  # noqa: E731  # structs that hold null are equal, and the join keeps the tables' partitions
    cells = lambda df, c, k, n: df.groupBy(F.col(c).alias(k)).agg(F.ceil(F.count("*") / CELL_ROWS).alias(n))
    grid = cells(left, x, key, down).join(cells(right, y, other, across), met(key, other)).select(key, down, across)
    total = grid.agg(F.sum(F.col(down) * F.col(across))).head()[0] or 0
    parts = max(1, min(100_000, -(-total // CELLS)))

    def dealt(df: DataFrame, c: str, to: str, own: str, size: str, along: str, length: str) -> DataFrame:
        rows = df.join(grid, met(c, key)).withColumns({to: whole(c), own: F.pmod(F.xxhash64(*(F.col(n) for n in df.columns)), F.col(size)), along: F.explode(F.sequence(F.lit(0), F.col(length) - 1))})
        return rows.select(*df.columns, to, own, along)

    a = dealt(left, x, mine, i, down, j, across).repartition(parts, mine, i, j)
    b = dealt(right, y, yours, to_j, across, to_i, down).repartition(parts, yours, to_i, to_j)
    out = a.join(b.hint("merge"), (F.col(mine) == F.col(yours)) & (F.col(i) == F.col(to_i)) & (F.col(j) == F.col(to_j))).select(*left.columns, *right.columns)
    if how == "inner":
        return out
    nulls = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    alone = lambda df, c, far, f: df.join(far.select(F.col(f).alias(key)).distinct(), met(c, key), "left_anti")
    return out.unionAll(alone(left, x, right, y).select(*left.columns, *nulls(right))).unionAll(alone(right, y, left, x).select(*nulls(left), *right.columns))


def ordered_union(df: DataFrame, *ordinals: str) -> DataFrame:
    """ORDER BY of a union: by ordinals only, as ``2``, ``1 desc``, ``3 desc nulls last``."""
    keys = []
    for key in ordinals:
        number, *rest = key.split()
        if not number.isdigit() or not 1 <= int(number) <= len(df.columns):
            raise ValueError(f"a union is sorted by ordinals, not by {number!r}")
        keys.append(" ".join([df.columns[int(number) - 1], *rest]))
    return ordered(df, *keys)


def offset_fetch(df: DataFrame, offset: int = 0, fetch: int = 1) -> DataFrame:
    return df.offset(offset).limit(fetch)


def sort_key(key: str) -> Column:
    """``name``, ``name desc``, ``name desc nulls last``; nulls come first unless said."""
    name, *words = key.split()
    down, last = "desc" in map(str.lower, words), "last" in map(str.lower, words)
    c = F.col(name)
    if down:
        return c.desc_nulls_last() if last else c.desc_nulls_first()
    return c.asc_nulls_last() if last else c.asc_nulls_first()


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*map(sort_key, keys))


def _unified(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a column of a union: text over numbers, approximate over exact, the widest exact."""
    if a == b:
        return a
    kinds = (a, b)
    if any(isinstance(t, T.NullType) for t in kinds):
        return b if isinstance(a, T.NullType) else a
    if any(isinstance(t, T.BinaryType) for t in kinds):
        return T.BinaryType()
    if any(isinstance(t, T.StringType) for t in kinds):
        return T.StringType()
    if any(isinstance(t, (T.DoubleType, T.FloatType)) for t in kinds) and all(isinstance(t, T.NumericType) for t in kinds):
        return T.DoubleType()
    if all(isinstance(t, T.NumericType) for t in kinds):
        digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
        shape = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (digits[t.simpleString()], 0) for t in kinds]
        if all(s == 0 and p in digits.values() for p, s in shape) and not any(isinstance(t, T.DecimalType) for t in kinds):
            return max(kinds, key=lambda t: digits[t.simpleString()])
        scale = max(s for _, s in shape)
        return T.DecimalType(min(38, max(p - s for p, s in shape) + scale), scale)
    if all(isinstance(t, (T.TimestampType, T.TimestampNTZType)) for t in kinds):
        return T.TimestampType()
    raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def union(*branches: DataFrame, distinct: bool = False) -> DataFrame:
    """Branches by position, names of the first, each column of its unified type."""
    names = branches[0].columns
    kinds = [reduce(_unified, ts) for ts in zip(*([f.dataType for f in b.schema.fields] for b in branches), strict=True)]
    cast = [b.toDF(*names).select(*(F.col(n).cast(t).alias(n) for n, t in zip(names, kinds, strict=True))) for b in branches]
    out = reduce(DataFrame.unionAll, cast)
    return out.distinct() if distinct else out


def unlist(text: Column, separator: str | None = ",", kind: str = "string") -> Column:
    """The tokens of a text as an array to explode: no empty ones; null gives none; no separator gives the text itself."""
    if separator is None:
        return F.array().cast(f"array<{kind}>")
    if separator == "":
        return F.when(text.isNotNull(), F.array(text.cast(kind)))
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.transform(F.filter(F.split(text, quoted), lambda x: x != ""), lambda x: x.cast(kind))


def listing(value: str, separator: str = ",", distinct: bool = False) -> Column:
    """LIST: not-null values in ascending order, joined; null if there are none."""
    gathered = F.collect_set(value) if distinct else F.collect_list(value)
    joined = F.array_join(F.transform(F.sort_array(gathered), lambda x: x.cast("string")), separator)
    return F.when(F.count(value) > 0, joined)


def recursive(spark: SparkSession, name: str, columns: list[str], anchor: str, member: str, query: str, depth: int = MAX_DEPTH) -> DataFrame:
    """WITH RECURSIVE with a limit on the depth, 1024 unless said."""
    return spark.sql(f"WITH RECURSIVE {name}({', '.join(columns)}) MAX RECURSION LEVEL {depth} AS ({anchor} UNION ALL {member}) {query}")


def singleton(df: DataFrame) -> DataFrame:
    """The only row; an error at run time if there is a second."""
    (n,) = free("n", of=(df,))
    return df.limit(2).withColumn(n, F.count("*").over(_everything())).where(F.when(F.col(n) > 1, F.raise_error(F.lit("multiple rows in singleton select"))).otherwise(F.lit(True)).cast("boolean")).drop(n)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def conditional(condition: bool, then: DataFrame, otherwise: DataFrame) -> DataFrame:
    """One of two plans, chosen when the query is built."""
    return then if condition else otherwise


def explain(spark: SparkSession, sql: str) -> DataFrame:
    """The plan of a statement as rows (line, text)."""
    text = spark.sql("EXPLAIN FORMATTED " + sql).first()[0]
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, text string")


def unqualified_names(spark: SparkSession, names: str) -> DataFrame:
    """A list of names as rows; those without quotes in upper case."""
    import re

    found = [m[1].replace('""', '"') if m[1] is not None else m[2].upper() for m in re.finditer(r'\s*(?:"((?:[^"]|"")*)"|([^",\s]+))\s*(?:,|$)', names)]
    return spark.createDataFrame([(n,) for n in found], "name string")


def zone_transitions(spark: SparkSession, zone: str, since: str, until: str) -> DataFrame:
    """(start, end, offset_minutes, dst_minutes) of a time zone's periods between two dates, to the second.

    Days are compared, and a day whose ends differ is halved down to the second; no
    zone changes twice within a day and back.
    """
    import datetime as dt
    from zoneinfo import ZoneInfo

    tz, utc = ZoneInfo(zone), dt.timezone.utc
    first, last = (int(dt.datetime.fromisoformat(x).replace(tzinfo=utc).timestamp()) for x in (since, until))

    def facts(second: int) -> tuple[int, int]:
        here = dt.datetime.fromtimestamp(second, utc).astimezone(tz)
        return int(here.utcoffset().total_seconds() // 60), int((here.dst() or dt.timedelta()).total_seconds() // 60)

    def change(lo: int, hi: int) -> int:
        """The first second after ``lo`` whose facts differ from those at ``lo``; they do at ``hi``."""
        while hi - lo > 1:
            middle = (lo + hi) // 2
            lo, hi = (middle, hi) if facts(middle) == facts(lo) else (lo, middle)
        return hi

    out, start, at = [], first, first
    while at < last:
        after = min(at + 86_400, last)
        if facts(after) != facts(start):
            after = change(at, after)
        if after == last or facts(after) != facts(start):
            out.append((start, after, *facts(start)))
            start = after
        at = after
    moment = lambda s: dt.datetime.fromtimestamp(s, utc).replace(tzinfo=None)
    return spark.createDataFrame([(moment(a), moment(b), *rest) for a, b, *rest in out], "start timestamp_ntz, end timestamp_ntz, offset_minutes int, dst_minutes int")
