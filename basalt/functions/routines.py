"""Routines: functions over Arrow batches, row-producing procedures, blocks, session variables, output coercion."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from basalt.operators.relational import union


def scalar_function(spark: SparkSession, name: str, body: Callable[..., pd.Series], returns: str, deterministic: bool = True):
    """CREATE FUNCTION: ``body`` maps columns as pandas Series, a batch at a time; usable in SQL by its name."""
    made = F.pandas_udf(body, returnType=returns)
    return spark.udf.register(name, made if deterministic else made.asNondeterministic())


def procedure(spark: SparkSession, name: str, body: Callable, returns: str) -> None:
    """A selectable procedure: a generator of rows, called in FROM, after LATERAL with columns of the tables before it."""

    class Rows:
        def eval(self, *arguments):
            yield from body(*arguments)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))


def call(routine: Callable, defaults: dict[str, object], *positional, **named):
    """CALL with positional and named arguments; the others take their defaults."""
    names = list(defaults)
    if len(positional) > len(names):
        raise TypeError(f"at most {len(names)} arguments")
    given = dict(zip(names, positional, strict=False))
    for key in named:
        if key in given or key not in defaults:
            raise TypeError(f"argument {key!r} is unknown or given twice")
    return routine(**(defaults | given | named))


def for_range(first: int, last: int, body: Callable[[int], DataFrame], by: int = 1) -> DataFrame:
    """FOR i = first TO last BY step DO SUSPEND: the frames of a short, literal loop, joined end to end."""
    return union(*(body(i) for i in range(first, last + (1 if by > 0 else -1), by)))


def execute_block(spark: SparkSession, body: str) -> DataFrame:
    """EXECUTE BLOCK: declarations, IF, WHILE, FOR SELECT, LEAVE, handlers; gives the rows of its last query."""
    return spark.sql(f"BEGIN {body} END")


def set_context(spark: SparkSession, key: str, value: object) -> None:
    """A context variable of the session; SQL reads it by its name."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE `{key}` STRING DEFAULT NULL")
    if value is not None:
        spark.sql(f"SET VAR `{key}` = :value", {"value": str(value)})


def get_context(spark: SparkSession, key: str) -> str | None:
    return spark.sql(f"SELECT `{key}` AS v").first()["v"]


def gen_uuid(version: int = 4) -> Column:
    """Version 4 is random; 1, 6 and 7 hold the query's time (in units of 100 ns since 1582, or in milliseconds) before random digits; 8 random digits under its mark."""
    if version == 4:
        return F.uuid()
    text = lambda *parts: F.concat_ws("-", *parts)
    rest = F.substring(F.uuid(), 20, 17)  # variant and random node
    ticks = F.lower(F.lpad(F.hex(F.unix_micros(F.current_timestamp()) * 10 + 122_192_928_000_000_000), 15, "0"))
    cut = lambda a, n: F.substring(ticks, a, n)
    if version == 1:
        return text(cut(8, 8), cut(4, 4), F.concat(F.lit("1"), cut(1, 3)), rest)
    if version == 6:
        return text(cut(1, 8), cut(9, 4), F.concat(F.lit("6"), cut(13, 3)), rest)
    if version == 7:
        at = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
        return text(F.substring(at, 1, 8), F.substring(at, 9, 4), F.concat(F.lit("7"), F.substring(F.uuid(), 16, 3)), rest)
    if version == 8:
        return text(F.substring(F.uuid(), 1, 13), F.concat(F.lit("8"), F.substring(F.uuid(), 16, 3)), rest)
    raise ValueError("version 1, 4, 6, 7 or 8")


def current_user() -> Column:
    return F.current_user()


def current_role() -> Column:
    """NONE: the catalog of a session has no roles."""
    return F.lit("NONE")


def current_connection(spark: SparkSession) -> Column:
    """The session's number within its application."""
    return F.lit(f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}")


def current_transaction(spark: SparkSession) -> Column:
    """Every query reads its own snapshot; it is numbered by the moment at which it was built."""
    return F.lit(time.time_ns())


def bind(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """SET BIND: columns of the types named are cast for output; booleans become TRUE and FALSE."""

    def cast(name: str, kind: DataType) -> Column:
        to = rules.get(kind.simpleString()) or rules.get(kind.typeName())
        c = F.col(f"`{name}`")
        return c if not to else (F.upper(c.cast(to)) if kind.typeName() == "boolean" and to == "string" else c.cast(to)).alias(name)

    return df.select(*(cast(f.name, f.dataType) for f in df.schema.fields))


def blob_read(value: Column, start: int, length: int) -> Column:
    """``length`` bytes from byte ``start`` (from 0), less at the end."""
    return F.substring(value.cast("binary"), start + 1, length)
