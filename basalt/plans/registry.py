"""Where queries and the SQL that gives the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.sources import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TABLES = "region nation customer supplier part orders lineitem events documents".split()


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """A text that the two dialects share, or one for each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in _TABLES if t in (spark_text or text)])
        return spark.sql(spark_text or text)

    QUERIES[name], SQL[name] = run, text


def pair(text: str | None):
    """A function of DataFrames, and the other side's text."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add
