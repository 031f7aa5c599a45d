"""Numbers of rows in an order, without a task that sees all rows.

Rows are dealt by ranges of their order (a random tie-breaker splits an order
value that very many rows share), numbered within their range, and written to
the session's checkpoint folder so that the ranges can't change.  One row for
each range then tells how many rows come before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.names import free
from basalt.operators.relational import sort_key
from basalt.session import checkpoint_folder

_WITHIN = (1 << 33) - 1  # the low bits of monotonically_increasing_id count within a partition


def numbered(df: DataFrame, name: str, order: list[str] | None = None, start: int = 1, step: int = 1) -> DataFrame:
    """``df`` with start, start + step, ... in the order given (keys as in ``ordered``); no gaps."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    tie, range_, at, of, rows, before_ = free("tie", "range", "at", "of", "rows", "before", of=(df,))
    keys = [*map(sort_key, order or []), F.col(tie)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(tie, F.rand(42)).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(tie)
    placed = dealt.withColumns({range_: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))}).checkpoint()
    earlier = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = placed.groupBy(F.col(range_).alias(of)).agg(F.count("*").alias(rows))
    before = counts.select(of, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(before_))
    out = placed.join(F.broadcast(before), F.col(range_) == F.col(of))
    number = ((F.col(before_) + F.col(at)) * step + start).alias(name)
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()), number)
