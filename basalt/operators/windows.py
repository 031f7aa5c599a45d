"""Window forms that Spark refuses, as windows that it accepts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from basalt.names import free


def filtered(aggregate, value: Column, condition: Column, window: WindowSpec) -> Column:
    """agg(value) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, value)).over(window)


def distinct_over(df: DataFrame, partition: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over whole partitions that a window refuses, such as count(DISTINCT x).

    They are computed by GROUP BY, in parts before the shuffle, and joined back, so no
    task holds the values of a partition.
    """
    own = free(*partition, of=(df,))
    totals = df.groupBy(*(F.col(p).alias(o) for p, o in zip(partition, own, strict=True))).agg(*(a.alias(n) for n, a in aggregates.items()))
    same = [F.col(p).eqNullSafe(F.col(o)) for p, o in zip(partition, own, strict=True)]
    return df.join(totals, same, "left").drop(*own)


def nth_from_last(value: Column, n: int, partition: list, order: list[str], frame_end: int = Window.unboundedFollowing) -> Column:
    """NTH_VALUE(value, n) FROM LAST over a frame from the first row to ``frame_end``: the order and frame mirrored."""
    turned = Window.partitionBy(*partition).orderBy(*(F.col(o).desc_nulls_last() for o in order))
    start = Window.unboundedPreceding if frame_end == Window.unboundedFollowing else -frame_end
    return F.nth_value(value, n).over(turned.rowsBetween(start, Window.unboundedFollowing))


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


# What joins the aggregates of two parts of a frame; least and greatest skip nulls.
_JOINED: dict[str, Callable[[Column, Column], Column]] = {"sum": _added, "count": _added, "min": F.least, "max": F.greatest}


def excluding(aggregate: str, value: Column, partition: list, order: list, frame: tuple[int, int], exclude: str = "current row") -> Column:
    """aggregate(value) OVER (... EXCLUDE ...), for sum, count, min and max.

    EXCLUDE CURRENT ROW takes a ROWS frame.  EXCLUDE GROUP and TIES take a frame
    in groups of peers, by their dense rank (see ``peers``) as the only order.
    """
    joined, whole = _JOINED[aggregate], getattr(F, aggregate)
    window = Window.partitionBy(*partition).orderBy(*order)
    between = window.rowsBetween if exclude == "current row" else window.rangeBetween
    start, end = frame
    parts = [whole(value).over(between(a, b)) for a, b in ((start, min(end, -1)), (max(start, 1), end)) if a <= b]
    if exclude == "ties":
        parts.append(F.when(value.isNotNull(), 1).otherwise(0) if aggregate == "count" else value)
    out = parts[0] if parts else F.lit(0 if aggregate == "count" else None)
    for part in parts[1:]:
        out = joined(out, part)
    return out


def peers(df: DataFrame, name: str, partition: list, order: list) -> DataFrame:
    """``df`` with the dense rank of its rows, which tells groups of peers apart."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
