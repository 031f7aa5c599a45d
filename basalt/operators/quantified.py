"""Quantified predicates over a set, without a nested loop.

The set is reduced to a row of facts (rows, nulls, least, greatest) for each
correlation key, or one row if there is none; ``=`` and ``<>`` also need
membership, an equi-join with the distinct values.  With x op v over all v:

    ANY      some comparison is true
    ALL      none is false or null; true on the empty set
    NOT ANY  none is true or null; true on the empty set
    NOT ALL  some comparison is false
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NEGATED = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _some(op: str, x: Column) -> Column:
    least, most, member = F.col("__least"), F.col("__most"), F.col("__member")
    found = {"<": x < most, "<=": x <= most, ">": x > least, ">=": x >= least, "=": member, "<>": (x != least) | (x != most)}[op]
    return F.coalesce(found, F.lit(False))


def quantified(df: DataFrame, x: str, op: str, kind: str, values: DataFrame, v: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` for which ``x op kind (values.v)`` holds; ``keys`` are columns of both that correlate them."""
    keys = keys or []
    own = values.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(v).alias("__v"))
    facts = own.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.count("*").alias("__n"), F.count_if(F.col("__v").isNull()).alias("__nulls"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    rows = df.join(facts, on, "left") if keys else df.crossJoin(F.broadcast(facts))  # one row
    rows = rows.drop(*(f"__k{i}" for i in range(len(keys))))
    if op in ("=", "<>"):
        member = own.where("__v is not null").distinct().withColumn("__member", F.lit(True))
        rows = rows.join(member, [*on, F.col(x) == F.col("__v")], "left")
    else:
        rows = rows.withColumn("__member", F.lit(False))
    value, n = F.col(x), F.coalesce("__n", F.lit(0))
    true, false = _some(op, value), _some(_NEGATED[op], value)
    null = (n > 0) & (value.isNull() | (F.coalesce("__nulls", F.lit(0)) > 0))
    if op == "<>":
        false = F.coalesce(F.col("__member"), F.lit(False))
    holds = {"any": true, "all": ~(false | null), "not any": ~(true | null), "not all": false}[kind.lower()]
    return rows.where(holds).select(*df.columns)


def singular(df: DataFrame, other: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``df`` with exactly one row of ``other`` for (own column, other's column) pairs."""
    names = [o for _, o in keys]
    once = other.groupBy(*names).agg(F.count("*").alias("__n")).where("__n = 1").select(*(F.col(o).alias(f"__{o}") for o in names))
    return df.join(once, [F.col(a) == F.col(f"__{o}") for a, o in keys], "left_semi")
