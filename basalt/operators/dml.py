"""Data modification as functions of DataFrames: the new table, and the rows returned.

Conditions and values are SQL texts.  In MERGE and UPDATE OR INSERT the source
is joined once (full outer) and each joined row takes the first clause that
applies; a target row that two source rows match is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from basalt.names import free
from basalt.operators.relational import sort_key


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, str] | None = None, identity: dict[str, str] | None = None, overriding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... SELECT: absent columns take their default or null.

    ``identity`` names generated columns as "always" or "by default", whose
    values come from ``defaults`` where rows don't give them.  A value for an "always"
    column is an error unless ``overriding`` is "system"; "user" drops given values.
    """
    defaults, identity = defaults or {}, identity or {}
    given = [c for c in rows.columns if not (overriding == "user" and c in identity)]
    refused = [c for c in given if identity.get(c) == "always" and overriding != "system"]
    if refused:
        raise ValueError(f"generated always: {refused}")
    new = rows.select(*((F.col(f.name) if f.name in given else F.expr(defaults.get(f.name, "null"))).cast(f.dataType).alias(f.name) for f in table.schema.fields))
    return table.unionByName(new), new


def insert_values(table: DataFrame, rows: list[tuple], columns: list[str] | None = None, defaults: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... VALUES, one row or several; an empty tuple stands for DEFAULT VALUES."""
    names = columns or table.columns
    kinds = {f.name: f.dataType for f in table.schema.fields}
    if [()] == rows:
        return insert(table, table.sparkSession.range(1).drop("id"), defaults)
    schema = StructType([StructField(n, kinds[n]) for n in names])
    return insert(table, table.sparkSession.createDataFrame(rows, schema), defaults)


def _affected(table: DataFrame, where: str | None, order_by: list[str] | None, rows: tuple[int, int] | None) -> tuple[DataFrame, str]:
    """``table`` with a column that marks hit rows, and its name; ROWS m TO n takes the m-th to n-th in the order given, ties by the other columns.

    The rows taken are a sort with a limit; they are found again in the table
    by equality of all columns, in one join, and only rows equal to one of them
    are counted.
    """
    names = table.columns
    hit, copies, n, row, *own = free("hit", "copies", "n", "row", *(f"c{i}" for i in range(len(names))), of=(table,))
    marked = table.withColumn(hit, F.coalesce(F.expr(where or "true"), F.lit(False)))
    if not rows:
        return marked, hit
    first, last = rows
    taken = marked.where(hit).orderBy(*map(sort_key, order_by or []), *names).offset(first - 1).limit(max(0, last - first + 1))
    taken = taken.groupBy(*(F.col(c).alias(o) for c, o in zip(names, own, strict=True))).agg(F.count("*").alias(copies))
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(names, own, strict=True)]
    met = marked.join(taken, [F.col(hit), *same], "left").withColumn(row, F.monotonically_increasing_id())
    # rows that equal a taken one are counted together, every other row stands alone
    alone = F.when(F.col(copies).isNull(), F.col(row))
    equal = Window.partitionBy(*names, alone).orderBy(row)
    return met.withColumn(n, F.row_number().over(equal)).select(*names, F.coalesce(F.col(n) <= F.col(copies), F.lit(False)).alias(hit)), hit


def update(table: DataFrame, sets: dict[str, str], where: str | None = None, order_by: list[str] | None = None, rows: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The new table, and the changed rows with old_ and new_ columns."""
    (marked, hit), names = _affected(table, where, order_by, rows), table.columns
    kinds = {f.name: f.dataType for f in table.schema.fields}
    new = {n: F.when(F.col(hit), F.expr(sets[n]).cast(kinds[n])).otherwise(F.col(n)) if n in sets else F.col(n) for n in names}
    out = marked.select(*(c.alias(n) for n, c in new.items()))
    returning = marked.where(hit).select(*(F.col(n).alias(f"old_{n}") for n in names), *(c.alias(f"new_{n}") for n, c in new.items()))
    return out, returning


def delete(table: DataFrame, where: str | None = None, order_by: list[str] | None = None, rows: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """A row stays if the condition is false or null."""
    marked, hit = _affected(table, where, order_by, rows)
    return marked.where(~F.col(hit)).drop(hit), marked.where(hit).drop(hit)


@dataclass
class Clause:
    """when: matched, not matched, not matched by source; action: update, delete, insert.

    ``values`` and ``condition`` name the tables as t and s.
    """

    when: str
    action: str
    values: dict[str, str] = field(default_factory=dict)
    condition: str | None = None


def merge(target: DataFrame, source: DataFrame, on: str, clauses: list[Clause]) -> tuple[DataFrame, DataFrame]:
    """The new table, and RETURNING: action, old_ and new_ columns of each affected row.

    ``on`` should hold an equality of the two tables' columns: a full join by
    anything else has no other plan than comparing all pairs, and is Spark's to refuse.
    """
    names = target.columns
    kinds = {f.name: f.dataType for f in target.schema.fields}
    tid, sid, state, clause, gone, key, changes, turn, old, new_ = free("t", "s", "state", "clause", "gone", "key", "changes", "turn", "old", "new", of=(target, source))
    t = target.withColumn(tid, F.monotonically_increasing_id()).alias("t")
    s = source.withColumn(sid, F.monotonically_increasing_id()).alias("s")
    both = t.join(s, F.expr(on), "full")
    met = F.when(F.col(tid).isNull(), "not matched").when(F.col(sid).isNull(), "not matched by source").otherwise("matched")
    chosen: Column = F.lit(-1)
    for i, c in reversed(list(enumerate(clauses))):
        chosen = F.when((F.col(state) == c.when) & F.coalesce(F.expr(c.condition or "true"), F.lit(False)), F.lit(i)).otherwise(chosen)
    both = both.withColumn(state, met).withColumn(clause, chosen)
    new = {}
    for n in names:
        value = F.col(f"t.{n}")
        for i, c in enumerate(clauses):
            if c.action != "delete" and (n in c.values or c.action == "insert"):
                value = F.when(F.col(clause) == i, F.expr(c.values.get(n, "null")).cast(kinds[n])).otherwise(value)
        new[n] = value
    is_delete = F.col(clause).isin([i for i, c in enumerate(clauses) if c.action == "delete"])
    # a source row without a target is counted alone
    own = F.coalesce(F.col(tid), -1 - F.col(sid))
    full = both.select(state, clause, own.alias(key), is_delete.alias(gone), F.struct(*(F.col(f"t.{n}").alias(n) for n in names)).alias(old), F.struct(*(v.alias(n) for n, v in new.items())).alias(new_))
    mine = Window.partitionBy(key)
    applied = (F.col(state) == "matched") & (F.col(clause) >= 0)
    full = full.withColumns({changes: F.count_if(applied).over(mine), turn: F.row_number().over(mine.orderBy(F.col(clause).desc()))})
    twice = F.when(F.col(changes) > 1, F.raise_error(F.lit("a target row has more than one source row")).cast("boolean")).otherwise(True)
    stays = F.when(F.col(state) == "not matched", F.col(clause) >= 0).when(F.col(state) == "matched", applied | ((F.col(changes) == 0) & (F.col(turn) == 1))).otherwise(True)
    out = full.where(twice & stays)
    action = F.lit(None).cast("string")
    for i, c in enumerate(clauses):
        action = F.when(F.col(clause) == i, F.lit(c.action)).otherwise(action)
    table = out.where(~F.col(gone)).select(*(F.col(new_)[n].alias(n) for n in names))
    told = out.where(F.col(clause) >= 0).select(action.alias("action"), *(F.col(old)[n].alias(f"old_{n}") for n in names), *(F.when(~F.col(gone), F.col(new_)[n]).alias(f"new_{n}") for n in names))
    return table, told


def update_or_insert(table: DataFrame, row: DataFrame, matching: list[str]) -> tuple[DataFrame, DataFrame]:
    """UPDATE OR INSERT ... MATCHING: null matches null."""
    on = " and ".join(f"t.`{m}` <=> s.`{m}`" for m in matching)
    values = {c: f"s.`{c}`" for c in row.columns}
    return merge(table, row, on, [Clause("matched", "update", values), Clause("not matched", "insert", values)])
