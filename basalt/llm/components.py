"""Connected components of a link table, as rounds of large-star and small-star joins.

No link or component ever reaches the driver: each round writes its links to
the shared folder, and only a count and a checksum come back to see whether
anything moved.  A node with very many links is a partial aggregate (its
minimum) followed by a sort-merge join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import delete_path, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of that node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("w"), "m")
    low = edges.join(least, F.col("b") == F.col("w")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("w").alias("b"))
    return low.unionByName(own).where("a < b").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``edges`` (a, b: long, a < b) to (node, root): root is the least node that can be reached.

    Nodes without links don't occur; no links give no rows.  Also returns the
    path of the table so that the caller can delete it.
    """
    now, path = stored(edges.where("a < b").distinct(), "links")
    seen = _state(now)
    while True:
        after, new = stored(_small_star(_large_star(now)), "links")
        delete_path(now.sparkSession, path)
        state = _state(after)
        now, path = after, new
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), path
