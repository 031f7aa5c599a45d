"""Change logs and event windows, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.names import free


def _last(changes: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The change of the highest sequence of each key: a maximum that is found in parts, so a frequent key costs no sort."""
    (row,) = free("row", of=(changes,))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.col(sequence)).alias(row)).select(f"{row}.*")


def apply_changes(changes: DataFrame, keys: list[str], sequence: str, kind: str = "op") -> DataFrame:
    """The state that a change log leaves: the last write of each key, without deleted keys ('D')."""
    return _last(changes, keys, sequence).where(~F.col(kind).eqNullSafe("D"))


def apply_stream(changes: DataFrame, path: str, checkpoint: str, keys: list[str], sequence: str):
    """A stream of changes folded into versions of a table, ``path``/v=batch; each batch reads the version before.

    Deleted keys stay as their last change, so that an older change that comes late
    doesn't bring them back; ``apply_changes`` over a version drops them.
    """

    def fold(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own version again
        old = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v={number - 1}") if number else None
        _last(batch if old is None else old.unionByName(batch), keys, sequence).write.mode("overwrite").parquet(f"{path}/v={number}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; with a watermark for a stream."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, length, slide).alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
