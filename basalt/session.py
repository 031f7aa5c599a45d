"""A session with the settings that the operators expect; every setting can be overridden."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# ANSI casts raise on bad input, TIME is a type, times are UTC, joins and partitions are re-planned at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables that the session names in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder; on a
    cluster that is an error, as executors wouldn't see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpoint_folder(spark: SparkSession) -> str:
    """Makes the shared folder the one that checkpoint() writes to."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        context.setCheckpointDir(scratch_folder(spark))
    return context._jsc.sc().getCheckpointDir().get()
