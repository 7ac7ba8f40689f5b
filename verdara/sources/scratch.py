"""Folders for tables that a job writes once and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[tempfile.TemporaryDirectory] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    This is ``spark.checkpoint.dir``.  Only a session whose tasks run inside the driver
    (``local`` or ``local[n]``) may leave it unset; it then gets one temporary folder, which
    goes with the process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="verdara-"))
    return _own[0].name


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/verdara-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table written as Parquet and read back: cuts the lineage, survives lost executors."""
    path = path or scratch_dir(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Frees the room of a table that ``stored`` wrote to the path and nobody reads any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like ``stored``, in buckets by the column: grouping by it needs no shuffle.

    The catalog's entry is dropped at once; the table is external, so its files stay.
    """
    spark, name = df.sparkSession, f"spark_catalog.default.verdara_{uuid.uuid4().hex}"
    path = scratch_dir(spark) + "/table"
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when the action ends, not when the driver happens to
    collect its garbage.  The session's setting is put back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
