"""Hold a table that a fit reads several times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Persist for the duration of a fit.

    The lineage stays, so blocks of a lost executor are computed again; select the
    needed columns first, because only those are stored.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
