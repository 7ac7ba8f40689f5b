"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.sources.scratch import stored

# A key with more rows than one task takes is hot and gets ceil(rows / this) salts.
ROWS_PER_TASK = 1_000_000
# Up to so many hot keys are broadcast; a longer list is joined like any table.
FEW_KEYS = 100_000


def hot_keys(rows: DataFrame, keys: Sequence[str], floor: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, _salts) of the keys with more than ``floor`` rows, whatever their share."""
    found = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > floor)
                   .select(*keys, F.ceil(F.col("_n") / floor).cast("int").alias("_salts")))
    return F.broadcast(found) if found.count() <= FEW_KEYS else found


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with renamed keys and the condition that NULL keys meet too."""
    names = {k: f"_g_{k}" for k in keys}
    side = right.withColumnsRenamed(names)
    return side, reduce(lambda a, b: a & b,
                        [left[k].eqNullSafe(side[v]) for k, v in names.items()], F.lit(True))


def _with_salts(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    side, same = null_safe(rows, hot, keys)
    return (rows.join(side, same, "left").drop(*[f"_g_{k}" for k in keys])
            .withColumn("_salts", F.coalesce("_salts", F.lit(1))))


def salt_rows(rows: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: spread over the salts of a hot key, 0 for all others.

    The partition index is stable when a task is retried, and it spreads whole copies
    of a row, which no hash of the row's own values can.
    """
    spread_on = [F.spark_partition_id(), *rows.columns]
    return (_with_salts(rows, hot, keys)
            .withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.col("_salts")).cast("int"))
            .drop("_salts"))


def salt_lookup(rows: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: rows of hot keys once per salt, all others once with salt 0."""
    return (_with_salts(rows, hot, keys)
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
            .drop("_salts"))


def join_lookup(left: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                floor: int = ROWS_PER_TASK) -> DataFrame:
    """Join rows to a table that is unique by ``keys``.

    Hot keys are found by a counted pre-aggregation; only their rows are salted,
    and only their lookup rows (one per key) are repeated per salt.  All other
    keys take part once, with salt 0.
    """
    if how not in ("left", "inner"):
        raise ValueError("join_lookup keeps left rows: how must be 'left' or 'inner'")
    keys = list(keys)
    hot = hot_keys(left.select(*keys), keys, floor)
    return (salt_rows(left, keys, hot)
            .join(salt_lookup(lookup, keys, hot), keys + ["_salt"], how).drop("_salt"))


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str],
                  how: str = "left") -> DataFrame:
    """Join rows to one row per group, such as fences or extremes; NULL is a group.

    The group table is written once, so Spark knows its size: it broadcasts a small one and
    splits hot groups at run time when it shuffles for a large one.
    """
    side, same = null_safe(rows, stored(groups), keys)
    return rows.join(side, same, how).drop(*[f"_g_{k}" for k in keys])
