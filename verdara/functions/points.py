"""Point ids and cover classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cover class by the first letter of the point id.
COVER_LABELS = {"G": "Grass", "Y": "Young crop", "O": "Old crop"}
COVER_LABELS_TREES = {"Y": "Young crop", "O": "Mature crop"}


def normal_id(point: Column) -> Column:
    """Ids compare without surrounding blanks and in upper case."""
    return F.upper(F.trim(point.cast("string")))


def cover_type(point: Column, labels: Mapping[str, str] = COVER_LABELS) -> Column:
    rule = reduce(
        lambda acc, kv: acc.when(point.startswith(kv[0]), F.lit(kv[1])),
        labels.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    return rule.otherwise(F.lit("Unknown"))


def has_prefix(point: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [point.startswith(p) for p in prefixes], F.lit(False))
