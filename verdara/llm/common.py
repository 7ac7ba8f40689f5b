"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of white space between words; the words are what lies between.
BLANKS = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source files to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='verdara-ship-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, empty for NULL."""
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def spread_parts(spark: SparkSession, rows: int, target: int) -> int:
    """Parts of about ``target`` rows, but as many as the session shuffles into at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // target), 1)


def with_fields(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """Add the fields of one struct; a column of the same name is replaced."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    return (df.select(*rest, struct.alias("_made"))
            .select(*rest, *[F.col(f"_made.{f}").alias(f) for f in fields]))
