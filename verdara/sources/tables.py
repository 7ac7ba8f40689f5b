"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _read(df: DataFrame, position: str | None) -> DataFrame:
    """Names without blanks around them, NaN as NULL, and the place of each row if wanted."""
    names = [c.strip() for c in df.columns]
    if position is None:
        return nan_to_null(df.toDF(*names))
    place = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return nan_to_null(df.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(position))
                       .toDF(*names, position))


def read_csv(spark: SparkSession, path: str | Sequence[str],
             schema: T.StructType | str | None = None, position: str | None = None) -> DataFrame:
    """CSV with a header; blanks around header names are cut, empty and NaN cells are NULL.

    Without a schema the types are inferred, which reads the files twice; large
    inputs should come with a schema.  ``position`` names a column that orders the rows as they
    stand in the files, by path, block and row.
    """
    reader = spark.read.option("header", True).option("nullValue", "")
    if schema is None:
        return _read(reader.option("inferSchema", True).csv(path), position)
    return _read(reader.schema(schema).csv(path), position)


def read_parquet(spark: SparkSession, path: str | Sequence[str],
                 position: str | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return _read(spark.read.parquet(*paths), position)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL everywhere; NaN of other tools is turned into it."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`"))
                           for c in floats})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_lines(df: DataFrame, col: str, path: str) -> None:
    """One text line per row."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_best_bandwidth(best: DataFrame, path: str) -> None:
    write_lines(best.select(F.concat(F.lit("best_h="), F.col("h").cast("string")).alias("line")),
                "line", path)


def write_prediction(pred: DataFrame, path: str, nodata: float = -9999.0) -> int:
    """Write (raster, row, col, pred) by raster; returns the number of predicted pixels.

    The count is observed while the rows are written aside.  No predicted pixel at all is
    an error, as masking then left nothing to predict on; a table already at ``path`` then
    stays as it is.
    """
    seen = Observation("prediction")
    watched = pred.observe(seen, F.count_if(F.col("pred") != F.lit(nodata)).alias("n"))
    aside = f"{path.rstrip('/')}.new"
    write_parquet(watched, aside, ["raster"])
    jvm = pred.sparkSession.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    files = new.getFileSystem(pred.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if not seen.get["n"]:
        files.delete(new, True)
        raise ValueError("no valid pixel after masking")
    files.delete(old, True)
    files.rename(new, old)
    return seen.get["n"]


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixel table stored by raster, clustered so that a pixel's bands lie together."""
    (pixels.repartition("raster", F.floor(F.col("row") / 256), F.floor(F.col("col") / 256))
     .sortWithinPartitions("raster", "row", "col", "band")
     .write.mode("overwrite").partitionBy("raster").parquet(path))
