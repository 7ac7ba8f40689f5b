"""Shards by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: no ring table, and
appending a shard moves only the rows that go into the new one.  Slots number the rows of a shard
from 0 without gaps: rows are dealt into hash buckets of bounded size, bucket counts give each
bucket its first slot, and each bucket numbers its own rows.

Defined results: NULL key: one key of its own.  NULL text: no bytes, size 1, CRC 0.  Repeated
rows share a shard and get slots of their own; which of them gets which slot is open.  Empty
table: no rows.  Columns beside key and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.common import ship, spread_parts
from verdara.sources.scratch import stored

ROWS_PER_BUCKET = 10_000
_STEP = np.uint64(2862933555777941757)  # multiplier of the published method


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key."""
    key = keys.astype(np.uint64)
    found = np.zeros(len(key), np.int64)
    following = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        found[going] = following[going]
        k = key[going] * _STEP + np.uint64(1)  # modulo 2^64
        key[going] = k
        draw = ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following[going] = ((found[going] + 1) * (2.0 ** 31 / draw)).astype(np.int64)
        going = going[following[going] < shards]
    return found


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    ship(spark)

    @pandas_udf("shard int, grown int")
    def place(keys: pd.Series) -> pd.DataFrame:
        values = keys.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump(values, shards), "grown": jump(values, shards + 1)})

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = stored(docs.select(
        F.col(f"`{key}`").alias("_key"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("crc"), place(F.xxhash64(F.col(f"`{key}`"))).alias("at")))
    buckets = spread_parts(spark, rows.count(), ROWS_PER_BUCKET)
    # place in the written file: tells repeated rows apart and is the same in every attempt
    own = rows.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))
    own = own.select("*", F.col("at.shard").alias("shard"), F.pmod("_row", F.lit(buckets)).alias("_b"))
    counts = own.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_b").orderBy("_row", "_key")
    return (own.withColumn("_i", F.row_number().over(inside) - 1).join(first, ["shard", "_b"])
            .select(F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"),
                    F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).alias("slot"),
                    F.col("at.grown").alias("grown_shard")))
