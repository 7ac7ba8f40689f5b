"""Variable-capacity best-fit packing of token sequences.

Every text is cut into pieces of at most the largest permitted length.  Pieces are packed in
decreasing length: a piece goes into the open bin with the least room that takes it; if there is
none, a new bin of the permitted size with the least cost per token that it can still come to
hold is opened.  At the end each bin is cut down to the least permitted size for its contents.

The packing depends on lengths alone, so only the number of pieces per length (at most the
largest size) is brought together.  Bins with the same contents so far are one run of bin
numbers, and placing all pieces of one length moves whole runs; the plan therefore has a bounded
number of entries whatever the number of texts.  Texts then look up their bin by length and rank
among the pieces of that length, where ranks come from counts per salted length.

Defined results: NULL or empty text: one end token, like every other text's last token.
Repeated rows are packed each; which of two pieces of one length goes where is open.  Empty
table: no rows.  Columns beside key and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.common import ship, spread_parts
from verdara.llm.vocab import BYTE_RANKS, ByteCounter, file_bytes, once
from verdara.sources.scratch import stored

SIZES = (512, 1024, 2048, 4096, 8192)
ROWS_PER_SALT = 10_000


def sequence_cost(size: int) -> float:
    """Work of one padded sequence: linear part, attention part, fixed part."""
    return size + size * size / 16384 + 64


def plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES,
         cost: Callable[[int], float] = sequence_cost) -> tuple[list[tuple], list[tuple]]:
    """Pack ``counts[length]`` pieces of every length.

    Returns placements (length, first rank, bins, pieces per bin, first bin, offset in the bin)
    and runs of bins (first bin, bins, tokens in each, final size).
    """
    sizes = tuple(sorted(sizes))
    lengths = sorted((n for n, c in counts.items() if c > 0), reverse=True)
    short = sorted(lengths)
    tokens = np.cumsum([0] + [n * counts[n] for n in short])
    rooms: list[int] = []  # rooms of open runs, ascending
    runs: dict[int, list[tuple[int, int, int]]] = {}  # room → (first bin, bins, filled)
    placed, done, n_bins = [], [], 0

    def keep(room: int, first: int, bins: int, filled: int) -> None:
        if room < short[0]:
            done.append((first, bins, filled))
            return
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((first, bins, filled))

    for n in lengths:
        left, rank = counts[n], 0
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                break
            room = rooms[at]
            first, bins, filled = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            # least room first: a bin is filled with this length as far as it goes
            each = min(room // n, left)
            used = min(bins, left // each)
            placed.append((n, rank, used, each, first, filled))
            keep(room - each * n, first, used, filled + each * n)
            if used < bins:
                keep(room, first + used, bins - used, filled)
            rank, left = rank + used * each, left - used * each
        while left:
            # what the bin can come to hold: pieces of this length and all shorter ones that fit
            def per_token(size: int) -> float:
                own = min(size // n, left) * n
                rest = size - own
                fits = tokens[bisect_left(short, min(rest + 1, n))]
                return cost(size) / (own + min(rest, int(fits)))

            size = min((s for s in sizes if s >= n), key=lambda s: (per_token(s), s))
            each = min(size // n, left)
            used = left // each
            placed.append((n, rank, used, each, n_bins, 0))
            keep(size - each * n, n_bins, used, each * n)
            n_bins, rank, left = n_bins + used, rank + used * each, left - used * each
    for own in runs.values():
        done.extend(own)
    return placed, [(f, b, filled, next(s for s in sizes if s >= filled))
                    for f, b, filled in sorted(done)]


def token_lengths(docs: DataFrame, text: str = "text", ranks_path: str | None = None):
    """Column: tokens of the whole text and one end token."""
    ship(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(ranks_path, BYTE_RANKS))

    @pandas_udf("long")
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = once(ByteCounter, data)
        for texts in batches:
            yield pd.Series([counter.count(t or "") + 1 for t in texts], dtype="int64")

    return fn(F.col(f"`{text}`"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text",
         sizes: tuple[int, ...] = SIZES, ranks_path: str | None = None,
         cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """(key, n_tokens, piece, start, length, bin, slot_start, bin_tokens, bin_size), one row per
    piece: tokens [start, start + length) of the text lie at slot_start of the bin."""
    spark = docs.sparkSession
    most = max(sizes)
    texts = stored(docs.select(F.col(f"`{key}`").alias("_key"),
                               token_lengths(docs, text, ranks_path).alias("n_tokens")))
    last = F.ceil(F.col("n_tokens") / most).cast("long") - 1
    pieces = (texts.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))
              .select("_key", "n_tokens", "_row", F.explode(F.sequence(F.lit(0).cast("long"), last))
                      .alias("piece"))
              .withColumn("length", F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most)
                          .cast("int")))
    salts = spread_parts(spark, texts.count(), ROWS_PER_SALT)
    # the salt comes from the row, so copies of one length are spread
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.lit(salts)))
    by_salt = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in  # at most the largest size
              by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placed, runs = plan(counts, sizes, cost) if counts else ([], [])
    before = (Window.partitionBy("length").orderBy("_salt")
              .rowsBetween(Window.unboundedPreceding, -1))
    first = by_salt.select("length", "_salt",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_salt").orderBy("_row", "piece")
    ranked = (pieces.withColumn("_i", F.row_number().over(inside) - 1)
              .join(first, ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_i")))
    ship(spark)
    found = spark.sparkContext.broadcast((
        np.array(sorted(placed), np.int64).reshape(-1, 6), np.array(runs, np.int64).reshape(-1, 4)))

    @pandas_udf("bin long, slot_start int, bin_tokens int, bin_size int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, r = found.value
        at = np.searchsorted(p[:, 0] << 44 | p[:, 1], length.to_numpy(np.int64) << 44
                             | rank.to_numpy(np.int64), side="right") - 1
        n, start, _, each, first_bin, offset = p[at].T
        into, within = np.divmod(rank.to_numpy() - start, each)
        own = first_bin + into
        run = r[np.searchsorted(r[:, 0], own, side="right") - 1]
        return pd.DataFrame({"bin": own, "slot_start": offset + within * n,
                             "bin_tokens": run[:, 2], "bin_size": run[:, 3]})

    return (ranked.withColumn("_at", place("length", "_rank"))
            .select(F.col("_key").alias(key), "n_tokens", F.col("piece").cast("int").alias("piece"),
                    (F.col("piece") * most).alias("start"), "length",
                    *[F.col(f"_at.{c}").alias(c)
                      for c in ("bin", "slot_start", "bin_tokens", "bin_size")]))
