"""Near-duplicates by SimHash with a hierarchical index in Gray order.

Fingerprints of all documents are made equal classes first.  Two fingerprints with at most
``distance`` differing bits agree on at least ``blocks - distance`` of ``blocks`` bit blocks, so
every class is sent to one bucket per such choice of blocks.  More blocks mean longer keys and
smaller buckets; the number follows from the number of classes and does not change the result.
Buckets over TILE classes are split into tiles by hash, and each pair of tiles is a unit of work,
so no task gets an unbounded bucket.

Within its buckets a task sorts the fingerprints by Gray rank, where neighbours differ in few
bits, and builds the index bottom up: a node stands for FAN neighbours and holds the bit pattern
they share; bits already shared by its parent are factored out.  A query goes down from the root
of its bucket, adds the differing bits of each node's own pattern to those found above, and
leaves the whole group out once the sum exceeds ``distance``.  A leaf's sum is the exact distance.
All queries of a task go down side by side.

Links are handed on as one star per local component, so a dense bucket gives no more rows than
it has members; components over all buckets follow from star contraction.

Defined results: NULL or empty text, or no words: fingerprint zero, linked like any other.
NULL keys: never the least key; a component of NULL keys only has component NULL.  Repeated rows
stay repeated.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from xxhash import xxh64_intdigest

from verdara.llm.common import ship
from verdara.llm.components import components
from verdara.operators.spread import join_lookup
from verdara.sources.scratch import stored

BITS = 64
FAN = 8
TILE = 2000
BUCKET = 5000
_ROWS = 40_000
_PAIRS = 2_000_000


# --- fingerprints ---

def text_print(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed)
                  for a, b in zip(starts, ends[width - 1:].tolist())]
    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 100_000):
        ones += np.unpackbits(raw[at:at + 100_000], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> Column:
    ship(docs.sparkSession)

    @pandas_udf("long")
    def fn(texts: pd.Series) -> pd.Series:
        return pd.Series([text_print(t, width) for t in texts], dtype="int64")

    return fn(F.col(f"`{text}`"))


# --- index in Gray order ---

def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = prints.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def _index(bucket: np.ndarray, prints: np.ndarray) -> list[tuple]:
    """Levels from leaves to roots: (bucket, shared bits, pattern, first and last child)."""
    n = np.arange(len(prints))
    levels = [(bucket, np.full(len(prints), ~np.uint64(0)), prints, n, n + 1)]
    while True:
        own, shared, pattern, _, _ = levels[-1]
        begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        if len(begins) == len(own):
            return levels
        place = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
        first = np.flatnonzero(place % FAN == 0)
        last = np.append(first[1:], len(own))
        common = (np.bitwise_and.reduceat(shared, first)
                  & ~(np.bitwise_or.reduceat(pattern, first)
                      ^ np.bitwise_and.reduceat(pattern, first)))
        levels.append((own[first], common, pattern[first], first, last))


def near_pairs(bucket: np.ndarray, prints: np.ndarray, distance: int) -> tuple:
    """Index pairs i < j of one bucket with at most ``distance`` differing bits.

    ``bucket`` is ascending; within a bucket ``prints`` are in Gray order.
    """
    levels = _index(bucket, prints)
    root_of = np.searchsorted(levels[-1][0], bucket)
    # subtree ends, to leave out what lies wholly before the query
    end = [np.arange(1, len(prints) + 1)]
    for _, _, _, _, last in levels[1:]:
        end.append(end[-1][last - 1])
    size = np.diff(np.append(np.flatnonzero(np.concatenate(
        ([True], bucket[1:] != bucket[:-1]))), len(bucket)))
    work = np.cumsum(np.repeat(size, size))
    left, right = [], []
    start = 0
    while start < len(prints):
        base = work[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(work, base + _PAIRS, side="right")))
        query = np.arange(start, min(stop, len(prints)))
        node, sums = root_of[query], np.zeros(len(query), np.int64)
        seen = np.zeros(len(query), np.uint64)
        for level in range(len(levels) - 1, -1, -1):
            _, shared, pattern, first, last = levels[level]
            new = shared[node] & ~seen
            sums = sums + np.bitwise_count((prints[query] ^ pattern[node]) & new)
            keep = (sums <= distance) & (end[level][node] > query + 1)
            query, node, sums = query[keep], node[keep], sums[keep]
            seen = shared[node]
            if level:
                count = last[node] - first[node]
                at = np.repeat(first[node], count) + _steps(count)
                query, sums, seen = (np.repeat(query, count), np.repeat(sums, count),
                                     np.repeat(seen, count))
                node = at
        left.append(query)
        right.append(node)
        start = stop
    return np.concatenate(left or [[]]).astype(int), np.concatenate(right or [[]]).astype(int)


def _steps(count: np.ndarray) -> np.ndarray:
    """0..c-1 for each c."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each element's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _link(distance: int):
    def stars(part: pd.DataFrame) -> pd.DataFrame:
        """Star edges of all whole buckets in ``part``."""
        prints = part["print"].to_numpy(np.int64).view(np.uint64)
        key = part["_bucket"].to_numpy(np.int64)
        order = np.lexsort((gray_rank(prints), key))
        key, prints = key[order], prints[order]
        left, right = near_pairs(key, prints, distance)
        root = local_roots(len(prints), left, right)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": prints[own].view(np.int64), "b": prints[root[own]].view(np.int64)})

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < _ROWS:
                continue
            part = pd.concat(held, ignore_index=True)
            open_ = part["_bucket"] == part["_bucket"].iloc[-1]  # may go on in the next batch
            yield stars(part[~open_])
            held, rows = [part[open_]], int(open_.sum())
        if rows:
            yield stars(pd.concat(held, ignore_index=True))

    return fn


def _buckets(classes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(print, _bucket): every class once per choice of blocks that may agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(n), F.col("print").bitwiseAND(F.lit(signed))))
    return classes.select("print", F.explode(F.array(*keys)).alias("_bucket"))


def links(classes: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b) of fingerprints whose components are those of all pairs within ``distance``.

    ``classes`` has distinct fingerprints in column print.
    """
    if blocks is None:
        n, blocks = classes.count(), distance + 1
        while blocks < 2 * distance + 2 and n >> (BITS * (blocks - distance) // blocks) > BUCKET:
            blocks += 1
    keyed = _buckets(classes, distance, blocks)
    large = (keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
             .select("_bucket", F.ceil(F.col("n") / TILE).cast("int").alias("_tiles")))
    # tile t of k meets each tile once: units are unordered pairs of tiles
    tile = F.pmod(F.xxhash64("print"), F.col("_tiles")).cast("int")
    units = F.when(F.col("_tiles").isNull(), F.array(F.col("_bucket"))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("_tiles") - 1),
        lambda j: F.xxhash64("_bucket", F.least(tile, j), F.greatest(tile, j))))
    work = (keyed.join(large, "_bucket", "left")
            .select("print", F.explode(units).alias("_bucket"))
            .repartition("_bucket").sortWithinPartitions("_bucket"))
    return work.mapInPandas(_link(distance), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
                    distance: int = 3) -> DataFrame:
    """(key, print, component): fingerprint and least key of the document's component."""
    ship(docs.sparkSession)
    prints = stored(docs.select(F.col(f"`{key}`").alias("_key"),
                                fingerprint(docs, text, width).alias("print")))
    classes = stored(prints.groupBy("print").agg(F.min("_key").alias("_least")))
    members = components(links(classes, distance)).withColumnRenamed("node", "print")
    of = classes.join(members, "print", "left").select(
        "print", "_least", F.coalesce("component", "print").alias("_root"))
    least = of.groupBy("_root").agg(F.min("_least").alias("component"))
    # a component may hold most classes, a class most documents: both keys are counted and salted
    table = join_lookup(of, least, ["_root"], "inner").select("print", "component")
    return (join_lookup(prints, table, ["print"], "inner")
            .select(F.col("_key").alias(key), "print", "component"))
