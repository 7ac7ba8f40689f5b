"""Exact order statistics without sorting a group in one task.

Values are cut into range buckets of bounded size and equal values are collapsed to
(value, count), so each running count covers one bucket; the bucket totals (one row
per bucket) carry the offsets between buckets.  Quantiles look only into the buckets
that hold a wanted position, so a large table is scanned but never shuffled whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.operators.spread import attach_groups, null_safe
from verdara.sources.scratch import stored

ROWS_PER_BUCKET = 2_000_000
# So many quantiles are taken; each interval between them is cut evenly as often as needed.
LEVEL = 1024


def number(col: str) -> Column:
    """The column as a double, NaN as NULL."""
    return F.nanvl(F.col(f"`{col}`").cast("double"), F.lit(None).cast("double"))


def melt(df: DataFrame, keys: Sequence[str], cols: Sequence[str], var: str = "var",
         val: str = "val") -> DataFrame:
    """(keys, var, val) rows of the listed numeric columns, as doubles; NaN becomes NULL."""
    pairs = [x for c in cols for x in (F.lit(c), number(c))]
    return df.select(*keys, F.stack(F.lit(len(cols)), *pairs).alias(var, val))


def value_counts(rows: DataFrame, keys: Sequence[str], val: str = "val") -> DataFrame:
    """(keys, val, n) of the non-missing values."""
    return (rows.where(F.col(val).isNotNull() & ~F.isnan(val))
            .groupBy(*keys, val).agg(F.count(F.lit(1)).alias("n")))


@dataclass(frozen=True)
class Edges:
    """Cuts of a value range: strictly increasing quantiles and even steps between them."""

    cuts: tuple[float, ...] = ()
    steps: int = 1

    def cut(self, rows: DataFrame, val: str = "val") -> DataFrame:
        """Add ``_b``, the number of the range bucket; ascending with the value."""
        if not self.cuts:
            return rows.withColumn("_b", F.lit(0).cast("long"))
        cutter = Bucketizer(splits=[float("-inf"), *self.cuts, float("inf")],
                            inputCol=val, outputCol="_b", handleInvalid="keep")
        at = F.col("_b").cast("long")
        if self.steps > 1:
            ends = F.array(*[F.lit(c) for c in self.cuts])
            low, high = F.get(ends, (at - 1).cast("int")), F.get(ends, at.cast("int"))
            inner = F.floor((F.col(val) - low) / (high - low) * self.steps)
            at = at * self.steps + F.coalesce(
                F.greatest(F.lit(0), F.least(F.lit(self.steps - 1), inner)), F.lit(0))
        return cutter.transform(rows).withColumn("_b", at)


def bucket_edges(rows: DataFrame, n: int, val: str = "val",
                 rows_per_bucket: int = ROWS_PER_BUCKET, level: int = LEVEL) -> Edges:
    """Edges that cut ``n`` rows (an upper bound is enough) into buckets of about equal size.

    The edges only balance the work; results do not depend on them.
    """
    buckets = max(1, -(-n // rows_per_bucket))
    if buckets == 1:
        return Edges()
    ok = rows.where(F.col(val).isNotNull() & ~F.isnan(val))
    taken = min(buckets, level)
    at = [i / taken for i in range(1, taken)] or [0.5]
    cuts = ok.agg(F.percentile_approx(val, at, max(1000, 8 * taken))).first()[0] or []
    return Edges(tuple(sorted({float(e) for e in cuts})), -(-buckets // taken))


def with_running_count(counts: DataFrame, keys: Sequence[str], edges: Edges,
                       val: str = "val") -> DataFrame:
    """Add ``upto`` (rows of the group with value ≤ this one) and ``total``."""
    keys = list(keys)
    cut = edges.cut(counts, val)
    per_bucket = cut.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *keys, "_b",
        (F.sum("_bn").over(group.orderBy("_b")) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(group).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(val)
    side, same = null_safe(cut, offsets, [*keys, "_b"])
    return (cut.join(side, same)
            .withColumn("upto", F.col("_before") + F.sum("n").over(inside))
            .drop("_b", "_before", *[f"_g_{k}" for k in [*keys, "_b"]]))


def average_ranks(rows: DataFrame, keys: Sequence[str], n: int, val: str = "val",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(keys, val, n, total, rank): ranks from 1, ties share their average rank."""
    edges = bucket_edges(rows, n, val, rows_per_bucket)
    return (with_running_count(value_counts(rows, keys, val), keys, edges, val)
            .withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)
            .drop("upto"))


def group_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    probs: Sequence[float], rows_per_bucket: int = ROWS_PER_BUCKET,
                    n: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: (keys, var, q0, q1, …) per column.

    ``n`` is the row count of ``df`` if the caller knows it.  A group without values in a
    column has no row for it.
    """
    keys = list(keys)
    bound = (df.count() if n is None else n) * len(cols)
    group = [*keys, "var"]
    rows = melt(df, keys, cols).where(F.col("val").isNotNull() & ~F.isnan("val"))
    # finer buckets than a window needs: most of them are never looked into
    cut = bucket_edges(rows, bound, "val", max(1, rows_per_bucket // 8)).cut(rows)
    size = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    within = Window.partitionBy(*group)
    spots = [f(F.lit(float(p)) * (F.col("_total") - 1)) for p in probs for f in (F.floor, F.ceil)]
    wanted = (size.withColumns({
        "_before": F.sum("_bn").over(within.orderBy("_b")) - F.col("_bn"),
        "_total": F.sum("_bn").over(within)})
        .where(reduce(lambda x, y: x | y, [
            (F.col("_before") <= r) & (r < F.col("_before") + F.col("_bn")) for r in spots]))
        .drop("_bn"))
    # only the buckets that hold a wanted position are counted value by value
    held = (attach_groups(cut, wanted, [*group, "_b"], how="inner")
            .groupBy(*group, "_b", "val", "_before", "_total").agg(F.count(F.lit(1)).alias("n")))
    last = F.col("_before") + F.sum("n").over(Window.partitionBy(*group, "_b").orderBy("val"))
    picks = [F.max(F.when((F.col("_upto") - F.col("n") <= r) & (r < F.col("_upto")), F.col("val")))
             .alias(f"_r{i}") for i, r in enumerate(spots)]
    found = held.withColumn("_upto", last).groupBy(*group, "_total").agg(*picks)
    out = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(f"q{i}"))
    return found.select(*group, *out)


def medians(df: DataFrame, cols: Sequence[str], n: int | None = None) -> dict[str, float | None]:
    """Exact median per column, as driver scalars; None for a column without values."""
    found = {r["var"]: r["q0"] for r in group_quantiles(df, [], cols, [0.5], n=n).collect()}
    return {c: found.get(c) for c in cols}


def values_at_ranks(df: DataFrame, col: str, ranks: Sequence[int],
                    rows_per_part: int = ROWS_PER_BUCKET) -> list:
    """Values at the given 1-based positions of ``col`` in ascending order, of any type.

    Rows are dealt into ranges of bounded size; counts per range name the ranges that hold a
    wanted position, and only those are numbered.
    """
    if not ranks:
        return []
    values = df.select(F.col(f"`{col}`").alias("v")).where("v IS NOT NULL")
    parts = max(1, -(-values.count() // rows_per_part))
    placed = stored(values.repartitionByRange(parts, "v")
                    .select("v", F.spark_partition_id().alias("_p")))
    wanted, before = [], 0
    for r in placed.groupBy("_p").count().orderBy("_p").collect():
        wanted += [(r["_p"], k - before) for k in ranks if before < k <= before + r["count"]]
        before += r["count"]
    here = reduce(lambda x, y: x | y, [
        (F.col("_p") == p) & (F.col("_i") == i) for p, i in wanted], F.lit(False))
    inside = Window.partitionBy("_p").orderBy("v")
    found = (placed.where(F.col("_p").isin([p for p, _ in wanted]))
             .withColumn("_i", F.row_number().over(inside)).where(here).collect())
    at = {(r["_p"], r["_i"]): r["v"] for r in found}
    return [at[w] for w in wanted]
