"""Grouped descriptive statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.functions.dates import month_start
from verdara.operators.ordered import ROWS_PER_BUCKET, group_quantiles, melt
from verdara.operators.spread import attach_groups, null_safe


def describe_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(keys, var, count, mean, std, min, q25, q50, q75, max); std with n−1.

    The moments come from one map-side combined aggregation; the quartiles are
    exact and come from bucketed value counts.  NULL is a group like any other, NaN is missing.
    """
    group = [*keys, "var"]
    rows = melt(df, keys, cols)
    moments = (rows.groupBy(*group).agg(
        F.count("val").alias("count"), F.avg("val").alias("mean"),
        F.stddev_samp("val").alias("std"),
        F.min("val").alias("min"), F.max("val").alias("max")))
    quarts = (group_quantiles(df, keys, cols, (0.25, 0.5, 0.75), rows_per_bucket)
              .withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"}))
    side, same = null_safe(moments, quarts, group)
    return (moments.join(side, same, "left")
            .select(*group, "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def box_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Box-plot numbers: quartiles, last points inside 1.5·IQR, outlier count."""
    group = [*keys, "var"]
    quarts = group_quantiles(df, keys, cols, (0.25, 0.5, 0.75), rows_per_bucket)
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    fences = quarts.withColumns({"_lo": F.col("q0") - reach, "_hi": F.col("q2") + reach})
    inside = F.col("val").between(F.col("_lo"), F.col("_hi"))
    rows = melt(df, keys, cols).where("val IS NOT NULL")
    return (attach_groups(rows, fences, group, how="inner")
            .groupBy(*group).agg(
                F.first("q0").alias("q25"), F.first("q1").alias("q50"),
                F.first("q2").alias("q75"),
                F.min(F.when(inside, F.col("val"))).alias("whisker_low"),
                F.max(F.when(inside, F.col("val"))).alias("whisker_high"),
                F.count_if(~inside).alias("n_outliers")))


#: Cumulative probabilities of the Poisson distribution of mean 1; more is drawn once in 1e9 times.
POISSON_STEPS = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def monthly_mean(df: DataFrame, date_col: str, col: str,
                 keys: Sequence[str] = ()) -> DataFrame:
    """(month, keys, n, mean, se): monthly mean and its standard error s/√n."""
    return (df.groupBy(month_start(F.col(date_col)).alias("month"), *keys)
            .agg(F.count(col).alias("n"), F.avg(col).alias("mean"),
                 (F.stddev_samp(col) / F.sqrt(F.nullif(F.count(col), F.lit(0)))).alias("se")))


def bootstrap_band(df: DataFrame, date_col: str, col: str, row_key: Sequence[str],
                   keys: Sequence[str] = (), resamples: int = 200, level: float = 0.95,
                   seed: int = 42) -> DataFrame:
    """(month, keys, n, mean, low, high): monthly mean with its bootstrap interval.

    Drawing n of n rows with replacement gives each row about a Poisson(1) number of places, so
    every row draws its own number for each resample from a hash of ``row_key``, the resample and
    the seed.  A resample is one weighted mean: all of them come from one grouped aggregation with
    map-side combine, and the result does not depend on how rows are spread.
    """
    if resamples % 4 or resamples <= 0:
        raise ValueError("resamples must be a multiple of 4: one hash serves four of them")
    month = month_start(F.col(date_col)).alias("month")
    rows = df.where(F.col(col).isNotNull()).select(month, *keys, F.col(col).cast("double").alias("_x"), *[
        F.col(k).alias(f"_k{i}") for i, k in enumerate(row_key)])
    hashed = rows.select("month", *keys, "_x", F.explode(F.sequence(F.lit(0), F.lit(resamples // 4 - 1))).alias("_j"),
                         *[f"_k{i}" for i in range(len(row_key))])
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"_k{i}").cast("string") for i in range(len(row_key))],
                               F.col("_j").cast("string")))
    hashed = hashed.withColumn("_h", digest)

    def drawn(i: int):
        u = F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
        return sum(((u >= F.lit(t)).cast("double") for t in POISSON_STEPS), F.lit(0.0))

    # four weighted sums to a group keep the rows of a resample from being written out
    sums = hashed.groupBy("month", *keys, "_j").agg(*[a for i in range(4) for a in (
        F.sum(drawn(i) * F.col("_x")).alias(f"_s{i}"), F.sum(drawn(i)).alias(f"_w{i}"))])
    means = sums.select("month", *keys, F.explode(F.array(*[
        F.try_divide(f"_s{i}", f"_w{i}") for i in range(4)])).alias("_m"))
    tail = (1 - level) / 2
    band = means.groupBy("month", *keys).agg(
        F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"))
    mean = rows.groupBy("month", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"))
    side, same = null_safe(mean, band, ["month", *keys])
    return mean.join(side, same).select("month", *keys, "n", "mean", "low", "high")


def scatter_pairs(df: DataFrame, id_cols: Sequence[str], veg_cols: Sequence[str],
                  sar_cols: Sequence[str]) -> DataFrame:
    """(ids, veg, sar, x, y): one row per record, target and radar variable."""
    veg = melt(df, [*id_cols, *sar_cols], veg_cols, "veg", "y")
    return melt(veg, [*id_cols, "veg", "y"], sar_cols, "sar", "x")
