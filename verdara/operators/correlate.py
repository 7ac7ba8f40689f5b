"""Pearson and Spearman correlations in long form (target, feature, r)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.operators.ordered import ROWS_PER_BUCKET, average_ranks


def _pearson(x: Column, y: Column, nulls: str) -> Column:
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    # corr() raises on a constant column, so the ratio is built with try_divide
    r = F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
    if nulls == "propagate":
        r = F.when(F.count_if(~both) == 0, r)
    return r


def _long(agg: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    cells = [x for i, (t, f) in enumerate(pairs)
             for x in (F.lit(t), F.lit(f), F.col(f"r{i}"))]
    return agg.select(F.stack(F.lit(len(pairs)), *cells).alias("target", "feature", "r"))


def _check(nulls: str) -> None:
    if nulls not in ("skip", "propagate"):
        raise ValueError("nulls must be 'skip' or 'propagate'")


def pearson(df: DataFrame, targets: Sequence[str], features: Sequence[str],
            nulls: str = "skip") -> DataFrame:
    """All pairs in one aggregation over one scan."""
    _check(nulls)
    pairs = [(t, f) for t in targets for f in features]
    num = df.select(*[F.col(c).cast("double").alias(c)
                      for c in dict.fromkeys([*targets, *features])])
    return _long(num.agg(*[_pearson(F.col(t), F.col(f), nulls).alias(f"r{i}")
                           for i, (t, f) in enumerate(pairs)]), pairs)


def spearman(df: DataFrame, targets: Sequence[str], features: Sequence[str],
             nulls: str = "skip", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pearson on average ranks.

    Equal values are ranked once and joined back per column.  Columns without missing values share one rank per column; a
    pair with missing values is ranked on its complete rows.
    """
    _check(nulls)
    names = list(dict.fromkeys([*targets, *features]))
    num = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names])
    gaps = num.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in names]).first().asDict()
    pairs = [(t, f) for t in targets for f in features]
    full = [c for c in names if not gaps[c]]
    clean = [(t, f) for t, f in pairs if t in full and f in full]
    out = None
    if clean:
        used = [c for c in names if any(c in p for p in clean)]
        out = _ranked_pearson(num.select(*used), clean, gaps["_n"], rows_per_bucket)
    for t, f in pairs:
        if (t, f) in clean:
            continue
        if nulls == "propagate":
            part = df.sparkSession.range(1).select(
                F.lit(t).alias("target"), F.lit(f).alias("feature"),
                F.lit(None).cast("double").alias("r"))
        else:
            cols = list(dict.fromkeys((t, f)))
            part = _ranked_pearson(num.select(*cols).dropna(), [(t, f)], gaps["_n"],
                                   rows_per_bucket)
        out = part if out is None else out.unionByName(part)
    return out


def _ranked_pearson(num: DataFrame, pairs, n: int, rows_per_bucket: int) -> DataFrame:
    """Pearson of the ranks of complete rows; ``n`` bounds the row count.

    The rank table of a column is unique by value and small when values repeat, so
    Spark broadcasts it at run time by its measured size; otherwise the join is a
    plain shuffle whose hot values the adaptive skew join splits.
    """
    ranked = num
    for c in num.columns:
        ranks = average_ranks(num.select(F.col(c).alias("val")), [], n, "val", rows_per_bucket)
        # centring by (n+1)/2 keeps the sums of products small and exact
        ranked = ranked.join(ranks.select(
            F.col("val").alias(c),
            (F.col("rank") - (F.col("total") + 1) / 2.0).alias(f"_rank_{c}")), c)

    def product(a: str, b: str) -> Column:
        return F.sum(F.col(f"_rank_{a}") * F.col(f"_rank_{b}"))

    aggs = [F.try_divide(product(t, f), F.sqrt(product(t, t) * product(f, f))).alias(f"r{i}")
            for i, (t, f) in enumerate(pairs)]
    return _long(ranked.agg(*aggs), pairs)


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson",
                       nulls: str = "skip") -> DataFrame:
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    return (pearson if method == "pearson" else spearman)(df, cols, cols, nulls)


def select_features(corr: DataFrame, threshold: float = 0.4,
                    forced: Sequence[str] = ()) -> DataFrame:
    """(feature): those with any |r| > threshold, plus the forced ones if absent."""
    picked = (corr.groupBy("feature")
              .agg(F.bool_or(F.coalesce(F.abs("r") > threshold, F.lit(False))).alias("_keep"))
              .where("_keep").select("feature"))
    if not forced:
        return picked
    extra = corr.sparkSession.createDataFrame([(f,) for f in forced], "feature string")
    return picked.unionByName(extra).distinct()


def correlation_wide(corr: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per target, one column per feature."""
    return corr.groupBy("target").pivot("feature", list(features)).agg(F.first("r"))


def stack_matrices(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two matrices with different columns, missing cells NULL."""
    return first.unionByName(second, allowMissingColumns=True)
