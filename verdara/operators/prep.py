"""Column selection, missing values, scaling, splitting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.operators.ordered import medians, values_at_ranks


def select_xy(df: DataFrame, targets: str | Sequence[str],
              features: Sequence[str] | None = None) -> DataFrame:
    """Features then targets; by default every column that is no target is a feature."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    features = [c for c in df.columns if c not in targets] if features is None else list(features)
    return df.select(*features, *targets)


def fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0)


def model_ready(df: DataFrame, id_col: str, time_col: str, targets: Sequence[str],
                features: Sequence[str]) -> DataFrame:
    return df.select(id_col, time_col, *targets, *features)


@dataclass(frozen=True)
class Scaling:
    """Fitted numbers of the preprocessing: one median, mean and deviation per feature."""

    median: Mapping[str, float]
    mean: Mapping[str, float]
    std: Mapping[str, float]

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: _filled(c, m) for c, m in self.median.items()})

    def standardise(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (_filled(c, self.median[c]) - F.lit(self.mean[c])) / F.lit(self.std[c])
            for c in self.median})


def _filled(col: str, median: float | None):
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    return x if median is None else F.coalesce(x, F.lit(median))


def fit_scaling(train: DataFrame, features: Sequence[str]) -> Scaling:
    """Median for missing values, then mean and population deviation (0 becomes 1)."""
    row = _moments(train, features, {})
    mid = medians(train, features, n=row["n"])
    if any(row[f"gaps_{c}"] for c in features):
        row = _moments(train, features, mid)
    return Scaling({c: mid.get(c) for c in features}, {c: row[f"m_{c}"] for c in features},
                   {c: row[f"s_{c}"] or 1.0 for c in features})


def _moments(df: DataFrame, features: Sequence[str], mid: Mapping[str, float]) -> dict:
    """Row count, and missing values, mean and deviation per feature, in one pass."""
    x = {c: _filled(c, mid.get(c)) for c in features}
    return df.agg(F.count(F.lit(1)).alias("n"), *[a for c in features for a in (
        F.count_if(x[c].isNull()).alias(f"gaps_{c}"), F.avg(x[c]).alias(f"m_{c}"),
        F.stddev_pop(x[c]).alias(f"s_{c}"))]).first().asDict()


def _order_key(id_cols: Sequence[str], seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def random_split(df: DataFrame, id_cols: Sequence[str], val_size: float = 0.3,
                 seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ceil(n·val_size) rows are 'val', the rest 'train'.

    Rows are ordered by md5(seed, ids); ``id_cols`` must identify a row.  The key of
    the last validation row is found by counting hash prefixes (at most 65,536 counts
    per round come back), so nothing is sorted and the split itself is a filter.
    """
    key = _order_key(id_cols, seed)
    keys = df.select(key.alias("_k"))
    need, prefix = None, ""
    for width in range(4, 33, 4):
        counts = (keys.where(F.col("_k").startswith(prefix))
                  .groupBy(F.substring("_k", 1, width).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        if need is None:
            total = sum(r["n"] for r in counts)
            need = math.ceil(total * val_size)
            if need <= 0 or need >= total:
                return df.withColumn("split", F.lit("train" if need <= 0 else "val"))
        for r in sorted(counts, key=lambda r: r["p"]):
            if need <= r["n"]:
                prefix = r["p"]
                break
            need -= r["n"]
        if need == r["n"]:
            break  # the whole prefix is in
    # "g" is above every hexadecimal digit
    return df.withColumn("split", F.when(key <= F.lit(prefix + "g"), "val").otherwise("train"))


def contiguous_folds(df: DataFrame, order_col: str, folds: int = 5,
                     name: str = "fold") -> DataFrame:
    """Add an INT fold 0…k−1: equal runs of rows in ``order_col`` order.

    The first n mod k folds hold one row more; ``order_col`` must be unique and may be of any
    orderable type.  Rows without it come first.
    """
    n = df.where(F.col(order_col).isNotNull()).count()
    sizes = [n // folds + (1 if i < n % folds else 0) for i in range(folds)]
    ends = [sum(sizes[:i + 1]) for i in range(folds - 1)]
    fold = F.lit(0)
    for cut in values_at_ranks(df, order_col, [e for e in ends if e > 0]):
        fold = fold + F.coalesce((F.col(order_col) > F.lit(cut)).cast("int"), F.lit(0))
    return df.withColumn(name, fold.cast("int"))
