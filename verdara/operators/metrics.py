"""Regression scores and the tables made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.functions.radar import round_even

# Metric names as they appear in metric files and tables.
METRICS = ("RMSE", "MAE", "R2", "rRMSE(%)")
TABLE_METRICS = ("MAE", "R2", "rRMSE(%)")
TABLE_COLUMNS = ("MAE (train)", "MAE (val)", "R2 (train)", "R2 (val)",
                 "rRMSE% (train)", "rRMSE% (val)")


def regression_metrics(df: DataFrame, y: str, yhat: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, RMSE, MAE, R2, rRMSE(%)) in one aggregation.

    With a constant y, R2 is 1 for a perfect fit and 0 otherwise; rRMSE is NULL when
    the mean of |y| is 0.
    """
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    both = t.isNotNull() & p.isNotNull()
    sums = df.where(both).groupBy(*keys).agg(
        F.avg((t - p) * (t - p)).alias("_mse"), F.avg(F.abs(t - p)).alias("MAE"),
        F.var_pop(t).alias("_var"), F.avg(F.abs(t)).alias("_mean_abs"))
    flat = F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(
        *keys, F.sqrt("_mse").alias("RMSE"), "MAE",
        F.when(F.col("_var") == 0, flat)
        .otherwise(1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("R2"),
        (100.0 * F.try_divide(F.sqrt("_mse"), F.col("_mean_abs"))).alias("rRMSE(%)"))


def metrics_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) from one row per model and set."""
    return wide.unpivot(list(keys), list(METRICS), "metric", "value")


def residuals(df: DataFrame, y: str, yhat: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, observed, estimated, residual)."""
    return df.select(*keep, F.col(y).cast("double").alias("observed"),
                     F.col(yhat).cast("double").alias("estimated"),
                     (F.col(y).cast("double") - F.col(yhat).cast("double")).alias("residual"))


def relabel(df: DataFrame, col: str, labels: Mapping[str, str]) -> DataFrame:
    return df.na.replace(dict(labels), subset=[col])


def metrics_table(long: DataFrame) -> DataFrame:
    """Model × target rows, set × metric columns (means), two decimals half-even."""
    cells = []
    for name in TABLE_COLUMNS:
        metric, which = name.split(" ")
        metric = "rRMSE(%)" if metric == "rRMSE%" else metric
        which = which.strip("()")
        cells.append(round_even(F.avg(F.when(
            (F.col("metric") == metric) & (F.col("set") == which), F.col("value")))).alias(name))
    return (long.where(F.col("metric").isin(*TABLE_METRICS))
            .groupBy(F.col("model").alias("Model"), F.col("target").alias("Target")).agg(*cells))


def mean_metrics(table: DataFrame) -> DataFrame:
    """Mean over the targets of each model, two decimals half-even."""
    return table.groupBy("Model").agg(
        *[round_even(F.avg(F.col(f"`{c}`"))).alias(c) for c in TABLE_COLUMNS])


def best_model(table: DataFrame, which: str = "train") -> DataFrame:
    """Row of the highest R2 per target; the first model name wins a tie."""
    score = f"R2 ({which})"
    rest = [c for c in table.columns if c != "Target"]
    order = F.struct(F.coalesce(-F.col(f"`{score}`"), F.lit(float("inf"))), F.col("Model"))
    return (table.groupBy("Target")
            .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_r"))
            .select(*[F.col("Target") if c == "Target" else F.col("_r")[c].alias(c)
                      for c in table.columns]))


def table_rows(table: DataFrame) -> DataFrame:
    """(Model, Target, line): cells joined by `` & `` and closed by ``\\\\``."""
    cells = [F.col(f"`{c}`").cast("string") for c in table.columns]
    return table.select("Model", "Target",
                        F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def table_header(columns: Sequence[str]) -> str:
    return " & ".join(columns) + " \\\\"


def table_lines(table: DataFrame) -> DataFrame:
    """(line) of the whole text table: the header, then the rows by model and target."""
    head = table.sparkSession.createDataFrame(
        [(0, None, None, table_header(table.columns))],
        "_i int, Model string, Target string, line string")
    rows = table_rows(table).select(F.lit(1).alias("_i"), "Model", "Target", "line")
    return head.unionByName(rows).orderBy("_i", "Model", "Target").select("line")


def metric_by_model(long: DataFrame, metric: str) -> DataFrame:
    return long.where(F.col("metric") == metric).select("model", "target", "set", "value")


def relative_error_columns(means: DataFrame) -> DataFrame:
    return means.select("Model", *[F.col(f"`{c}`") for c in means.columns if "RMSE%" in c])
