"""VH+VV and VH/VV per product and date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.functions.radar import (
    cross_ratio, cross_sum, db_to_linear, floored_db, linear_to_db, parse_intensity)
from verdara.operators.spread import attach_groups


def crosspol_long(rows: DataFrame, keys: Sequence[str], pol_col: str = "pol",
                  val_col: str = "val", in_db: bool = False,
                  output_db: bool = False) -> DataFrame:
    """(keys, sum_vhvv, ratio_vh_vv) from long rows; only keys with both VH and VV.

    One grouped conditional aggregation pairs the polarisations; no self-join.
    """
    vh, vv = (F.max(F.when(F.col(pol_col) == p, F.col(val_col))).alias(f"_{p}")
              for p in ("VH", "VV"))
    pairs = (rows.where(F.col(pol_col).isin("VH", "VV")).groupBy(*keys).agg(vh, vv)
             .where(F.col("_VH").isNotNull() & F.col("_VV").isNotNull()))
    return pairs.select(*keys, *_metrics(F.col("_VH"), F.col("_VV"), in_db, output_db,
                                         "sum_vhvv", "ratio_vh_vv"))


def _metrics(vh, vv, in_db, output_db, sum_name, ratio_name):
    if in_db:
        vh, vv = db_to_linear(vh), db_to_linear(vv)
    total, ratio = cross_sum(vh, vv), cross_ratio(vh, vv)
    if output_db:
        total, ratio = linear_to_db(total), linear_to_db(ratio)
    return total.alias(sum_name), ratio.alias(ratio_name)


def crosspol_wide(wide: DataFrame, id_cols: Sequence[str], in_db: bool = True,
                  output_db: bool = False,
                  products: Sequence[str] = ("Sigma0", "Gamma0")) -> DataFrame:
    """``<prod>_SUM_VHVV_<date>`` and ``<prod>_RATIO_VH_VV_<date>`` columns, map-only.

    Columns are paired by the names alone; an incomplete pair gives no column, and
    the new columns follow the ids in name order.
    """
    wanted = {p.lower() for p in products}
    pairs: dict[tuple[str, str], dict[str, str]] = {}
    for col in wide.columns:
        parts = parse_intensity(col)
        # derived SUM/RATIO columns also name both polarisations; they are no inputs
        if parts is None or col in id_cols or parts[0].lower() not in wanted or any(
                mark in col.upper() for mark in ("_SUM_", "_RATIO_")):
            continue
        prod, pol, day = parts
        pairs.setdefault((prod, day), {})[pol] = col
    made = {}
    for (prod, day), cols in pairs.items():
        if {"VH", "VV"} <= cols.keys():
            names = f"{prod}_SUM_VHVV_{day}", f"{prod}_RATIO_VH_VV_{day}"
            vh, vv = (F.col(f"`{cols[p]}`").cast("double") for p in ("VH", "VV"))
            made.update(zip(names, _metrics(vh, vv, in_db, output_db, *names)))
    return wide.select(*id_cols, *[made[n] for n in sorted(made)])


def common_dates(rows: DataFrame, keys: Sequence[str], label_col: str, first: str,
                 second: str) -> DataFrame:
    """Keys (such as point and date) that occur with both labels."""
    return (rows.where(F.col(label_col).isin(first, second)).groupBy(*keys)
            .agg(F.bool_or(F.col(label_col) == first).alias("_a"),
                 F.bool_or(F.col(label_col) == second).alias("_b"))
            .where("_a AND _b").select(*keys))


def scale_db(rows: DataFrame, group_cols: Sequence[str], val_col: str,
             out_col: str = "scaled") -> DataFrame:
    """Per-group min-max scaling of 10·log10(x + 1e-10).

    The group extremes are aggregated map-side first and joined back by
    ``attach_groups``, so a raster with a large share of the pixels stays spread.
    """
    db = rows.withColumn("_db", floored_db(F.col(val_col)))
    ends = db.groupBy(*group_cols).agg(F.min("_db").alias("_lo"), F.max("_db").alias("_hi"))
    return (attach_groups(db, ends, group_cols)
            .withColumn(out_col, F.try_divide(F.col("_db") - F.col("_lo"),
                                              F.col("_hi") - F.col("_lo")))
            .drop("_db", "_lo", "_hi"))
