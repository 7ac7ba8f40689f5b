"""Wide radar tables (one column per variable and date) to tidy rows and back."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.functions.dates import split_name, tag_to_date


def first_by(value: str, order: str | Column | None) -> Column:
    """The first value that is not NULL in the order of the rows; without an order the least."""
    if order is None:
        return F.min(value)
    place = F.col(f"`{order}`") if isinstance(order, str) else order
    return F.min_by(value, F.when(F.col(value).isNotNull(), place))


def dated_columns(columns: Sequence[str], point_col: str,
                  flexible: bool = True) -> list[tuple[str, str, dt.date]]:
    """(column, variable, date) of each value column whose date tag can be read."""
    values = [c for c in columns if c != point_col]
    if not values:
        raise ValueError("the radar table has no value columns")
    parts = [(c, *split_name(c)) for c in values]
    dates = {tag: tag_to_date(tag, flexible) for _, _, tag in parts}
    return [(c, base, dates[tag]) for c, base, tag in parts if dates[tag] is not None]


def tidy_long(wide: DataFrame, point_col: str, flexible: bool = True,
              drop_null: bool = False) -> DataFrame:
    """(point, var_base, date, val): one narrow, shuffle-free unpivot."""
    found = dated_columns(wide.columns, point_col, flexible)
    if not found:
        raise ValueError("no value column carries a readable date tag")
    cells = [x for col, base, day in found
             for x in (F.lit(base), F.lit(day), F.col(f"`{col}`").cast("double"))]
    rows = wide.select(
        point_col, F.stack(F.lit(len(found)), *cells).alias("var_base", "date", "val"))
    return rows.dropna(subset=["val"]) if drop_null else rows


def pivot_tidy(rows: DataFrame, point_col: str, variables: Sequence[str],
               order: str | None = None) -> DataFrame:
    """(point, date, one column per variable) from long rows.

    Several values of one cell give the first in the order of the column ``order``, such as the
    position that readers add; without it the least.  The value list is explicit, so no extra
    pass looks for the distinct variables.
    """
    return (rows.where(F.col("val").isNotNull() & F.col("var_base").isin(list(variables)))
            .groupBy(point_col, "date")
            .pivot("var_base", list(variables))
            .agg(first_by("val", order)))


def tidy_wide(wide: DataFrame, point_col: str, flexible: bool = True,
              unique_points: bool = False, order: str | None = None) -> DataFrame:
    """(point, date, one column per variable); rows without any value vanish.

    Columns of one date are turned into one row at once, so the unpivot makes one
    row per date instead of one per cell.  ``unique_points=True`` states that a
    point has one input row; then nothing has to be grouped or shuffled.  Several columns of
    one variable and date (tags in two notations) give the first that is not NULL.  Several
    rows of a point give the first value in the order of the column ``order``, such as the
    position that readers add, an earlier column before an earlier row; without it the least.
    """
    by_date: dict[dt.date, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    named = [c for c in wide.columns if c != order]
    for col, base, day in dated_columns(named, point_col, flexible):
        by_date[day][base].append(col)
    variables = sorted({v for cols in by_date.values() for v in cols})
    if not variables:
        raise ValueError("no value column carries a readable date tag")

    def cell(cols: dict[str, list[str]], var: str) -> Column:
        return F.coalesce(*[F.col(f"`{c}`").cast("double") for c in cols.get(var, [])],
                          F.lit(None).cast("double"))

    def column_place(cols: dict[str, list[str]], var: str) -> Column:
        """Which of the cell's columns holds its value."""
        return F.coalesce(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(i))
                            for i, c in enumerate(cols.get(var, []))], F.lit(0))

    grouped = not unique_points
    ordered = order is not None and grouped
    several = {v for v in variables if any(len(c.get(v, [])) > 1 for c in by_date.values())} \
        if ordered else set()
    flat = [x for day, cols in sorted(by_date.items())
            for x in (F.lit(day), *[cell(cols, v) for v in variables],
                      *[column_place(cols, v) for v in sorted(several)])]
    places = {v: f"_place{i}" for i, v in enumerate(sorted(several))}
    carried = [F.col(f"`{order}`").alias("_order")] if ordered else []
    rows = wide.select(point_col, *carried, F.stack(F.lit(len(by_date)), *flat).alias(
        "date", *variables, *places.values()))
    if grouped:
        def first(v: str) -> Column:
            if not ordered:
                return first_by(v, None)
            return first_by(v, F.struct(places[v], "_order") if v in places else F.col("_order"))

        rows = rows.groupBy(point_col, "date").agg(*[first(v).alias(v) for v in variables])
    return rows.dropna(how="all", subset=variables)


def widen(tidy: DataFrame, point_col: str, variables: Sequence[str],
          days: Sequence[dt.date], tag_format: str = "%d%b%Y") -> DataFrame:
    """Back to one row per point with ``<variable>_<dateTag>`` columns.

    A point's values are gathered in one map by variable and date, and the columns are read from
    it; the aggregation stays one expression however long the calendar is.
    """
    cells = F.array(*[F.struct(F.concat(F.lit(f"{v} "), F.col("date").cast("string")).alias("k"),
                               F.col(v).cast("double").alias("v")) for v in variables])
    held = (tidy.where(F.col("date").isNotNull())
            .groupBy(point_col).agg(F.map_from_entries(F.flatten(F.collect_list(cells))).alias("_m")))
    return held.select(point_col, *[
        F.try_element_at("_m", F.lit(f"{v} {day}")).alias(f"{v}_{day.strftime(tag_format)}")
        for v in variables for day in days])
