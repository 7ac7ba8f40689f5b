"""Join field rows to the radar date that is the same day or the nearest one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdara.functions.dates import day_of
from verdara.functions.points import has_prefix, normal_id
from verdara.operators.spread import ROWS_PER_TASK, hot_keys, salt_lookup, salt_rows
from verdara.operators.tidy import first_by

# Names that mark the point and the time column of a sheet.
POINT_NAMES = ("punto", "point", "punto_muestreo", "id_point")
POINT_PARTS = ("punto", "point")
TIME_PARTS = ("fechahora", "datetime", "date_time", "fecha_hora", "fecha", "date")


def detect_point_col(columns: Sequence[str]) -> str:
    """Exact name first, then a name containing a point word, else the first column."""
    exact = [c for c in columns if c.strip().lower() in POINT_NAMES]
    partial = [c for c in columns if any(p in c.lower() for p in POINT_PARTS)]
    return (exact + partial + list(columns))[0]


def detect_time_col(df: DataFrame) -> str | None:
    """A column of a time type first, then a readable column with a time-like name."""
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    for field in df.schema.fields:
        if isinstance(field.dataType, times):
            return field.name
    for field in df.schema.fields:
        if any(p in field.name.strip().lower() for p in TIME_PARTS):
            if not isinstance(field.dataType, T.StringType):
                continue
            col = F.col(f"`{field.name}`")
            bad = df.where(col.isNotNull() & F.try_to_timestamp(col).isNull())
            if bad.isEmpty():
                return field.name
    return None


def detect_roles(df: DataFrame) -> dict[str, str | None]:
    return {"point": detect_point_col(df.columns), "datetime": detect_time_col(df)}


def _field_with_day(field: DataFrame, point_col: str, time_col: str) -> DataFrame:
    return field.withColumns({
        point_col: normal_id(F.col(point_col)),
        "_day": day_of(F.col(time_col), field.schema[time_col].dataType.simpleString()),
    })


def nearest_dates(radar: DataFrame, point_col: str, variables: Sequence[str],
                  tolerance_days: int, hot: DataFrame) -> DataFrame:
    """(point, _day, _salt, sar_date, variables): the radar row nearest to each covered day.

    Every radar row offers itself to the days within the tolerance and one grouped
    ``min_by`` keeps the closest offer, the earlier date on a tie.  A group never
    has more than 2·tolerance+1 offers, so the result is unique by (point, day)
    before field rows are touched.  The salt of hot field keys is part of the group
    key, so the join that follows finds the offers already partitioned.
    """
    offers = (radar.where(F.col("date").isNotNull())
              .select(point_col, F.struct("date", *variables).alias("_r"),
                      F.explode(F.sequence(F.date_sub("date", tolerance_days),
                                           F.date_add("date", tolerance_days))).alias("_day")))
    gap = F.datediff(F.col("_r.date"), F.col("_day"))
    key = [point_col, "_day", "_salt"]
    return (salt_lookup(offers, [point_col, "_day"], hot).groupBy(*key)
            .agg(F.min_by("_r", F.struct(F.abs(gap), gap)).alias("_r"))
            .select(*key, F.col("_r.date").alias("sar_date"),
                    *[F.col("_r")[v].alias(v) for v in variables]))


def align(field: DataFrame, radar: DataFrame, point_col: str | None = None,
          time_col: str | None = None, radar_point_col: str | None = None,
          keep: Sequence[str] | None = None, prefixes: Sequence[str] | None = None,
          tolerance_days: int | None = 2, hot_floor: int = ROWS_PER_TASK) -> DataFrame:
    """Field rows with the tidy radar columns of the same or nearest day.

    ``radar`` is tidy: (point, date, variables).  Rows whose points are one after normalisation
    are folded by date.  All field rows stay, each once; ``sar_date`` and ``day_diff`` (radar day − field day) are NULL without
    a match.  ``tolerance_days=None`` matches the same day only.  ``keep`` lists the
    radar variables wanted (absent names are ignored); ``prefixes`` limits radar
    points by id prefix.
    """
    point_col = point_col or detect_point_col(field.columns)
    time_col = time_col or detect_time_col(field)
    if time_col is None:
        raise ValueError("no time column found in the field table")
    radar_point_col = radar_point_col or detect_point_col(radar.columns)
    variables = [c for c in radar.columns if c not in (radar_point_col, "date")]
    if keep is not None:
        variables = [v for v in keep if v in variables]

    rhs = (radar.select(radar_point_col, "date", *variables)
           .withColumnRenamed(radar_point_col, "_raw"))
    # ids in several notations are one point: per variable the value of the least notation stays
    rhs = (rhs.groupBy(normal_id(F.col("_raw")).alias(point_col), "date")
           .agg(F.lit(1).alias("_row"), *[first_by(v, "_raw").alias(v) for v in variables]).drop("_row"))
    if prefixes is not None:
        rhs = rhs.where(has_prefix(F.col(point_col), [p.upper() for p in prefixes]))
    lhs = _field_with_day(field, point_col, time_col)
    rest = [c for c in field.columns if c not in (point_col, time_col)]
    key = [point_col, "_day"]
    hot = hot_keys(lhs.select(*key), key, floor=hot_floor)
    if tolerance_days is None:
        rhs = salt_lookup(rhs.where("date IS NOT NULL").select(
            point_col, F.col("date").alias("_day"), F.col("date").alias("sar_date"),
            *variables), key, hot)
    else:
        rhs = nearest_dates(rhs, point_col, variables, tolerance_days, hot)
    joined = salt_rows(lhs, key, hot).join(rhs, [*key, "_salt"], "left")
    return joined.select(
        point_col, time_col, *rest, F.col("_day").alias("day"), "sar_date",
        F.datediff("sar_date", "_day").alias("day_diff"), *variables)


def align_stats(aligned: DataFrame, probe_col: str | None = None) -> DataFrame:
    """One row of counters: n, unmatched_exact, filled_nearest, unmatched.

    A row is matched exactly when its radar date is its own day and, if a probe
    variable is named, that variable is not NULL.
    """
    exact = F.coalesce(F.col("day_diff") == 0, F.lit(False))
    if probe_col is not None:
        exact = exact & F.col(probe_col).isNotNull()
    found = F.col("sar_date").isNotNull()
    return aligned.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~exact).alias("unmatched_exact"),
        F.count_if(~exact & found).alias("filled_nearest"),
        F.count_if(~found).alias("unmatched"))


def dates_by_point(radar: DataFrame, point_col: str, date_col: str = "date") -> DataFrame:
    """Number of distinct dates, first and last date of each point."""
    return (radar.select(point_col, date_col).distinct().groupBy(point_col)
            .agg(F.count(date_col).alias("n_dates"), F.min(date_col).alias("first"),
                 F.max(date_col).alias("last")))


def outer_merge(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of tables that are unique by ``on``."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, list(on), "full")
    return out
