"""Decibel algebra, cross-polarisation formulas and band-name parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date part of a band name and the three name families.
DATE_PART = r"(\d{2}[A-Za-z]{3}\d{4}|\d{4}[-_]\d{2}[-_]\d{2}|\d{8})"
INTENSITY_NAME = r"(?i)(Sigma0|Gamma0).*?(VH|VV).*?" + DATE_PART
DECOMPOSITION_NAME = r"(?i)(Entropy|Anisotropy|Alpha).*?" + DATE_PART
VEGETATION_INDEX_NAME = r"(?i)(dpRVI).*?" + DATE_PART


def is_finite(x: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x.cast("double"))


def db_to_linear(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10.0)


def linear_to_db(x: Column) -> Column:
    """10·log10(x); NULL for x ≤ 0."""
    return F.when(x > 0, 10.0 * F.log10(x))


def floored_db(x: Column, floor: float = 1e-10) -> Column:
    """10·log10(x + floor), finite at zero."""
    return 10.0 * F.log10(x + F.lit(floor))


def cross_sum(vh: Column, vv: Column) -> Column:
    return vh + vv


def cross_ratio(vh: Column, vv: Column) -> Column:
    """VH/VV with a zero denominator giving NULL."""
    return F.try_divide(vh, vv)


def intensity_parts(name: Column) -> Column:
    """struct(prod, pol, date) of an intensity band name, NULL if it is none."""
    return F.when(name.rlike(INTENSITY_NAME), F.struct(
        F.regexp_extract(name, INTENSITY_NAME, 1).alias("prod"),
        F.upper(F.regexp_extract(name, INTENSITY_NAME, 2)).alias("pol"),
        F.regexp_extract(name, INTENSITY_NAME, 3).alias("date")))


def decomposition_parts(name: Column) -> Column:
    """struct(param, date) of an entropy/anisotropy/alpha band name."""
    return F.when(name.rlike(DECOMPOSITION_NAME), F.struct(
        F.initcap(F.regexp_extract(name, DECOMPOSITION_NAME, 1)).alias("param"),
        F.regexp_extract(name, DECOMPOSITION_NAME, 2).alias("date")))


def vegetation_index_date(name: Column) -> Column:
    """Date text of a dpRVI band name, ``NA`` for a bare dpRVI, NULL otherwise."""
    return (F.when(name.rlike(VEGETATION_INDEX_NAME),
                   F.regexp_extract(name, VEGETATION_INDEX_NAME, 2))
            .when(name.rlike("(?i)dprvi"), F.lit("NA")))


def parse_intensity(name: str) -> tuple[str, str, str] | None:
    """Driver-side (product, polarisation, date) of a name held in a band dictionary."""
    m = re.search(INTENSITY_NAME, name)
    return (m.group(1).capitalize(), m.group(2).upper(), m.group(3)) if m else None


def parse_decomposition(name: str) -> tuple[str, str] | None:
    m = re.search(DECOMPOSITION_NAME, name)
    return (m.group(1).capitalize(), m.group(2)) if m else None


def round_even(x: Column, digits: int = 2) -> Column:
    """Round to ``digits`` decimals, halves to even, on the scaled binary value."""
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale
