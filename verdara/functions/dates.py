"""Date tags, column-name splitting and timestamp helpers.

Radar tables encode the acquisition date in column names.  The names of a wide
table are parsed once on the driver (``tag_to_date``, ``split_name``); the
``*_col`` twins do the same for names that are stored as row values.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations, English and Spanish, by month number.
ENGLISH_MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
}
MONTH_NUMBERS = ENGLISH_MONTHS | {"ENE": 1, "ABR": 4, "AGO": 8, "DIC": 12}

_DAY_MONTH_YEAR = r"^([0-9]{1,2})([A-Za-z]{3})[A-Za-z]*([0-9]{4})$"
_EIGHT_DIGITS = r"^[0-9]{8}$"
# A date suffix that itself holds separators must win over "split at the last _".
_SEPARATED_SUFFIX = (
    r"^(.*)_([0-9]{4}[-_][0-9]{2}[-_][0-9]{2}"
    r"|[0-9]{1,2}[-_][A-Za-z]{3,}[-_][0-9]{4})$"
)
_LAST_UNDERSCORE = r"^(.*)_([^_]*)$"


def clean_tag(tag: Column) -> Column:
    """Drop every character of a date tag that is not a letter or a digit."""
    return F.regexp_replace(tag, "[^0-9A-Za-z]", "")


def date_from_tag(tag: Column, flexible: bool = True) -> Column:
    """Date of a flexible tag: dMonYYYY (EN/ES), YYYYMMDD (19xx/20xx) or DDMMYYYY.

    Unreadable tags give NULL through ``try_cast``, which, unlike a failing pattern
    parse, raises nothing inside.
    """
    z = clean_tag(tag)
    # one match turns 8Apr2025 into 2025-Apr-8; other tags stay as they are
    parts = F.regexp_replace(z, _DAY_MONTH_YEAR, "$3-$2-$1")
    names = MONTH_NUMBERS if flexible else ENGLISH_MONTHS
    months = F.create_map(
        *[F.lit(x) for abbrev, num in names.items() for x in (abbrev, f"{num:02d}")])
    named = F.concat(F.substring(parts, 1, 5),
                     F.element_at(months, F.upper(F.substring(parts, 6, 3))), F.lit("-"),
                     F.lpad(F.substring(parts, 10, 2), 2, "0"))
    ymd = F.concat_ws("-", F.substring(z, 1, 4), F.substring(z, 5, 2), F.substring(z, 7, 2))
    dmy = F.concat_ws("-", F.substring(z, 5, 4), F.substring(z, 3, 2), F.substring(z, 1, 2))
    eight = (F.length(z) == 8) & z.try_cast("int").isNotNull()
    year_first = z.startswith("19") | z.startswith("20")
    iso = F.when(parts != z, named).when(eight & year_first, ymd)
    if flexible:
        iso = iso.when(eight, dmy)
    return iso.try_cast("date")


def date_from_plain_tag(tag: Column) -> Column:
    """Date of a tag in one of the two generic styles, dMonYYYY (EN) or YYYYMMDD."""
    return date_from_tag(tag, flexible=False)


def tag_to_date(tag: str | None, flexible: bool = True) -> dt.date | None:
    """Driver-side twin of ``date_from_tag`` for tags held in column names."""
    z = re.sub(r"[^0-9A-Za-z]", "", tag or "")
    named = re.match(_DAY_MONTH_YEAR, z)
    try:
        if named:
            abbrev = named.group(2).upper()
            number = (MONTH_NUMBERS if flexible else ENGLISH_MONTHS).get(abbrev)
            if number is None:
                return None
            return dt.date(int(named.group(3)), number, int(named.group(1)))
        if re.match(_EIGHT_DIGITS, z):
            if z[:2] in ("19", "20"):
                return dt.date(int(z[:4]), int(z[4:6]), int(z[6:]))
            if flexible:
                return dt.date(int(z[4:]), int(z[2:4]), int(z[:2]))
    except ValueError:
        return None
    return None


def split_name(name: str) -> tuple[str, str]:
    """``<base>_<dateTag>`` of a column name; a name without ``_`` has an empty tag."""
    for pattern in (_SEPARATED_SUFFIX, _LAST_UNDERSCORE):
        found = re.match(pattern, name)
        if found:
            return found.group(1), found.group(2)
    return name, ""


def split_name_col(name: Column) -> Column:
    """``split_name`` for names stored as values: struct(base, tag)."""
    pattern = (
        F.when(name.rlike(_SEPARATED_SUFFIX), F.struct(
            F.regexp_extract(name, _SEPARATED_SUFFIX, 1).alias("base"),
            F.regexp_extract(name, _SEPARATED_SUFFIX, 2).alias("tag")))
        .when(name.rlike(_LAST_UNDERSCORE), F.struct(
            F.regexp_extract(name, _LAST_UNDERSCORE, 1).alias("base"),
            F.regexp_extract(name, _LAST_UNDERSCORE, 2).alias("tag")))
        .otherwise(F.struct(name.alias("base"), F.lit("").alias("tag")))
    )
    return pattern


def day_of(value: Column, dtype: str) -> Column:
    """Calendar day of a date, timestamp or text column; unreadable text gives NULL."""
    if dtype == "string":
        return F.try_to_timestamp(value).cast("date")
    return value.cast("date")


def month_start(value: Column) -> Column:
    return F.trunc(value, "MM")


def date_plus_time(day: Column, time_text: Column) -> Column:
    """Timestamp without zone from a day and an ``HH:mm:ss`` text."""
    return F.to_timestamp_ntz(
        F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), time_text),
        F.lit("yyyy-MM-dd HH:mm:ss"),
    )
