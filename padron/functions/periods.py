"""Years and months out of text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from padron.functions.text import strip


def year_cast(text: Column) -> Column:
    """A whole number as int; other text is null."""
    digits = F.regexp_extract(strip(text.cast("string")), r"^\+?(-?[0-9]+)(?:\.0*)?$", 1)
    return digits.try_cast("int")


def month_label(text: Column) -> Column:
    """First day of ``2026. Mes 03``; other labels are null."""
    iso = F.regexp_replace(strip(text), r"^([0-9]{4})\. Mes ([0-9]{2})$", "$1-$2-01")
    return F.try_to_date(iso, "yyyy-MM-dd")


def path_year(path: Column, missing: str = "N/D") -> Column:
    """First ``20xx`` in a path."""
    found = F.regexp_extract(path, r"(20[0-9]{2})", 1)
    return F.when(found != "", found).otherwise(F.lit(missing))


def path_category(path: Column) -> Column:
    """Lower-case path part that follows ``raw``; empty without one."""
    unix = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.regexp_extract(unix, r"(?:^|/)raw/([^/]*)", 1)
