"""Spanish number text to double and back, and the display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from padron.functions.text import strip

NBSP = "\xa0"
# Characters of a plain number; Java would also take a type suffix such as ``1d``.
NUMBER_CHARS = r"^(?:[-+.0-9eE]+|[-+]?(?i:inf|infinity))$"
# Several dots, or one dot before exactly three digits: dots group thousands.
GROUPED = r"\..*\.|^[0-9]+\.[0-9]{3}$"


def parse_number_es(text: Column) -> Column:
    """``1.234,5``, ``1.234`` and ``1.234.567`` by Spanish rules; missing or bad is null."""
    raw = F.translate(strip(text), NBSP + " ", "")
    # A dot without a partner in the target string is deleted.
    ungrouped = F.translate(raw, ",.", ".")
    number = (
        F.when(F.contains(raw, F.lit(",")), ungrouped)
        .when(raw.rlike(GROUPED), ungrouped)
        .otherwise(raw)
    )
    return F.when(number.rlike(NUMBER_CHARS), number.try_cast("double"))


def _spanish(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def format_number_es(value: Column) -> Column:
    """``43.829`` for whole values, else ``1.234,50``."""
    whole = value == F.rint(value)
    return _spanish(F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2)))


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as a double."""
    text = F.format_number(value, digits)
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed decimals without thousands marks, half to even."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def kpi_spend(value: Column) -> Column:
    return F.concat(F.lit("€ "), fixed_text(value, 0))


def kpi_licences(value: Column) -> Column:
    """``1.2M`` above a hundred thousand, else with thousands marks."""
    compact = F.concat(fixed_text(value / F.lit(1e6), 1), F.lit("M"))
    return F.when(value > F.lit(1e5), compact).otherwise(F.format_number(value, 0))


def shortest_text(value: Column) -> Column:
    """A double in its shortest form without an exponent between 1e-4 and 1e16."""
    size = F.abs(value)
    plain = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    wide = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(wide, plain).otherwise(value.cast("string"))
