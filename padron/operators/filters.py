"""Row filters with explicit null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.numbers import parse_number_es
from padron.lookups import ALL_REGIONS, ALL_REGIONS_LABEL, EXCLUDED_REGIONS


def not_in(column: Column, values=EXCLUDED_REGIONS) -> Column:
    """Not one of the values; a null is none of them."""
    return F.coalesce(~column.isin(*values), F.lit(True))


def differs(column: Column, value) -> Column:
    """Not the value; a null differs."""
    return ~column.eqNullSafe(F.lit(value))


def equal_all(df: DataFrame, **values) -> DataFrame:
    """All columns equal their values."""
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def in_territory(df: DataFrame, choice: str, column: str = "CCAA") -> DataFrame:
    """One territory, or all of them for the catch-all choice in either language."""
    if choice in {ALL_REGIONS, *ALL_REGIONS_LABEL.values()}:
        return df
    return df.filter(F.col(column) == F.lit(choice))


def drop_missing(df: DataFrame, column: str = "Total") -> DataFrame:
    """Rows with a measure; the ``..`` mark counts as missing."""
    return df.filter(F.col(column).isNotNull() & ~F.trim(F.col(column)).isin("", ".."))


def has_number(df: DataFrame, column: str = "Total") -> DataFrame:
    return df.filter(parse_number_es(F.col(column)).isNotNull())


def containing(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.filter(F.contains(F.col(column), F.lit(part)))


def _domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, so that a handful of rows per task meets the other side."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def year_domain(left: DataFrame, right: DataFrame, column: str = "periodo") -> DataFrame:
    """Years that both sources cover, latest first."""
    return (
        _domain(left, column).intersect(_domain(right, column)).orderBy(F.col(column).desc())
    )


def territory_domain(df: DataFrame, column: str = "CCAA", lang: str = "ES") -> DataFrame:
    """The catch-all choice and every territory of the data, in order."""
    spark = df.sparkSession
    label = ALL_REGIONS_LABEL.get(lang, ALL_REGIONS)
    everything = spark.range(1).select(F.lit(0).alias("prio"), F.lit(label).alias("territory"))
    regions = (
        df.select(F.col(column).alias("territory")).filter(F.col(column).isNotNull())
        .filter(not_in(F.col(column))).distinct()
    )
    return everything.unionByName(
        regions.select(F.lit(1).alias("prio"), "territory")
    ).orderBy("prio", "territory")
