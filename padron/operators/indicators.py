"""Home indicators: licences joined with household spend, and what is shown of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padron.functions.numbers import kpi_licences, kpi_spend, parse_number_es
from padron.functions.text import repair_mojibake
from padron.lookups import (
    ALL_FEDERATIONS,
    LICENCE_FILE,
    LICENCE_HEADERS,
    LICENCES_COL,
    REGION_COL,
    SPEND_COL,
    SPEND_FILE,
    SPEND_HEADERS,
    SPEND_INDICATOR,
)
from padron.operators.columns import coalesce_columns, localised, with_year
from padron.operators.filters import differs, not_in
from padron.operators.regions import harmonise, region_key

KEYS = ["ccaa_key", "periodo"]


def total_of(value: Column) -> Column:
    """Sum as doubles; 0 without rows. The last digits may follow the order of addition."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def mean_of(value: Column) -> Column:
    """Mean of the non-null values as doubles; null without any."""
    return F.avg(value.cast("double"))


def _in_years(df: DataFrame, years: Iterable[int] | None) -> DataFrame:
    return df if years is None else df.filter(F.col("periodo").isin(*years))


def _cleaned(df: DataFrame, headers: dict[str, list[str]], source_file: str | None) -> DataFrame:
    """Canonical columns with repaired text, year, number and region key."""
    if source_file is not None:
        df = df.filter(F.col("archivo_origen") == source_file)
    df = with_year(coalesce_columns(df, headers))
    text = [c for c in ("federacion", "comunidad_autonoma", "indicador") if c in df.columns]
    df = df.withColumns({c: repair_mojibake(F.col(c)) for c in text})
    return df.withColumns(
        {
            "total_num": parse_number_es(F.col("total_raw")),
            "ccaa_limpia": region_key(F.col("comunidad_autonoma")),
        }
    ).filter(F.col("ccaa_limpia").isNotNull())


def _distinct_readings(side: DataFrame, value: str, *more: Column) -> DataFrame:
    """One row per key and value: copies merge before the shuffle, contradictions stay apart.

    A key with two values so gives two rows, here and in a join; ``contradictions`` names it.
    """
    return side.groupBy(*KEYS, value).agg(F.count(F.lit(1)).alias("_copies"), *more).drop("_copies")


def contradictions(side: DataFrame, value: str) -> DataFrame:
    """Keys of a licence or spend side with more than one value: how many, lowest, highest.

    A missing value beside a number is no contradiction.
    """
    return (
        side.groupBy(*KEYS)
        .agg(
            F.count_distinct(value).alias("values"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        )
        .filter("values > 1")
    )


def licence_side(
    licences: DataFrame,
    years: Iterable[int] | None = None,
    source_file: str | None = LICENCE_FILE,
    mapping: Column | None = None,
) -> DataFrame:
    """All-federation licences per territory and year, under the spend-side key."""
    rows = _in_years(_cleaned(licences, LICENCE_HEADERS, source_file), years)
    rows = rows.filter(F.col("federacion") == ALL_FEDERATIONS).filter(
        not_in(F.col("comunidad_autonoma"))
    )
    key = harmonise(F.col("ccaa_limpia")) if mapping is None else mapping
    side = rows.select(
        key.alias(KEYS[0]),
        KEYS[1],
        F.col("comunidad_autonoma").alias(REGION_COL),
        F.col("total_num").alias(LICENCES_COL),
    )
    return _distinct_readings(side, LICENCES_COL, F.min(REGION_COL).alias(REGION_COL))


def spend_side(
    spend: DataFrame,
    years: Iterable[int] | None = None,
    source_file: str | None = SPEND_FILE,
) -> DataFrame:
    """Mean household spend per territory key and year."""
    rows = _in_years(_cleaned(spend, SPEND_HEADERS, source_file), years)
    rows = rows.filter(F.col("indicador") == SPEND_INDICATOR).filter(
        differs(F.col("comunidad_autonoma"), "TOTAL")
    )
    side = rows.select(
        F.col("ccaa_limpia").alias(KEYS[0]), KEYS[1], F.col("total_num").alias(SPEND_COL)
    )
    return _distinct_readings(side, SPEND_COL)


def indicators_by_year(
    licences: DataFrame,
    spend: DataFrame,
    years: Iterable[int] | None = None,
    mapping: Column | None = None,
) -> DataFrame:
    """Territory, year, spend and licences where both sources have the territory."""
    years = None if years is None else list(years)
    joined = licence_side(licences, years, mapping=mapping).join(
        spend_side(spend, years), KEYS, "inner"
    )
    return joined.select(REGION_COL, "periodo", LICENCES_COL, SPEND_COL)


def home_indicators(
    licences: DataFrame, spend: DataFrame, year: int, mapping: Column | None = None
) -> DataFrame:
    return indicators_by_year(licences, spend, [int(year)], mapping).drop("periodo")


def yearly_report(indicators: DataFrame) -> DataFrame:
    """Per year: territories, mean spend, licences, and the sorted territory list.

    The list is bounded: the input has one row per territory and year.
    """
    return indicators.groupBy("periodo").agg(
        F.count(F.lit(1)).alias("n_regions"),
        mean_of(F.col(SPEND_COL)).alias("avg_spend"),
        total_of(F.col(LICENCES_COL)).alias("sum_licences"),
        F.sort_array(F.collect_list(REGION_COL)).alias("regions"),
    )


def kpis(indicators: DataFrame) -> DataFrame:
    """Mean spend, licences and areas with their card texts; no row for no data."""
    return (
        indicators.agg(
            mean_of(F.col(SPEND_COL)).alias("avg_spend"),
            total_of(F.col(LICENCES_COL)).alias("sum_licences"),
            F.count(F.lit(1)).alias("n_regions"),
        )
        .filter("n_regions > 0")
        .withColumns(
            {
                "spend_card": kpi_spend(F.col("avg_spend")),
                "licences_card": kpi_licences(F.col("sum_licences")),
                "regions_card": F.col("n_regions").cast("string"),
            }
        )
    )


def extreme_row(
    indicators: DataFrame, column: str, largest: bool = True, tie: str = REGION_COL
) -> DataFrame:
    """The row with the largest or smallest value; the first name wins a tie."""
    order = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    return indicators.filter(F.col(column).isNotNull()).orderBy(order, tie).limit(1)


def ranked(indicators: DataFrame, column: str = SPEND_COL) -> DataFrame:
    """Largest first, missing values last."""
    return indicators.orderBy(F.col(column).desc_nulls_last(), REGION_COL)


def indicator_table(indicators: DataFrame, lang: str = "ES") -> DataFrame:
    """The displayed table with its 1..n index.

    One row per territory of one year, so the unpartitioned window sorts a
    list as long as the region dimension.
    """
    index = F.row_number().over(W.orderBy(REGION_COL)).alias("index")
    return localised(indicators.select(index, REGION_COL, SPEND_COL, LICENCES_COL), lang)
