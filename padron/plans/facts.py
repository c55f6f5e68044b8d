"""Statistics-shaped facts out of the order and line tables, and their SQL twins.

Licences: orders counted per customer nation, year and priority.
Spend: mean line price per supplier nation and ship year.
The two sides spell a region differently, as the real sources do.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from padron.functions.numbers import format_number_es
from padron.lookups import (
    LICENCE_FILE,
    LICENCES_COL,
    REGION_COL,
    SPEND_COL,
    SPEND_FILE,
    SPEND_INDICATOR,
)
from padron.operators.indicators import indicators_by_year
from padron.operators.regions import comma_to_parens
from padron.plans.registry import table

YEAR = 1998
NATIONS = 25

# Nation names are digits after a fixed word, so the alias list follows a rule.
NATION_ALIASES = tuple((f"nación {n} ", f"NATION_{n}, Región de") for n in range(NATIONS))


def in_years(column: str, years: Iterable[int] | None) -> Column:
    """Times of the years as ranges, which the scan can use to skip data."""
    if years is None:
        return F.lit(True)
    day = lambda year: F.lit(datetime(year, 1, 1))
    ranges = [(F.col(column) >= day(y)) & (F.col(column) < day(y + 1)) for y in years]
    return reduce(operator.or_, ranges, F.lit(False))


def order_counts(spark: SparkSession, sf: str, years: Iterable[int] | None = None) -> DataFrame:
    """Orders per nation, year, priority and status.

    Orders are counted per customer before the join, so a customer with very
    many orders is one row per kind of order by then.
    """
    per_customer = (
        table(spark, sf, "orders")
        .filter(in_years("o_orderdate", years))
        .groupBy(
            "o_custkey",
            F.year("o_orderdate").alias("periodo"),
            F.col("o_orderpriority").alias("prioridad"),
            F.col("o_orderstatus").alias("estado"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "periodo", "prioridad", "estado")
        .agg(F.sum("n").alias("n"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "periodo", "prioridad", "estado", "n")
    )


ORDER_COUNTS_SQL = """
order_counts AS (
  SELECT n_name, year(o_orderdate) AS periodo, o_orderpriority AS prioridad,
         o_orderstatus AS estado, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)
"""


def licences(
    spark: SparkSession, sf: str, years: Iterable[int] | None = None, year_type: str = "string"
) -> DataFrame:
    """Raw licence table: every priority and TOTAL, every region and TOTAL, as text.

    A year kept as a number needs no parsing per row.
    """
    counts = order_counts(spark, sf, years)
    cells = counts.groupingSets(
        [
            [F.col("periodo"), F.col("prioridad"), F.col("n_name")],
            [F.col("periodo"), F.col("n_name")],
            [F.col("periodo")],
        ],
        F.col("periodo"),
        F.col("prioridad"),
        F.col("n_name"),
    ).agg(F.sum("n").alias("n"))
    return cells.select(
        F.coalesce("prioridad", F.lit("TOTAL")).alias("Federación"),
        F.coalesce(F.concat("n_name", F.lit(", Región de")), F.lit("TOTAL")).alias(
            "Comunidad autónoma"
        ),
        F.col("periodo").cast(year_type).alias("periodo"),
        format_number_es(F.col("n").cast("double")).alias("Total"),
        F.lit(LICENCE_FILE).alias("archivo_origen"),
    )


def line_means(spark: SparkSession, sf: str, years: Iterable[int] | None = None) -> DataFrame:
    """Mean line price per supplier nation and ship year.

    Lines are summed per supplier and year before the join.
    """
    per_supplier = (
        table(spark, sf, "lineitem")
        .filter(in_years("l_shipdate", years))
        .groupBy("l_suppkey", F.year("l_shipdate").alias("periodo"))
        .agg(
            F.sum("l_extendedprice").alias("total"),
            F.count("l_extendedprice").alias("n"),
        )
    )
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "periodo")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "n_name",
            "periodo",
            F.try_divide("total", F.col("n").cast("double")).alias("mean"),
        )
    )


LINE_MEANS_SQL = """
line_means AS (
  SELECT n_name, year(l_shipdate) AS periodo,
         avg(l_extendedprice) AS mean
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL)
"""


def spend(
    spark: SparkSession, sf: str, years: Iterable[int] | None = None, year_type: str = "string"
) -> DataFrame:
    """Raw spend table, as text, with two decimals."""
    return line_means(spark, sf, years).select(
        F.lit(SPEND_INDICATOR).alias("Indicador"),
        F.concat("n_name", F.lit(" (Región de)")).alias("Comunidad autónoma"),
        F.col("periodo").cast(year_type).alias("periodo"),
        format_number_es(F.col("mean")).alias("Total"),
        F.lit(SPEND_FILE).alias("archivo_origen"),
    )


def indicators(spark: SparkSession, sf: str, years=None) -> DataFrame:
    """Region, year, licences and spend."""
    return indicators_by_year(
        licences(spark, sf, years, "int"),
        spend(spark, sf, years, "int"),
        years,
        mapping=comma_to_parens(F.col("ccaa_limpia")),
    )


def home(spark: SparkSession, sf: str, year: int = YEAR) -> DataFrame:
    return indicators(spark, sf, [year]).drop("periodo")


INDICATORS_SQL = f"""
WITH {ORDER_COUNTS_SQL}, {LINE_MEANS_SQL},
indicators AS (
  SELECT l.n_name || ', Región de' AS "{REGION_COL}", l.periodo,
         CAST(l.n AS DOUBLE) AS "{LICENCES_COL}",
         CAST(printf('%.2f', m.mean) AS DOUBLE) AS "{SPEND_COL}"
  FROM (SELECT n_name, periodo, sum(n) AS n FROM order_counts GROUP BY ALL) l
  JOIN line_means m ON l.n_name = m.n_name AND l.periodo = m.periodo),
home AS (SELECT * EXCLUDE (periodo) FROM indicators WHERE periodo = {YEAR})
"""


def es(number: str, digits: int = 2) -> str:
    """SQL for Spanish number text."""
    return f"translate(format('{{:,.{digits}f}}', {number}), ',.', '.,')"


ROUNDED_MEAN = "CAST(printf('%.2f', mean) AS DOUBLE)"


def es_any(number: str) -> str:
    """SQL for Spanish number text, without decimals for whole values."""
    return f"CASE WHEN ({number}) = floor({number}) THEN {es(number, 0)} ELSE {es(number)} END"
