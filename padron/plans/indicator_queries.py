"""Home indicators and what is shown of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from padron.functions.numbers import round_even
from padron.lookups import LICENCES_COL, REGION_COL, SPEND_COL, SPEND_INDICATOR
from padron.operators import columns, contracts, filters, indicators, regions, sampling
from padron.plans import facts
from padron.plans.facts import INDICATORS_SQL, LINE_MEANS_SQL, ORDER_COUNTS_SQL, YEAR, es_any
from padron.plans.registry import register, table
from padron.session import scratch_dir
from padron.sources.files import write_partitioned

# Means are compared to six decimals: the last digits of a sum follow the order of addition.
R6 = "CAST(printf('%.6f', {}) AS DOUBLE)"
BOTH_SQL = f"WITH {ORDER_COUNTS_SQL}, {LINE_MEANS_SQL}"


@register("scan_parquet", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands FROM part")
def scan_parquet(spark, sf):
    return table(spark, sf, "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands")
    )


@register("project_drop", "SELECT p_partkey, p_name, p_brand FROM part")
def project_drop(spark, sf):
    return columns.project(
        table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_size"], drop=["p_size"]
    )


@register("rename_columns", 'SELECT r_regionkey AS clave, r_name AS "CCAA" FROM region')
def rename_columns(spark, sf):
    return columns.rename_columns(
        table(spark, sf, "region"), {"r_regionkey": "clave", "r_name": "CCAA", "no_such": "x"}
    )


@register("add_metadata", "SELECT *, 2023 AS anio, 'gasto_y_federado_2023' AS fuente FROM orders")
def add_metadata(spark, sf):
    return columns.add_metadata(table(spark, sf, "orders"))


@register(
    "contract_checks",
    "SELECT count(*) AS n_rows, true AS has_columns, count(*) = 10 * (SELECT count(*) FROM customer)"
    " AS rows_ok, count(*) = 1 + 10 * (SELECT count(*) FROM customer) AS other_rows_ok,"
    " true AS anio_constant, true AS anio_ok, min(o_custkey) = max(o_custkey) AS o_custkey_constant,"
    " bool_and(o_custkey = 1) AS o_custkey_ok, true AS fuente_constant, true AS fuente_ok,"
    " count(DISTINCT o_orderpriority) AS priorities FROM orders",
)
def contract_checks(spark, sf):
    """All checks in one pass; the expected number of rows is a scalar of another table."""
    orders = columns.add_metadata(table(spark, sf, "orders"))
    expected = table(spark, sf, "customer").agg((10 * F.count(F.lit(1))).alias("n")).scalar()
    checks = contracts.contract_checks(
        orders, ["o_orderkey", "o_totalprice", "anio", "fuente"], expected,
        {"anio": columns.SOURCE_YEAR, "fuente": columns.SOURCE_NAME, "o_custkey": 1},
        distinct={"o_orderpriority": "priorities"},
    )
    return checks.withColumn("other_rows_ok", F.col("n_rows") == expected + 1)


@register(
    "contract_on_write",
    "SELECT count(*) AS n_rows, true AS has_columns, true AS rows_ok, true AS anio_constant,"
    " true AS anio_ok, min(o_custkey) = max(o_custkey) AS o_custkey_constant,"
    " bool_and(o_custkey = 1) AS o_custkey_ok,"
    " count(*) FILTER (substr(md5('42:' || o_orderkey), 1, 8) < '33333333') AS test_examples,"
    " count(*) FILTER (substr(md5('42:' || o_orderkey), 1, 8) >= '33333333') AS train_examples"
    " FROM orders",
)
def contract_on_write(spark, sf):
    """Contract and manifest of a written table, gathered while it is written."""
    folder = scratch_dir(spark, "contract")
    rows = sampling.with_split(columns.add_metadata(table(spark, sf, "orders")), ["o_orderkey"], 0.2)
    return contracts.written_checked(
        rows, lambda df: write_partitioned(df, folder, "split"), ["o_orderkey", "anio"], None,
        {"anio": columns.SOURCE_YEAR, "o_custkey": 1},
        {f"{side}_examples": F.col("split") == side for side in ("test", "train")},
    )


@register(
    "home_filters",
    f"WITH {ORDER_COUNTS_SQL} SELECT 'TOTAL' AS federacion, n_name || ', Región de' AS region,"
    f" CAST(periodo AS VARCHAR) AS periodo, {es_any('CAST(sum(n) AS DOUBLE)')} AS total"
    f" FROM order_counts WHERE periodo = {YEAR} GROUP BY n_name, periodo",
)
def home_filters(spark, sf):
    kept = filters.equal_all(
        facts.licences(spark, sf, [YEAR]),
        periodo=str(YEAR), archivo_origen="federado_01.csv", Federación="TOTAL",
    ).filter(filters.not_in(F.col("Comunidad autónoma")))
    return kept.select(
        F.col("Federación").alias("federacion"), F.col("Comunidad autónoma").alias("region"),
        "periodo", F.col("Total").alias("total"),
    )


@register(
    "key_harmonise",
    f"WITH {ORDER_COUNTS_SQL} SELECT n_name || ', Región de' AS region,"
    " lower(n_name) || ' (region de)' AS ccaa_key, sum(n) AS n FROM order_counts"
    " GROUP BY n_name",
)
def key_harmonise(spark, sf):
    """Licence-side names to spend-side keys through a mapping table."""
    counts = facts.order_counts(spark, sf).groupBy("n_name").agg(F.sum("n").alias("n"))
    named = counts.select(
        F.concat("n_name", F.lit(", Región de")).alias("region"), "n"
    ).withColumn("key", regions.region_key(F.col("region")))
    source = regions.region_key(F.concat("n_name", F.lit(", Región de")))
    mapping = table(spark, sf, "nation").select(
        source.alias("from_key"), regions.comma_to_parens(source).alias("to_key")
    )
    return regions.harmonise_by_table(named, "key", mapping, "ccaa_key").drop("key")


HOME_COLS = f'"{REGION_COL}", "{LICENCES_COL}", "{SPEND_COL}"'


@register("home_indicators", f"{INDICATORS_SQL} SELECT {HOME_COLS} FROM home")
def home_indicators(spark, sf):
    return facts.home(spark, sf)


@register(
    "yearly_report",
    f"""{INDICATORS_SQL} SELECT periodo, count(*) AS n_regions,
    {R6.format(f'avg("{SPEND_COL}")')} AS avg_spend, sum("{LICENCES_COL}") AS sum_licences,
    string_agg("{REGION_COL}", '|' ORDER BY "{REGION_COL}") AS regions
    FROM indicators GROUP BY periodo""",
)
def yearly_report(spark, sf):
    report = indicators.yearly_report(facts.indicators(spark, sf))
    return report.withColumns(
        {"regions": F.array_join("regions", "|"), "avg_spend": round_even(F.col("avg_spend"), 6)}
    )


@register(
    "territory_filter",
    f"""{INDICATORS_SQL} SELECT 'one' AS choice, {HOME_COLS} FROM home
    WHERE "{REGION_COL}" = 'NATION_7, Región de'
    UNION ALL SELECT 'all', {HOME_COLS} FROM home""",
)
def territory_filter(spark, sf):
    home = facts.home(spark, sf)
    one = filters.in_territory(home, "NATION_7, Región de").withColumn("choice", F.lit("one"))
    everything = filters.in_territory(home, "Todas las CCAA").withColumn("choice", F.lit("all"))
    return one.unionByName(everything)


@register(
    "year_domain",
    "SELECT year(o_orderdate) AS periodo FROM orders INTERSECT"
    " SELECT year(l_shipdate) FROM lineitem",
)
def year_domain(spark, sf):
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("periodo"))
    lines = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("periodo"))
    return filters.year_domain(orders, lines)


@register(
    "territory_domain",
    f"WITH {ORDER_COUNTS_SQL} SELECT 0 AS prio, 'Todas las CCAA' AS territory UNION ALL"
    " SELECT DISTINCT 1, n_name || ', Región de' FROM order_counts",
)
def territory_domain(spark, sf):
    licences = facts.licences(spark, sf).withColumnRenamed("Comunidad autónoma", REGION_COL)
    return filters.territory_domain(licences)


KPI_SQL = f"""
{R6.format(f'avg("{SPEND_COL}")')} AS avg_spend, sum("{LICENCES_COL}") AS sum_licences,
count(*) AS n_regions"""


KPI_SUMMARY_SQL = f"""{INDICATORS_SQL} SELECT *, '€ ' || printf('%.0f', avg_spend) AS spend_card,
    CASE WHEN sum_licences > 1e5 THEN printf('%.1f', sum_licences / 1e6) || 'M'
         ELSE format('{{:,.0f}}', sum_licences) END AS licences_card,
    CAST(n_regions AS VARCHAR) AS regions_card
    FROM (SELECT {KPI_SQL} FROM home) WHERE n_regions > 0"""


@register("kpi_summary", KPI_SUMMARY_SQL)
def kpi_summary(spark, sf):
    cards = indicators.kpis(facts.home(spark, sf))
    return cards.withColumn("avg_spend", round_even(F.col("avg_spend"), 6))


def _extreme(name: str, column: str, largest: bool) -> None:
    order = "DESC" if largest else "ASC"

    @register(
        name,
        f'{INDICATORS_SQL} SELECT {HOME_COLS} FROM home ORDER BY "{column}" {order} NULLS LAST,'
        f' "{REGION_COL}" LIMIT 1',
    )
    def query(spark, sf):
        return indicators.extreme_row(facts.home(spark, sf), column, largest)


_extreme("argmax_spend", SPEND_COL, True)
_extreme("argmin_spend", SPEND_COL, False)
_extreme("argmax_licences", LICENCES_COL, True)


@register(
    "ranked_regions",
    f'{INDICATORS_SQL} SELECT {HOME_COLS} FROM home ORDER BY "{SPEND_COL}" DESC',
)
def ranked_regions(spark, sf):
    return indicators.ranked(facts.home(spark, sf))


def _table_sql(region: str, spend: str, licences: str) -> str:
    return (
        f'{INDICATORS_SQL} SELECT row_number() OVER (ORDER BY "{REGION_COL}") AS index,'
        f' "{REGION_COL}" AS "{region}", "{SPEND_COL}" AS "{spend}",'
        f' "{LICENCES_COL}" AS "{licences}" FROM home'
    )


@register(
    "indicator_table", _table_sql("CCAA", "Gasto Promedio Hogar Eur", "Licencias Federadas")
)
def indicator_table(spark, sf):
    return indicators.indicator_table(facts.home(spark, sf), "ES")


@register(
    "localised_table", _table_sql("Region", "Avg Household Spending Eur", "Federated Licenses")
)
def localised_table(spark, sf):
    return indicators.indicator_table(facts.home(spark, sf), "EN")


@register(
    "spend_readings",
    f"{BOTH_SQL} SELECT '{SPEND_INDICATOR}' AS indicador, n_name || ' (Región de)' AS region,"
    f" CAST(periodo AS VARCHAR) AS periodo, {es_any('mean')} AS total FROM line_means",
)
def spend_readings(spark, sf):
    raw = facts.spend(spark, sf)
    return raw.select(
        F.col("Indicador").alias("indicador"), F.col("Comunidad autónoma").alias("region"),
        "periodo", F.col("Total").alias("total"),
    )
