"""Columns, filters, regions, and the home indicators."""

import pytest
from pyspark.sql import functions as F

from padron.lookups import EXCLUDED_REGIONS, REGIONS, SPEND_INDICATOR
from padron.operators import columns, contracts, filters, indicators, regions

PARENS = {
    "Asturias, Principado de": "Asturias (Principado de)",
    "Balears, Illes": "Balears (Illes)",
    "Madrid, Comunidad de": "Madrid (Comunidad de)",
    "Murcia, Región de": "Murcia (Región de)",
    "Navarra, Comunidad Foral de": "Navarra (Comunidad Foral de)",
    "Rioja, La": "Rioja (La)",
}
LICENCE_COLS = "`Federación` string, `Comunidad autónoma` string, periodo string, Total string, archivo_origen string"
SPEND_COLS = "Indicador string, `Comunidad autónoma` string, periodo string, Total string, archivo_origen string"


def licence_rows(years=(2023,)):
    rows = []
    for year in years:
        for i, name in enumerate([*REGIONS, *EXCLUDED_REGIONS, None]):
            rows.append(("TOTAL", name, str(year), f"{i + 1}.000", "federado_01.csv"))
            rows.append(("FÚTBOL", name, str(year), "7", "federado_01.csv"))
            rows.append(("TOTAL", name, str(year), "9", "federado_02.csv"))
    return rows


def spend_rows(years=(2023,)):
    rows = []
    for year in years:
        for i, name in enumerate([*REGIONS, "TOTAL", None]):
            name = PARENS.get(name, name)
            rows.append((SPEND_INDICATOR, name, f"{year}.0", f"{200 + i},50", "gasto_03.csv"))
            rows.append(("Otro", name, str(year), "1", "gasto_03.csv"))
            rows.append((SPEND_INDICATOR, name, str(year), "1", "gasto_01.csv"))
    return rows


@pytest.fixture
def sources(spark):
    return (
        spark.createDataFrame(licence_rows((2022, 2023)), LICENCE_COLS),
        spark.createDataFrame(spend_rows((2022, 2023, 2024)), SPEND_COLS),
    )


def test_home_has_all_regions(sources):
    rows = {r.CCAA: r for r in indicators.home_indicators(*sources, 2023).collect()}
    assert set(rows) == set(REGIONS)
    assert rows["Murcia, Región de"].Licencias_Federadas == 14000.0
    assert rows["Murcia, Región de"].Gasto_Promedio_Hogar_Eur == 213.5
    assert indicators.home_indicators(*sources, 2005).count() == 0


def test_damaged_headers_and_cells_give_the_same_home(spark, sources):
    good = sorted(indicators.home_indicators(*sources, 2023).collect())
    broken = [
        df.toDF(*[c.encode("utf-8").decode("latin-1") for c in df.columns]).withColumn(
            "Comunidad autÃ³noma", F.decode(F.encode("Comunidad autÃ³noma", "UTF-8"), "ISO-8859-1")
        )
        for df in sources
    ]
    assert sorted(indicators.home_indicators(*broken, 2023).collect()) == good


def test_copies_merge_and_contradictions_are_named(spark, sources):
    licences, spend = sources
    copied = licences.unionByName(licences).unionByName(licences)
    once = sorted(indicators.home_indicators(licences, spend, 2023).collect())
    assert sorted(indicators.home_indicators(copied, spend, 2023).collect()) == once
    other = licences.filter("`Comunidad autónoma` = 'Galicia'").withColumn("Total", F.lit("1"))
    mixed = licences.unionByName(other)
    rows = indicators.home_indicators(mixed, spend, 2023).collect()
    assert len(rows) == len(once) + 1 and set(once) < set(rows)
    side = indicators.licence_side(mixed, [2023])
    found = indicators.contradictions(side, "Licencias_Federadas").collect()
    assert [(r.periodo, r["values"], r.lowest) for r in found] == [(2023, 2, 1.0)]
    clean = indicators.contradictions(indicators.licence_side(licences), "Licencias_Federadas")
    assert clean.isEmpty()


def test_sums_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(1e-7,), (3e-7,), (None,)], "v double")
    assert df.agg(indicators.mean_of(F.col("v")).alias("m")).first().m == pytest.approx(2e-7)
    big = spark.createDataFrame([(1e22,), (2e30,)], "v double")
    assert big.agg(indicators.total_of(F.col("v")).alias("t")).first().t == pytest.approx(2e30)
    none = spark.createDataFrame([], "v double")
    assert none.agg(indicators.total_of(F.col("v")).alias("t")).first().t == 0.0


def test_year_domain_meets_as_distinct_years(spark):
    left = spark.range(1000).select((F.col("id") % 5 + 2000).alias("periodo"))
    right = spark.range(1000).select((F.col("id") % 3 + 2002).alias("periodo"))
    found = filters.year_domain(left, right)
    assert [r.periodo for r in found.collect()] == [2004, 2003, 2002]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = filters.year_domain(left, right)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = plan[plan.index("Join LeftSemi") :]
    assert below.count("Aggregate [periodo") == 2


def test_yearly_report(sources):
    rows = {r.periodo: r for r in indicators.yearly_report(
        indicators.indicators_by_year(*sources, [2006, 2022, 2023])).collect()}
    assert set(rows) == {2022, 2023}
    assert rows[2023].n_regions == 17 and rows[2023].regions == sorted(REGIONS)
    assert rows[2023].sum_licences == sum(range(1, 18)) * 1000.0
    assert rows[2023].avg_spend == 208.5


def test_kpis_and_ranking(spark):
    schema = "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas double"
    rows = [("B", 2.0, 5.0), ("A", 2.0, 100000.0), ("C", None, 1.0), ("D", 1.0, None)]
    df = spark.createDataFrame(rows, schema)
    kpi = indicators.kpis(df).first()
    assert (kpi.avg_spend, kpi.sum_licences, kpi.n_regions) == (5 / 3, 100006.0, 4)
    assert (kpi.spend_card, kpi.licences_card, kpi.regions_card) == ("€ 2", "0.1M", "4")
    assert indicators.kpis(df.limit(0)).count() == 0
    empty = indicators.kpis(df.select("CCAA", F.lit(None).cast("double").alias("Gasto_Promedio_Hogar_Eur"),
                                      F.lit(None).cast("double").alias("Licencias_Federadas"))).first()
    assert empty.avg_spend is None and empty.sum_licences == 0.0
    spend = "Gasto_Promedio_Hogar_Eur"
    assert indicators.extreme_row(df, spend).first().CCAA == "A"
    assert indicators.extreme_row(df, spend, largest=False).first().CCAA == "D"
    assert [r.CCAA for r in indicators.ranked(df).collect()] == ["A", "B", "D", "C"]
    table = indicators.indicator_table(df, "EN")
    assert table.columns == [
        "index", "Region", "Avg Household Spending Eur", "Federated Licenses",
    ]
    assert [(r["index"], r.Region) for r in table.collect()] == [(1, "A"), (2, "B"), (3, "C"), (4, "D")]


def test_null_rules(spark):
    df = spark.createDataFrame([("TOTAL",), ("Galicia",), (None,), ("Ceuta",)], "c string")
    values = lambda d: [r.c for r in d.collect()]
    assert values(df.filter(filters.not_in(F.col("c")))) == ["Galicia", None]
    assert values(df.filter(filters.differs(F.col("c"), "TOTAL"))) == ["Galicia", None, "Ceuta"]
    totals = spark.createDataFrame([("1",), ("..",), (" ",), (None,), ("x",)], "Total string")
    assert [r.Total for r in filters.drop_missing(totals).collect()] == ["1", "x"]
    assert [r.Total for r in filters.has_number(totals).collect()] == ["1"]


def test_domains_and_territory(spark):
    left = spark.createDataFrame([(2005,), (2006,), (2023,), (None,)], "periodo int")
    right = spark.createDataFrame([(2006,), (2023,), (2024,), (None,)], "periodo int")
    assert [r.periodo for r in filters.year_domain(left, right).collect()] == [2023, 2006]
    df = spark.createDataFrame([("Galicia",), ("Aragón",), ("TOTAL",), ("Galicia",)], "CCAA string")
    assert [r.territory for r in filters.territory_domain(df, lang="EN").collect()] == [
        "All Regions", "Aragón", "Galicia",
    ]
    assert filters.in_territory(df, "Todas las CCAA").count() == 4
    assert filters.in_territory(df, "All Regions").count() == 4
    assert filters.in_territory(df, "Galicia").count() == 2
    assert filters.containing(df, "CCAA", "lic").count() == 2


def test_coalesce_columns(spark):
    df = spark.createDataFrame([(None, "b", "c", "1"), ("a", "b", "c", "2")],
                               "`Nueva Comunidad autonoma` string, `Comunidad autÃ³noma` string,"
                               " otra string, `ï»¿Periodo` string")  # fmt: skip
    out = columns.coalesce_columns(
        df, {"ccaa": ["Comunidad autónoma"], "anio": ["periodo"], "nada": ["x y"]}
    )
    assert "nada" not in out.columns
    assert [(r.ccaa, r.anio) for r in out.collect()] == [("b", "1"), ("b", "2")]
    assert columns.alias_candidates(
        ["Nueva Comunidad autonoma", "Comunidad autónoma"], ["Comunidad autónoma"]
    ) == ["Comunidad autónoma", "Nueva Comunidad autonoma"]


def test_projection_helpers(spark):
    df = spark.createDataFrame([("﻿ a ", 1)], "`﻿ texto ` string, n int")
    clean = columns.clean_strings(df)
    assert clean.columns == ["texto", "n"] and clean.first().texto == "a"
    assert columns.project(clean, ["texto", "n"], ["n"]).columns == ["texto"]
    wide = spark.createDataFrame([("x", 1.0, 2)], "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long")
    assert columns.assistant_columns(wide).columns == ["CCAA", "Gasto Promedio Hogar Eur", "Licencias Federadas"]
    assert columns.localised(wide, "EN").columns[0] == "Region"
    assert columns.localised(wide, "FR").columns[0] == "CCAA"
    meta = columns.add_metadata(wide).first()
    assert (meta.anio, meta.fuente) == (2023, "gasto_y_federado_2023")


def test_region_names(spark):
    spellings = {
        "Castilla - La Mancha": "Castilla-La Mancha", "castilla-la mancha": "Castilla-La Mancha",
        "Asturias (Principado de)": "Asturias, Principado de", "MURCIA, REGION DE": "Murcia, Región de",
        "Galicia": "Galicia", "Francia": None,
    }
    df = spark.createDataFrame([(k,) for k in spellings], "n string")
    got = df.select("n", regions.canonical_region(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == spellings
    dim = regions.region_dimension(spark).collect()
    assert [r.canonical for r in dim] == list(REGIONS)
    assert {r.canonical: r.aliases for r in dim}["Cataluña"] == ["cataluna", "catalunya", "catalonia"]
    keys = spark.createDataFrame([("murcia, region de",), ("galicia",), (None,)], "k string")
    assert [r.o for r in keys.select(regions.harmonise(F.col("k")).alias("o")).collect()] == [
        "murcia (region de)", "galicia", None,
    ]
    mapping = spark.createDataFrame([("galicia", "x"), ("galicia", "x")], "from_key string, to_key string")
    joined = regions.harmonise_by_table(keys, "k", mapping, "o").collect()
    assert {r.k: r.o for r in joined} == {"murcia, region de": "murcia, region de", "galicia": "x", None: None}
    assert len(joined) == 3


def test_contract(spark):
    df = columns.add_metadata(spark.range(17))
    ok = contracts.contract_checks(df, ["id", "anio"], 17, {"anio": 2023, "fuente": columns.SOURCE_NAME}).first()
    assert ok.n_rows == 17 and all(ok[c] for c in ok.asDict() if c != "n_rows")
    bad = contracts.contract_checks(df.withColumn("anio", F.col("id")), ["nope"], 16, {"anio": 2023}).first()
    assert not any(bad[c] for c in bad.asDict() if c != "n_rows")
    assert contracts.distinct_counts(df, ["anio", "id"]).first().asDict() == {
        "anio_distinct": 1, "id_distinct": 17,
    }
