"""Readers, writers and lake operators on files written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padron.functions.chat import chat_template
from padron.functions.numbers import format_number_es, round_even
from padron.functions.periods import year_cast
from padron.lookups import LICENCE_FILE, SPEND_FILE
from padron.operators import generators, indicators, labels
from padron.operators.columns import add_metadata
from padron.operators.regions import comma_to_parens
from padron.plans.facts import (
    LINE_MEANS_SQL,
    ORDER_COUNTS_SQL,
    ROUNDED_MEAN,
    YEAR,
    es_any,
    line_means,
    order_counts,
)
from padron.plans.facts import licences as raw_licences
from padron.plans.facts import spend as raw_spend
from padron.plans.indicator_queries import KPI_SUMMARY_SQL
from padron.plans.moderation_queries import labelled
from padron.plans.record_queries import (
    EXCHANGES_SQL,
    TRIM,
    capped_sql,
    general_pairs,
    template_sql,
)
from padron.plans.registry import register, table
from padron.session import scratch_dir
from padron.sources import files, lake

PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register(
    "scan_csv_semicolon",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,"
    f" CAST(p_size AS VARCHAR) AS p_size, {es_any('p_retailprice')} AS p_retailprice FROM part",
)
def scan_csv_semicolon(spark, sf):
    path = scratch_dir(spark, "semicolon")
    parts = table(spark, sf, "part").withColumn(
        "p_retailprice", format_number_es(F.col("p_retailprice"))
    )
    files.write_semicolon(parts.select(*PART_COLUMNS), path)
    return files.read_semicolon(spark, path, PART_COLUMNS)


@register(
    "scan_csv_typed",
    'SELECT c_name || \', "\' || c_mktsegment || \'"\' AS "CCAA",'
    ' c_acctbal AS "Gasto_Promedio_Hogar_Eur", c_custkey AS "Licencias_Federadas",'
    ' CAST(c_nationkey AS BIGINT) AS "Poblacion_Activa_Dep" FROM customer',
)
def scan_csv_typed(spark, sf):
    """Names with commas and quotes in the layout of the consolidated file."""
    path = scratch_dir(spark, "comma")
    named = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    rows = table(spark, sf, "customer").select(
        named.alias("CCAA"),
        F.col("c_acctbal").alias("Gasto_Promedio_Hogar_Eur"),
        F.col("c_custkey").alias("Licencias_Federadas"),
        F.col("c_nationkey").cast("long").alias("Poblacion_Activa_Dep"),
    )
    files.write_csv(rows, path)
    return files.read_comma(spark, path)


@register("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl(spark, sf):
    path = scratch_dir(spark, "jsonl")
    files.write_jsonl(table(spark, sf, "conversations"), path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@register(
    "sink_jsonl",
    f"WITH {EXCHANGES_SQL} SELECT 3 AS turns, {template_sql('question', 'answer')} AS text"
    " FROM exchanges",
)
def sink_jsonl(spark, sf):
    """Chat records written as lines and read back."""
    path = scratch_dir(spark, "records")
    pairs = general_pairs(spark, sf)
    files.write_jsonl(
        pairs.select(generators.chat_record(F.col("question"), F.col("answer")).alias("messages")),
        path,
    )
    records = files.read_jsonl(spark, path, files.CHAT_SCHEMA)
    return records.select(
        F.size("messages").alias("turns"), chat_template(F.col("messages")).alias("text")
    )


@register("sink_csv", "SELECT text, toxic AS label FROM documents JOIN labels USING (doc_id)")
def sink_csv(spark, sf):
    """Labelled texts, line breaks and quotes included, written and read back."""
    path = scratch_dir(spark, "labelled")
    files.write_csv(labelled(spark, sf).select("text", "label"), path)
    return files.read_labelled_csv(spark, path)


@register(
    "labelled_set",
    f"""WITH rows AS (SELECT {TRIM.format('text')} AS text, toxic AS label
  FROM documents JOIN labels USING (doc_id))
SELECT 'csv' AS format, * FROM rows UNION ALL SELECT 'jsonl', * FROM rows""",
)
def labelled_set(spark, sf):
    """The labelled set shuffled and written in both formats, both read back."""
    path = scratch_dir(spark, "labelled-set")
    rows = labelled(spark, sf)
    parts = [(rows.filter(F.col("label") == value), value) for value in (0, 1)]
    whole = labels.labelled_union(*parts, keep=["doc_id"])
    labels.write_labelled_set(whole, ["doc_id"], f"{path}/csv", f"{path}/jsonl")
    as_csv = files.read_labelled_csv(spark, f"{path}/csv").withColumn("format", F.lit("csv"))
    as_lines = files.read_jsonl(spark, f"{path}/jsonl", files.LABELLED_SCHEMA)
    return as_csv.unionByName(as_lines.withColumn("format", F.lit("jsonl")))


@register(
    "sink_partitioned",
    "SELECT year(o_orderdate) AS anio, 'orders' AS fuente, count(*) AS n,"
    " CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
)
def sink_partitioned(spark, sf):
    """Orders in one folder per year, read back by folder."""
    path = scratch_dir(spark, "partitioned")
    orders = add_metadata(table(spark, sf, "orders"), source="orders").withColumn(
        "anio", F.year("o_orderdate")
    )
    files.write_partitioned(orders, path, "anio")
    return (
        files.read_parquet(spark, path)
        .groupBy("anio", "fuente")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        )
    )


def lake_root(spark: SparkSession, sf: str) -> str:
    """A lake of differing layouts, written for the query that asks for it."""
    return write_lake(spark, sf, scratch_dir(spark, "lake") + "/raw")


def write_lake(spark: SparkSession, sf: str, root: str) -> str:
    """Seven sources: five with records, one without a total, one without a generator."""
    federated = order_counts(spark, sf).select(
        F.col("prioridad").alias("Federación"),
        F.col("estado").alias("Sexo"),
        F.col("n_name").alias("Comunidad autónoma"),
        F.col("periodo").cast("string").alias("periodo"),
        format_number_es(F.col("n").cast("double")).alias("Total"),
    )
    households = line_means(spark, sf).select(
        F.lit("Gasto medio").alias("Indicador"),
        F.col("n_name").alias("Comunidad autónoma"),
        F.col("periodo").cast("string").alias("periodo"),
        format_number_es(F.col("mean")).alias("Total"),
    )
    companies = table(spark, sf, "part").select(
        F.col("p_type").alias("Indicador"),
        F.col("p_brand").alias("Actividad económica"),
        F.when(F.col("p_size") > 25, F.lit("..")).otherwise(
            format_number_es(F.col("p_retailprice"))
        ).alias("Total"),
    )
    early = table(spark, sf, "supplier").select(
        F.col("s_name").alias("Comunidad autónoma y tamaño de municipio"),
        F.col("s_nationkey").cast("string").alias("Indicador"),
        F.col("s_acctbal").cast("string").alias("Total"),
    )
    late = table(spark, sf, "customer").select(
        F.col("c_name").alias("Comunidad autónoma-tamaño de municipio"),
        F.col("c_mktsegment").alias("Indicador"),
        F.col("c_acctbal").cast("string").alias("Total"),
    )
    no_total = table(spark, sf, "region").select(
        F.col("r_name").alias("Indicador"), F.col("r_regionkey").cast("string").alias("periodo")
    )
    unrouted = table(spark, sf, "nation").select(
        F.col("n_name").alias("Indicador"), F.col("n_nationkey").cast("string").alias("Total")
    )
    for name, df in {
        "Deporte_Federado/federado_01.csv": federated,
        "Gasto_Hogares/gasto_01.csv": households,
        "Empresa_Deporte/D6F01001.csv": companies,
        "Habitos_Deportivos/2022/Practica_Deportiva/practica_03.csv": early,
        "Habitos_Deportivos/2024_2025/Practica_Deportiva/practica_03.csv": late,
        "Empleo_Deporte/Medias_Anuales/sin_total.csv": no_total,
        "Otros/otros.csv": unrouted,
    }.items():
        files.write_semicolon(df, f"{root}/{name}")
    return root


SOURCES_SQL = f"""
{ORDER_COUNTS_SQL}, {LINE_MEANS_SQL},
sources AS (
  SELECT 'deporte_federado' AS category, NULL AS wave, 'federado_01.csv' AS file_name, n AS value,
    true AS filled FROM order_counts
  UNION ALL SELECT 'gasto_hogares', NULL, 'gasto_01.csv', CAST(printf('%.2f', mean) AS DOUBLE),
    true FROM line_means
  UNION ALL SELECT 'empresa_deporte', NULL, 'D6F01001.csv', p_retailprice, p_size <= 25 FROM part
  UNION ALL SELECT 'habitos_deportivos', '2022', 'practica_03.csv', s_acctbal, true FROM supplier
  UNION ALL SELECT 'habitos_deportivos', '2024_2025', 'practica_03.csv', c_acctbal, true
    FROM customer
  UNION ALL SELECT 'empleo_deporte', NULL, 'sin_total.csv', NULL, false FROM region
  UNION ALL SELECT 'otros', NULL, 'otros.csv', n_nationkey, true FROM nation)
"""


@register(
    "lake_discover",
    f"WITH {SOURCES_SQL} SELECT DISTINCT category, wave, file_name,"
    " coalesce(substr(wave, 1, 4), 'N/D') AS year FROM sources",
)
def lake_discover(spark, sf):
    """Sources of the lake; written files are parts of a source."""
    found = lake.discover(spark, lake_root(spark, sf))
    return found.select("category", "wave", "file_name", "year").distinct()


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return lake.load_lake(spark, lake_root(spark, sf))


@register(
    "lake_union",
    f"WITH {SOURCES_SQL} SELECT category, wave, file_name, count(*) AS n, count(value) FILTER"
    " (filled) AS with_total, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (filled) AS DOUBLE)"
    " AS total FROM sources GROUP BY ALL",
)
def lake_union(spark, sf):
    rows = lake.good_files(facts(spark, sf))
    return rows.groupBy("category", "wave", "file_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("total_num").alias("with_total"),
        F.sum(F.col("total_num").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@register(
    "schema_profile",
    """SELECT 'deporte_federado' AS category,
    'Federación, Sexo, Comunidad autónoma, periodo, Total' AS columns
UNION ALL SELECT 'gasto_hogares', 'Indicador, Comunidad autónoma, periodo, Total'
UNION ALL SELECT 'empresa_deporte', 'Indicador, Actividad económica, Total'
UNION ALL SELECT 'habitos_deportivos', 'Comunidad autónoma y tamaño de municipio, Indicador, Total'
UNION ALL SELECT 'empleo_deporte', 'Indicador, periodo'
UNION ALL SELECT 'otros', 'Indicador, Total'""",
)
def schema_profile(spark, sf):
    return lake.schema_profile(spark, lake_root(spark, sf))


@register(
    "ingest_report",
    f"""WITH {SOURCES_SQL} SELECT category, wave, file_name,
  CASE category WHEN 'otros' THEN 'SKIP_CATEGORY' WHEN 'empleo_deporte' THEN 'SKIP_NO_TOTAL'
  ELSE 'OK' END AS status, count(*) AS n,
  CAST(coalesce(count(value) FILTER (filled), 0) AS BIGINT) AS with_total
  FROM sources GROUP BY ALL""",
)
def ingest_report(spark, sf):
    """Status per source; its part files are summed."""
    root = lake_root(spark, sf)
    listed = lake.manifest(spark, root)
    report = lake.ingest_report(listed, lake.load_lake(spark, root, listed=listed))
    return report.groupBy("category", "wave", "file_name", "status").agg(
        F.sum("rows").alias("n"), F.sum("with_total").alias("with_total")
    )


def _habits_sql(zone: str, what: str, value: str, wave: str, source: str) -> str:
    year = wave[:4]
    return f"""SELECT concat_ws('|', {zone}, {what}, '{year}', {value}) AS k,
  'raw/Habitos_Deportivos/{wave}/Practica_Deportiva/practica_03.csv' AS origin,
  '¿Cuál fue el porcentaje de ''' || {what} || ''' en ' || {zone} || ' (encuesta {year})?'
    AS question,
  'Según la encuesta de hábitos deportivos de {year}, el indicador ''' || {what} || ''' en '
    || {zone} || ' fue del ' || {es_any(value)} || '%.' AS answer FROM {source}"""


TRAINING_SQL = f"""
WITH {ORDER_COUNTS_SQL}, {LINE_MEANS_SQL}, {EXCHANGES_SQL},
federated AS (SELECT concat_ws('|', prioridad, n_name, periodo, estado,
    {es_any('CAST(n AS DOUBLE)')}) AS k, 'raw/Deporte_Federado/federado_01.csv' AS origin,
  '¿Cuántos deportistas de ' || prioridad || ' (' || lower(estado) || ') en ' || n_name || ' en '
    || periodo || '?' AS question,
  'El número de deportistas de la federación ' || prioridad || ' en ' || n_name
    || ' en el periodo ' || periodo || ' fue de ' || {es_any('CAST(n AS DOUBLE)')} || '.' AS answer
  FROM order_counts),
households AS (SELECT concat_ws('|', 'Gasto medio', n_name, periodo, {es_any('mean')}) AS k,
  'raw/Gasto_Hogares/gasto_01.csv' AS origin,
  '¿Cuál fue el gasto medio en ' || n_name || ' en ' || periodo || '?' AS question,
  'El gasto medio en ' || n_name || ' en ' || periodo || ' fue de ' || {es_any(ROUNDED_MEAN)} || '.'
    AS answer FROM line_means),
companies AS (SELECT concat_ws('|', p_type, p_brand, {es_any('p_retailprice')}) AS k,
  'raw/Empresa_Deporte/D6F01001.csv' AS origin,
  '¿Qué valor tuvo ''' || p_type || ''' en la actividad ' || p_brand || ' en N/D?' AS question,
  'El indicador ''' || p_type || ''' para la actividad económica ' || p_brand
    || ' en N/D fue de ' || {es_any('p_retailprice')} || '.' AS answer FROM part
  WHERE p_size <= 25),
early AS ({_habits_sql('s_name', 's_nationkey', 's_acctbal', '2022', 'supplier')}),
late AS ({_habits_sql('c_name', 'c_mktsegment', 'c_acctbal', '2024_2025', 'customer')}),
pairs AS (
  SELECT 'conv ' || conv_id || ':' || turn AS origin, question, answer FROM exchanges
  UNION ALL {capped_sql('FROM federated', 'origin')} UNION ALL {capped_sql('FROM households', 'origin')}
  UNION ALL {capped_sql('FROM companies', 'origin')} UNION ALL {capped_sql('FROM early', 'origin')}
  UNION ALL {capped_sql('FROM late', 'origin')})
SELECT row_number() OVER (ORDER BY md5('42:' || origin || '|' || question || '|' || answer),
    origin, question, answer) - 1 AS position, {template_sql('question', 'answer')} AS text
FROM pairs
"""


@register("training_set", TRAINING_SQL)
def training_set(spark, sf):
    """The whole factory: lake, generators, general pairs, shuffle, records."""
    # The cap holds per source; its place below the lake names it in every run alike.
    origin = lake.below_raw(F.col("source_path"))
    rows = lake.good_files(facts(spark, sf)).withColumn("origin", origin)
    generated = generators.lake_pairs(rows, ["source_path", "origin"])
    pairs = generators.union_pairs(general_pairs(spark, sf), generated)
    records = generators.training_set(pairs)
    return records.select("position", chat_template(F.col("messages")).alias("text"))


@register("lake_home", KPI_SUMMARY_SQL)
def lake_home(spark, sf):
    """From CSV files to the cards: load, write two clean tables by year, read one year, join."""
    root = scratch_dir(spark, "lake-home")
    for name, df in {
        f"Deporte_Federado/{LICENCE_FILE}": raw_licences(spark, sf).drop("archivo_origen"),
        f"Gasto_Hogares/{SPEND_FILE}": raw_spend(spark, sf).drop("archivo_origen"),
    }.items():
        files.write_semicolon(df, f"{root}/raw/{name}")
    tables = lake.indicator_tables(lake.load_lake(spark, f"{root}/raw"))
    clean = []
    for name, df in zip(("licences", "spend"), tables, strict=True):
        by_year = df.withColumn("anio", year_cast(F.col("periodo")))
        files.write_partitioned(by_year, f"{root}/{name}", "anio")
        read = files.read_parquet(spark, f"{root}/{name}").filter(F.col("anio") == YEAR)
        clean.append(read.drop("anio"))
    mapping = comma_to_parens(F.col("ccaa_limpia"))
    cards = indicators.kpis(indicators.home_indicators(*clean, YEAR, mapping))
    return cards.withColumn("avg_spend", round_even(F.col("avg_spend"), 6))


def write_raw(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """``;`` files whose cells are written as they are, well-formed or not: a line is one cell."""
    line = F.concat_ws(lake.SEP, *[F.col(c) for c in df.columns]).alias(lake.SEP.join(df.columns))
    df.select(line).write.options(header=True, sep="\t", quote="", encoding=encoding).csv(path)


@register(
    "lake_quarantine",
    """SELECT 'latin.csv' AS file_name, 'not UTF-8' AS reason,
  c_name || ';Nataci' || chr(65533) || 'n' AS content
  FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'largo.csv', 'more cells than the header', s_name || ';' || s_nationkey || ';de más'
  FROM supplier WHERE s_nationkey < 5
UNION ALL SELECT 'abierto.csv', 'quote never closed', '"' || n_name || ';0'
  FROM nation WHERE n_nationkey = 7""",
)
def lake_quarantine(spark, sf):
    """Rows that bar or mark their files: Latin-1 bytes, surplus cells, an open quote."""
    root = scratch_dir(spark, "quarantine") + "/raw"
    sport = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Natación")).otherwise(F.lit("Remo"))
    latin = table(spark, sf, "customer").select(
        F.col("c_name").alias("Indicador"), sport.alias("Total")
    )
    more = F.when(F.col("s_nationkey") < 5, F.lit(";de más")).otherwise(F.lit(""))
    longer = table(spark, sf, "supplier").select(
        F.col("s_name").alias("Indicador"),
        F.concat(F.col("s_nationkey").cast("string"), more).alias("Total"),
    )
    quote = F.when(F.col("n_nationkey") == 7, F.lit('"')).otherwise(F.lit(""))
    opened = table(spark, sf, "nation").select(
        F.concat(quote, F.col("n_name")).alias("Indicador"), F.lit("0").alias("Total")
    )
    write_raw(latin, f"{root}/Gasto_Hogares/latin.csv", "ISO-8859-1")
    write_raw(longer, f"{root}/Gasto_Hogares/largo.csv")
    write_raw(opened, f"{root}/Gasto_Hogares/abierto.csv")
    files.write_semicolon(latin, f"{root}/Gasto_Hogares/sano.csv")
    named = lake.lineage(F.col("file_path"))["file_name"]
    return lake.quarantine(spark, root).select(named.alias("file_name"), "reason", "content")


@register(
    "lake_line_breaks",
    f"""SELECT doc_id, length(t) AS n_chars, length(t) - length(replace(t, chr(10), '')) AS breaks,
  md5(t) AS digest FROM (SELECT doc_id, {TRIM.format('text')} AS t FROM documents
  WHERE text NOT LIKE '%' || chr(13) || '%')""",
)
def lake_line_breaks(spark, sf):
    """Whole texts as cells under a header with a line break, through the lake and back."""
    root = scratch_dir(spark, "breaks") + "/raw"
    texts = table(spark, sf, "documents").where(~F.contains("text", F.lit("\r")))
    named = texts.select(
        F.col("text").alias("Texto\nlargo"), F.col("doc_id").cast("string").alias("Total")
    )
    files.write_semicolon(named, f"{root}/Gasto_Hogares/textos.csv")
    cell = F.col("Texto\nlargo")
    return lake.load_lake(spark, root).select(
        F.col("Total").cast("long").alias("doc_id"),
        F.char_length(cell).cast("long").alias("n_chars"),
        (F.char_length(cell) - F.char_length(F.replace(cell, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"),
        F.md5(cell).alias("digest"),
    )
