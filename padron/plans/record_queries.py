"""Samples, splits, chat records and generated pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from padron.functions import chat
from padron.functions.hashing import hex_threshold
from padron.functions.numbers import format_number_es
from padron.lookups import SAMPLE_CAP, SYSTEM_PROMPT
from padron.operators import conversations, generators, sampling
from padron.operators.qa import facts_digest
from padron.plans.facts import (
    INDICATORS_SQL,
    LINE_MEANS_SQL,
    ORDER_COUNTS_SQL,
    ROUNDED_MEAN,
    es_any,
    home,
    line_means,
    order_counts,
)
from padron.plans.registry import register, table
from padron.sources.files import split_manifest as manifest


@register(
    "capped_sample",
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER"
    f" (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= {SAMPLE_CAP}",
)
def capped_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.capped_sample(docs, ["source"], ["doc_id"])


@register(
    "capped_sample_large",
    "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER"
    " (PARTITION BY l_returnflag ORDER BY md5('42:' || l_orderkey || '|' || l_linenumber),"
    " l_orderkey, l_linenumber) <= 5000",
)
def capped_sample_large(spark, sf):
    """A cap beyond what ranks are limited to before a shuffle."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sampling.capped_sample(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber"], cap=5000)


@register(
    "seeded_shuffle",
    "SELECT o_orderkey, o_totalprice,"
    " row_number() OVER (ORDER BY md5('42:' || o_orderkey)) - 1 AS position FROM orders",
)
def seeded_shuffle(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.shuffled(orders, ["o_orderkey"])


def _split_sql(key: str, share: float) -> str:
    return (
        f"CASE WHEN substr(md5('42:' || {key}), 1, 8) < '{hex_threshold(share)}'"
        " THEN 'test' ELSE 'train' END"
    )


@register(
    "train_test_split",
    f"SELECT o_orderkey, {_split_sql('o_orderkey', 0.2)} AS split FROM orders",
)
def train_test_split(spark, sf):
    return sampling.with_split(
        table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], test_share=0.2
    )


@register(
    "exact_split",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey))"
    " <= ceil((SELECT count(*) FROM orders) * 0.1) THEN 'test' ELSE 'train' END AS split"
    " FROM orders",
)
def exact_split(spark, sf):
    """Sides of exact sizes, nine to one."""
    return sampling.with_exact_split(
        table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], test_share=0.1
    )


@register(
    "shard_assign",
    "SELECT o_orderkey, CAST(CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % 4"
    f" AS INTEGER) AS shard, {_split_sql('o_orderkey', 0.1)} AS split FROM orders",
)
def shard_assign(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    shards = sampling.with_shard(keys, ["o_orderkey"], workers=4)
    return sampling.with_split(shards, ["o_orderkey"], test_share=0.1)


@register(
    "split_manifest",
    "SELECT *, '{\"train_examples\":' || train_examples || ',\"test_examples\":' || test_examples"
    " || ',\"examples\":' || examples || ',\"epochs\":5,\"max_length\":128}' AS manifest FROM ("
    "SELECT count(*) FILTER (split = 'train') AS train_examples,"
    " count(*) FILTER (split = 'test') AS test_examples, count(*) AS examples,"
    " 5 AS epochs, 128 AS max_length"
    f" FROM (SELECT {_split_sql('doc_id', 0.2)} AS split FROM documents))",
)
def split_manifest(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    split = sampling.with_split(docs, ["doc_id"], test_share=0.2)
    return manifest(split, "split", {"epochs": 5, "max_length": 128})


@register(
    "fallback_fact",
    f"""{INDICATORS_SQL} SELECT "CCAA" AS region, "Gasto_Promedio_Hogar_Eur" AS spend,
    CAST("Licencias_Federadas" AS BIGINT) AS licences FROM home
    ORDER BY md5('0:' || "CCAA"), "CCAA" LIMIT 1""",
)
def fallback_fact(spark, sf):
    return facts_digest(home(spark, sf)).select("fallback.*")


@register(
    "chat_messages",
    "SELECT conv_id, count(*) AS n,"
    " string_agg(turn || ':' || role || ':' || text, chr(30) ORDER BY turn) AS messages"
    " FROM conversations GROUP BY conv_id",
)
def chat_messages(spark, sf):
    sessions = conversations.assemble(table(spark, sf, "conversations"))
    line = lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["text"])
    return sessions.select(
        "conv_id", F.size("messages").cast("long").alias("n"),
        F.array_join(F.transform("messages", line), "\x1e").alias("messages"),
    )


@register(
    "ordered_messages", "SELECT conv_id, turn AS position, role, text FROM conversations"
)
def ordered_messages(spark, sf):
    return conversations.ordered_messages(table(spark, sf, "conversations"))


TRIM = "trim({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
EXCHANGES_SQL = f"""
exchanges AS (SELECT u.conv_id, u.turn, {TRIM.format('u.text')} AS question,
                     {TRIM.format('a.text')} AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""


def _records(spark, sf):
    pairs = conversations.exchanges(table(spark, sf, "conversations"))
    return pairs.select(
        "conv_id", "turn", chat.chat_record(F.col("question"), F.col("answer")).alias("messages")
    )


@register(
    "chat_record",
    f"WITH {EXCHANGES_SQL} SELECT conv_id, turn, 'system,user,assistant' AS roles,"
    f" '{SYSTEM_PROMPT}' AS system, question, answer FROM exchanges",
)
def chat_record(spark, sf):
    content = F.col("messages.content")
    return _records(spark, sf).select(
        "conv_id", "turn", F.array_join("messages.role", ",").alias("roles"),
        content[0].alias("system"), content[1].alias("question"), content[2].alias("answer"),
    )


def template_sql(question: str, answer: str) -> str:
    turns = (("system", f"'{SYSTEM_PROMPT}'"), ("user", question), ("assistant", answer))
    return " || ".join(
        f"'<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>' || chr(10)"
        for role, text in turns
    )


@register(
    "chat_template",
    f"WITH {EXCHANGES_SQL} SELECT conv_id, turn, {template_sql('question', 'answer')} AS text"
    " FROM exchanges",
)
def chat_template(spark, sf):
    return _records(spark, sf).select(
        "conv_id", "turn", chat.chat_template(F.col("messages")).alias("text")
    )


def capped_sql(pairs: str, by: str) -> str:
    """SQL for the sample: the smallest hashes of the raw cells, column ``k``."""
    return (
        f"SELECT {by}, question, answer FROM ({pairs}) QUALIFY row_number() OVER"
        f" (PARTITION BY {by} ORDER BY md5('42:' || k), k) <= {SAMPLE_CAP}"
    )


def _sample_sql(ctes: str, pairs: str, by: str) -> str:
    return (f"WITH {ctes} " if ctes else "") + capped_sql(pairs, by)


FEDERATED_PAIRS = f"""
SELECT concat_ws('|', prioridad, n_name, periodo, estado, {es_any('CAST(n AS DOUBLE)')}) AS k,
  'federado_' || periodo || '.csv' AS file_name,
  '¿Cuántos deportistas de ' || prioridad || ' (' || lower(estado) || ') en ' || n_name || ' en '
    || periodo || '?' AS question,
  'El número de deportistas de la federación ' || prioridad || ' en ' || n_name
    || ' en el periodo ' || periodo || ' fue de ' || {es_any('CAST(n AS DOUBLE)')} || '.' AS answer
FROM order_counts"""


def federated_facts(spark, sf):
    return order_counts(spark, sf).select(
        F.concat(F.lit("federado_"), "periodo", F.lit(".csv")).alias("file_name"),
        F.col("prioridad").alias("Federación"),
        F.col("estado").alias("Sexo"),
        F.col("n_name").alias("Comunidad autónoma"),
        F.col("periodo").cast("string").alias("periodo"),
        format_number_es(F.col("n").cast("double")).alias("Total"),
    )


@register("qa_pairs_federated", _sample_sql(ORDER_COUNTS_SQL, FEDERATED_PAIRS, "file_name"))
def qa_pairs_federated(spark, sf):
    return generators.qa_pairs(federated_facts(spark, sf), "federated", ["file_name"])


SPEND_PAIRS = f"""
SELECT concat_ws('|', 'Precio Medio', p_brand, {es_any('p_retailprice')}) AS k,
  p_type AS file_name, '¿Cuál fue el precio medio para ''' || p_brand || ''' en N/D?'
  AS question,
  'El precio medio para ''' || p_brand || ''' en N/D fue de ' || {es_any('p_retailprice')} || '.'
  AS answer FROM part"""


@register("qa_pairs_spend", _sample_sql("", SPEND_PAIRS, "file_name"))
def qa_pairs_spend(spark, sf):
    facts = table(spark, sf, "part").select(
        F.col("p_type").alias("file_name"),
        F.lit("Precio Medio").alias("Indicador"),
        F.col("p_brand").alias("Tipo de bienes y servicios"),
        format_number_es(F.col("p_retailprice")).alias("Total"),
    )
    return generators.qa_pairs(facts, "spend", ["file_name"])


EMPLOYMENT_PAIRS = f"""
SELECT concat_ws('|', 'Saldo', c_nationkey, c_name, c_acctbal) AS k,
  c_mktsegment AS file_name,
  '¿Cuál fue el valor de ''Saldo'' para ' || c_name || ' en ' || c_nationkey || '?' AS question,
  'El indicador ''Saldo'' para el perfil ' || c_name || ' en ' || c_nationkey
    || ' registró un valor de ' || {es_any('c_acctbal')} || '.' AS answer FROM customer"""


@register("qa_pairs_employment", _sample_sql("", EMPLOYMENT_PAIRS, "file_name"))
def qa_pairs_employment(spark, sf):
    facts = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("file_name"),
        F.lit("Saldo").alias("Indicador"),
        F.col("c_name").alias("Sexo, grupo de edad y nivel de estudios"),
        F.col("c_nationkey").cast("string").alias("Periodo"),
        F.col("c_acctbal").cast("string").alias("Total"),
    )
    return generators.qa_pairs(facts, "employment", ["file_name"])


COMPANY_PAIRS = f"""
SELECT concat_ws('|', s_name, s_acctbal) AS k,
  s_nationkey AS file_name, '¿Qué valor tuvo ''empresas deportivas'' en la actividad '
    || s_name || ' en N/D?' AS question,
  'El indicador ''empresas deportivas'' para la actividad económica ' || s_name
    || ' en N/D fue de ' || {es_any('s_acctbal')} || '.' AS answer FROM supplier"""


@register("qa_pairs_company", _sample_sql("", COMPANY_PAIRS, "file_name"))
def qa_pairs_company(spark, sf):
    facts = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("file_name"),
        F.col("s_name").alias("Actividad económica"),
        F.col("s_acctbal").cast("string").alias("Total"),
    )
    return generators.qa_pairs(facts, "company", ["file_name"])


HABITS_PAIRS = f"""
SELECT concat_ws('|', lang, nullif(anio, 'N/D'), {es_any('CAST(n_chars AS DOUBLE)')}) AS k,
  source AS file_name, '¿Cuál fue el porcentaje de ''' || lang || ''' en España (encuesta '
    || anio || ')?' AS question,
  'Según la encuesta de hábitos deportivos de ' || anio || ', el indicador ''' || lang
    || ''' en España fue del ' || {es_any('CAST(n_chars AS DOUBLE)')} || '%.' AS answer
FROM (SELECT *, CASE WHEN lang = 'es' THEN '2022' ELSE 'N/D' END AS anio FROM documents)"""


@register("qa_pairs_habits", _sample_sql("", HABITS_PAIRS, "file_name"))
def qa_pairs_habits(spark, sf):
    """One fact per document: its length, by source; the zone column is absent."""
    facts = table(spark, sf, "documents").select(
        F.col("source").alias("file_name"),
        F.col("lang").alias("Indicador"),
        F.when(F.col("lang") == "es", F.lit("2022")).alias("path_year"),
        format_number_es(F.col("n_chars").cast("double")).alias("Total"),
    )
    return generators.qa_pairs(facts, "habits", ["file_name"])


AFFILIATION_PAIRS = f"""
SELECT concat_ws('|', event_type, periodo, nullif(left(sexo, 5), ''), 'usuario ' || user_id, value) AS k,
  event_type AS file_name, '¿Cuál fue el indicador de ''' || event_type || ''' para '
    || sexo || 'actividad ''usuario ' || user_id || ''' en ' || periodo || '?' AS question,
  'El indicador ''' || event_type || ''' ' || CASE WHEN sexo = '' THEN '' ELSE 'para Total ' END
    || 'en ' || periodo || ' fue de ' || {es_any('value')} || '.' AS answer
FROM (SELECT *, strftime(ts, '%Y. Mes %m') AS periodo,
      CASE WHEN event_type = 'view' THEN 'Total, ' ELSE '' END AS sexo FROM events
      WHERE value IS NOT NULL)"""


@register("qa_pairs_affiliation", _sample_sql("", AFFILIATION_PAIRS, "file_name"))
def qa_pairs_affiliation(spark, sf):
    facts = table(spark, sf, "events").select(
        F.col("event_type").alias("file_name"),
        F.col("event_type").alias("Tipo de indicador"),
        F.when(F.col("event_type") == "view", F.lit("Total")).alias("Sexo"),
        F.concat(F.lit("usuario "), F.col("user_id").cast("string")).alias("Actividad económica"),
        F.date_format("ts", "yyyy'. Mes 'MM").alias("Periodo"),
        F.col("value").cast("string").alias("Total"),
    )
    return generators.qa_pairs(facts, "affiliation", ["file_name"])


EU_PAIRS = f"""
SELECT concat_ws('|', l_returnflag, 'pedido ' || l_orderkey, year(l_shipdate), {es_any('l_extendedprice')}) AS k,
  l_returnflag AS file_name, '¿Cuál fue el valor de ''indicador EU'' en ' || l_returnflag
    || ', pedido ' || l_orderkey || ' (' || year(l_shipdate) || ')?' AS question,
  'El indicador armonizado ''indicador EU'' en ' || l_returnflag || ' para pedido ' || l_orderkey
    || ' en ' || year(l_shipdate) || ' fue de ' || {es_any('l_extendedprice')} || '.' AS answer
FROM lineitem"""


@register("qa_pairs_eu", _sample_sql("", EU_PAIRS, "file_name"))
def qa_pairs_eu(spark, sf):
    """One fact per line, three groups: each task keeps the cap before the shuffle."""
    facts = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("file_name"),
        F.col("l_returnflag").alias("País"),
        F.concat(F.lit("pedido "), F.col("l_orderkey").cast("string")).alias(
            "Sexo y nivel de estudios"
        ),
        F.year("l_shipdate").cast("string").alias("periodo"),
        format_number_es(F.col("l_extendedprice")).alias("Total"),
    )
    return generators.qa_pairs(facts, "eu", ["file_name"])


MEAN_PAIRS = f"""
SELECT concat_ws('|', n_name, periodo, {es_any('mean')}) AS k,
  'gasto_01.csv' AS file_name,
  '¿Cuál fue el gasto deportivo en ' || n_name || ' en ' || periodo || '?' AS question,
  'El gasto deportivo en ' || n_name || ' en ' || periodo || ' fue de ' || {es_any(ROUNDED_MEAN)} || '.'
  AS answer FROM line_means"""

UNION_SQL = f"""
WITH {LINE_MEANS_SQL}, {EXCHANGES_SQL},
generated AS ({capped_sql(MEAN_PAIRS, 'file_name')}),
pairs AS (
  SELECT 'conv ' || conv_id || ':' || turn AS origin, question, answer FROM exchanges
  UNION ALL SELECT file_name, question, answer FROM generated)
"""


def general_pairs(spark, sf):
    """Hand-written style pairs: the exchanges of the conversation table."""
    pairs = conversations.exchanges(table(spark, sf, "conversations"))
    origin = F.concat(F.lit("conv "), "conv_id", F.lit(":"), "turn").alias("origin")
    messages = chat.chat_record(F.col("question"), F.col("answer"))["content"]
    return pairs.select(origin, messages[1].alias("question"), messages[2].alias("answer"))


@register("union_pairs", f"{UNION_SQL} SELECT * FROM pairs")
def union_pairs(spark, sf):
    facts = line_means(spark, sf).select(
        F.lit("gasto_01.csv").alias("origin"),
        F.col("n_name").alias("Comunidad autónoma"),
        F.col("periodo").cast("string").alias("periodo"),
        format_number_es(F.col("mean")).alias("Total"),
    )
    generated = generators.qa_pairs(facts, "spend", ["origin"])
    return generators.union_pairs(general_pairs(spark, sf), generated)

