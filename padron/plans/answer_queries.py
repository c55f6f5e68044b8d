"""Questions, guarded answers, the answer stream, and the usage panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from padron.functions.text import fold
from padron.lookups import ANSWER_LABELS, BLOCKED_EN, BLOCKED_ES, REGION_COL, TOXIC_THRESHOLD
from padron.operators import qa
from padron.operators.regions import comma_to_parens
from padron.plans.facts import INDICATORS_SQL, NATION_ALIASES, home
from padron.plans.moderation_queries import TERMS, WORD_SQL
from padron.plans.registry import register, table
from padron.session import saved, scratch_dir
from padron.streaming.answers import read_messages, write_answers
from padron.streaming.usage import load_per_minute as per_minute
from padron.streaming.usage import load_stream, with_tail, write_load
from padron.streaming.usage import usage_24h as usage


def prompts(spark, sf):
    """One question per customer; its kind follows the market segment."""
    segment = F.col("c_mktsegment")
    nation = F.col("c_nationkey").cast("string")
    text = (
        F.when(segment == "BUILDING", F.lit("¿Quién GASTA MÁS en deporte?"))
        .when(segment == "AUTOMOBILE", F.lit("Territorio con mínimo gasto"))
        .when(segment == "MACHINERY", F.lit("Who has most licenses?"))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("Datos de NACIÓN "), nation, F.lit(" ya")))
        .when(F.col("c_acctbal") < 0, F.lit("Eres IDIOTA, dime algo"))
        .otherwise(F.lit("Cuéntame algo"))
    )
    lang = F.when(F.col("c_acctbal") >= 5000, F.lit("EN")).otherwise(F.lit("ES"))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        text.alias("prompt"),
        lang.alias("lang"),
    )


PROMPTS_SQL = """
prompts AS (SELECT 'c' || c_custkey AS id, CASE c_mktsegment
    WHEN 'BUILDING' THEN '¿Quién GASTA MÁS en deporte?'
    WHEN 'AUTOMOBILE' THEN 'Territorio con mínimo gasto'
    WHEN 'MACHINERY' THEN 'Who has most licenses?'
    WHEN 'HOUSEHOLD' THEN 'Datos de NACIÓN ' || c_nationkey || ' ya'
    ELSE CASE WHEN c_acctbal < 0 THEN 'Eres IDIOTA, dime algo' ELSE 'Cuéntame algo' END END
    AS prompt, CASE WHEN c_acctbal >= 5000 THEN 'EN' ELSE 'ES' END AS lang FROM customer)
"""

INTENT_SQL = """CASE
  WHEN regexp_matches(f, 'gasta mas|maximo gasto|most spending|highest spending|mas dinero')
    THEN 'max_spend'
  WHEN regexp_matches(f, 'gasta menos|minimo gasto|least spending|lowest spending')
    THEN 'min_spend'
  WHEN regexp_matches(f, 'mas licencias|most licenses|mas federados|mas socios')
    THEN 'max_licences' END"""


@register(
    "intent_classify",
    f"WITH {PROMPTS_SQL} SELECT id, coalesce({INTENT_SQL}, 'other') AS intent FROM"
    " (SELECT id, strip_accents(lower(prompt)) AS f FROM prompts UNION ALL"
    " SELECT 'm' || conv_id || ':' || turn, strip_accents(lower(text)) FROM conversations)",
)
def intent_classify(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit(":"), "turn").alias("id"), F.col("text").alias("prompt")
    )
    asked = prompts(spark, sf).select("id", "prompt").unionByName(turns)
    folded = asked.select("id", fold(F.col("prompt")).alias("folded"))
    return folded.select("id", F.coalesce(qa.intent(F.col("folded")), F.lit("other")).alias("intent"))


# Which region a prompt names, by the same rule as the alias list.
NAMED_SQL = """
named AS (SELECT p.*, h."CCAA" AS region, h."Gasto_Promedio_Hogar_Eur" AS spend,
    CAST(h."Licencias_Federadas" AS BIGINT) AS licences
  FROM (SELECT *, strip_accents(lower(prompt)) AS f FROM prompts) p LEFT JOIN home h
  ON contains(p.f, 'nacion ' || regexp_extract(h."CCAA", '([0-9]+)', 1) || ' '))
"""


@register(
    "region_alias_join",
    f"{INDICATORS_SQL}, {PROMPTS_SQL}, {NAMED_SQL}"
    " SELECT id, CASE WHEN regexp_matches(region, '[02468],') THEN"
    " regexp_replace(region, '^(.+), (.+)$', '\\1 (\\2)') ELSE region END AS region,"
    " spend, licences FROM named",
)
def region_alias_join(spark, sf):
    """The region each question names, with its facts; null where it names none."""
    # Every other region in the other spelling, as sources differ.
    spelling = F.when(F.col(REGION_COL).rlike("[02468],"), comma_to_parens(F.col(REGION_COL)))
    facts = home(spark, sf).withColumn(REGION_COL, F.coalesce(spelling, F.col(REGION_COL)))
    digest = qa.facts_digest(facts, NATION_ALIASES)
    regions = digest.select("regions").scalar()
    asked = prompts(spark, sf).withColumns(
        {"regions": regions, "folded": fold(F.col("prompt"))}
    )
    named = asked.withColumn(
        "key", qa.region_of(F.col("folded"), F.col("regions"), NATION_ALIASES)
    )
    fact = F.try_element_at("regions", "key")
    return named.select("id", fact["region"].alias("region"), fact["spend"].alias("spend"), fact["licences"].alias("licences"))


def _label(code: str, key: str, **fields: str) -> str:
    """SQL text of an answer template."""
    text = ANSWER_LABELS[code][key].replace("{value:,}", "{value}")
    out = "'" + text.replace("'", "''") + "'"
    for name, sql in fields.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


def _both(key: str, **fields: str) -> str:
    return (
        f"CASE WHEN lang = 'EN' THEN {_label('EN', key, **fields)}"
        f" ELSE {_label('ES', key, **fields)} END"
    )


def _pick(column: str, order: str) -> str:
    return f'(SELECT {column} FROM home ORDER BY {order}, "CCAA" LIMIT 1)'


_SPEND, _LIC = '"Gasto_Promedio_Hogar_Eur"', '"Licencias_Federadas"'
_REGION, _SPEND_TEXT = '"CCAA"', f"CAST({_SPEND} AS VARCHAR)"
_LIC_TEXT = f"CAST(CAST({_LIC} AS BIGINT) AS VARCHAR)"
_HASH = "md5('0:' || \"CCAA\")"

ANSWER_SQL = f"""CASE {INTENT_SQL}
  WHEN 'max_spend' THEN {_both('chat_max_spend', region=_pick(_REGION, f'{_SPEND} DESC'),
                               value=_pick(_SPEND_TEXT, f'{_SPEND} DESC'))}
  WHEN 'min_spend' THEN {_both('chat_min_spend', region=_pick(_REGION, _SPEND),
                               value=_pick(_SPEND_TEXT, _SPEND))}
  WHEN 'max_licences' THEN {_both('chat_max_lic', region=_pick(_REGION, f'{_LIC} DESC'),
                                  value=_pick(f"format('{{:,}}', CAST({_LIC} AS BIGINT))",
                                              f'{_LIC} DESC'))}
  ELSE CASE WHEN region IS NOT NULL THEN {_both('chat_single_region', region='region',
      gasto='CAST(spend AS VARCHAR)', lic='CAST(licences AS VARCHAR)')}
    ELSE {_both('chat_analyze')} || ' ' || {_both('chat_single_region',
      region=_pick(_REGION, _HASH), gasto=_pick(_SPEND_TEXT, _HASH), lic=_pick(_LIC_TEXT, _HASH))}
    END END"""


@register(
    "chat_answer",
    f"{INDICATORS_SQL}, {PROMPTS_SQL}, {NAMED_SQL} SELECT id, {ANSWER_SQL} AS answer FROM named",
)
def chat_answer(spark, sf):
    answers = qa.answer(
        prompts(spark, sf), home(spark, sf), F.col("lang"), aliases=NATION_ALIASES
    )
    return answers.select("id", "answer")


def messages(spark, sf):
    """Customer questions and the user turns of all conversations."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return prompts(spark, sf).unionByName(
        turns.select(
            F.concat(F.lit("m"), "conv_id", F.lit(":"), "turn").alias("id"),
            F.col("text").alias("prompt"),
            F.lit("FR").alias("lang"),
        )
    ).withColumn(
        # A given score: the last digit of a customer's number, none for turns.
        "score", (F.substring("id", 2, 20).try_cast("long") % 10) / F.lit(10.0)
    )


GUARDED_SQL = f"""{INDICATORS_SQL}, {PROMPTS_SQL.replace('prompts AS', 'customers AS')},
prompts AS (SELECT * FROM customers UNION ALL
  SELECT 'm' || conv_id || ':' || turn, text, 'FR' FROM conversations WHERE role = 'user'),
{NAMED_SQL}, checked AS (SELECT *, {WORD_SQL.replace('text', 'prompt')}
  OR coalesce(TRY_CAST(id[2:] AS BIGINT) % 10 / 10.0 >= {TOXIC_THRESHOLD}, false) AS blocked
  FROM named)
SELECT id, blocked, CASE WHEN blocked THEN
  CASE WHEN lang = 'ES' THEN '{BLOCKED_ES}' ELSE '{BLOCKED_EN}' END
  ELSE {ANSWER_SQL} END || ' ' AS answer FROM checked"""


@register("guarded_answer", GUARDED_SQL)
def guarded_answer(spark, sf):
    answers = qa.guarded_answer(
        messages(spark, sf), home(spark, sf), F.col("lang"), score="score", terms=TERMS,
        aliases=NATION_ALIASES,
    )
    return answers.select("id", "blocked", "answer")


@register("stream_guarded_answer", GUARDED_SQL)
def stream_guarded_answer(spark, sf):
    """The same answers from a stream over the same messages.

    The facts are written once, so a micro-batch reads one small table.
    """
    root = scratch_dir(spark, "answers")
    inbox, asked = f"{root}/messages", messages(spark, sf)
    asked.write.parquet(inbox)
    job = write_answers(
        read_messages(spark, inbox, asked.schema), saved(home(spark, sf), "facts"), f"{root}/out", f"{root}/checkpoint", F.col("lang"),
        score="score", terms=TERMS, aliases=NATION_ALIASES,
    )
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", "blocked", "answer")


@register(
    "usage_24h",
    """WITH t AS (SELECT *, (SELECT max(ts) FROM events) AS now FROM events),
s AS (SELECT count(DISTINCT user_id) FILTER (ts > now - INTERVAL 24 HOUR) AS active_users_24h,
  count(*) AS total_queries,
  count(*) FILTER (event_type = 'error' AND ts > now - INTERVAL 24 HOUR) AS failed_24h,
  count(*) FILTER (event_type = 'error' AND ts > now - INTERVAL 48 HOUR
    AND ts <= now - INTERVAL 24 HOUR) AS failed_prev_24h FROM t)
SELECT *, CASE WHEN failed_prev_24h > 0 THEN
  printf('%.1f', (failed_24h - failed_prev_24h) * 100.0 / failed_prev_24h) END
  AS failed_change_pct FROM s""",
)
def usage_24h(spark, sf):
    return usage(table(spark, sf, "events"))


@register(
    "load_per_minute",
    "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS load,"
    " count(*) FILTER (event_type = 'error') AS failed FROM events"
    " WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 20 MINUTE GROUP BY 1",
)
def load_per_minute(spark, sf):
    """The last 20 minutes, which is the panel's range."""
    load = per_minute(table(spark, sf, "events"))
    return load.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@register(
    "stream_load_per_minute",
    "SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, count(*) AS load,"
    " count(*) FILTER (event_type = 'error') AS failed"
    " FROM (SELECT *, date_trunc('minute', ts) AS m FROM events) GROUP BY m",
)
def stream_load_per_minute(spark, sf):
    """Load of every minute: written by a stream as the watermark closes it, the rest at the end."""
    root = scratch_dir(spark, "load")
    events = table(spark, sf, "events")
    events.write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    write_load(load_stream(arriving), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    load = with_tail(spark.read.parquet(f"{root}/out"), spark.read.parquet(f"{root}/in"))
    return load.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "load", "failed")
