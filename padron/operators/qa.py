"""Answers to questions about the indicators, for a table or a stream of prompts.

All that an answer needs of the facts fits one row: three extremes, the
fallback, and one entry per name in the alias list. That row is a scalar
subquery, so prompts are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.hashing import seeded_hash
from padron.functions.numbers import shortest_text
from padron.functions.scores import over_threshold
from padron.functions.text import contains_any, fold, fold_text, ws_rejoin
from padron.lookups import (
    ANSWER_LABELS,
    BLOCKED_TERMS,
    INTENT_PATTERNS,
    LICENCES_COL,
    REGION_ALIASES,
    REGION_COL,
    SPEND_COL,
    TOXIC_THRESHOLD,
)
from padron.operators.moderation import blocked_message, lexical_flag
from padron.operators.regions import spelling_key, spelling_text

# Up to here a chain of conditions; a longer list is a literal array that one expression walks.
MAX_CHAIN = 200
FALLBACK_SEED = 0


def intent(folded: Column) -> Column:
    """max_spend, min_spend or max_licences of a folded prompt, tried in this order."""
    return F.coalesce(
        *[F.when(contains_any(folded, phrases), F.lit(name)) for name, phrases in INTENT_PATTERNS]
    )


def facts_digest(
    facts: DataFrame, aliases=REGION_ALIASES, fallback_region: str | None = None
) -> DataFrame:
    """One row: ``n``, the extreme rows, the fallback row, and the named regions.

    Facts are reduced per region first, so copies of a region never meet in
    one task. The map has one entry per distinct name in ``aliases`` at most;
    its keys are spelling keys, its rows show the facts' own spelling.
    """
    row = F.struct(
        F.col(REGION_COL).cast("string").alias("region"),
        F.col(SPEND_COL).cast("double").alias("spend"),
        F.col(LICENCES_COL).cast("long").alias("licences"),
    )

    def least(row: Column, by: Column) -> Column:
        """The row with the smallest ``by``; rows without one do not take part."""
        return F.min_by(row, F.when(by.isNotNull(), F.struct(by, row["region"])))

    spelt = facts.select(row.alias("row"), spelling_key(F.col(REGION_COL)).alias("key"))
    per_region = spelt.groupBy("key").agg(
        F.min("row.region").alias("region"),
        F.count(F.lit(1)).alias("n"),
        F.min("row").alias("first"),
        least(F.col("row"), -F.col("row.spend")).alias("high"),
        least(F.col("row"), F.col("row.spend")).alias("low"),
        least(F.col("row"), -F.col("row.licences")).alias("most"),
    )
    if fallback_region is None:
        choice = seeded_hash(FALLBACK_SEED, F.col("region"))
    else:
        choice = (F.col("region") != F.lit(fallback_region)).cast("int")
    named = F.col("key").isin(*{spelling_text(official) for _, official in aliases})
    return per_region.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        least(F.col("high"), -F.col("high.spend")).alias("max_spend"),
        least(F.col("low"), F.col("low.spend")).alias("min_spend"),
        least(F.col("most"), -F.col("most.licences")).alias("max_licences"),
        least(F.col("first"), choice).alias("fallback"),
        F.map_from_entries(
            F.collect_list(F.when(named, F.struct("key", "first")))
        ).alias("regions"),
    )


def region_of(folded: Column, regions: Column, aliases=REGION_ALIASES) -> Column:
    """The spelling key of the first alias in a folded prompt that has a fact; null for none."""
    keyed = [(F.lit(fold_text(a)), F.lit(spelling_text(official))) for a, official in aliases]

    def told(alias: Column, key: Column) -> Column:
        return F.contains(folded, alias) & F.map_contains_key(regions, key)

    if len(keyed) <= MAX_CHAIN:
        return F.coalesce(*[F.when(told(alias, key), key) for alias, key in keyed])
    pairs = F.array(*[F.struct(alias.alias("alias"), key.alias("key")) for alias, key in keyed])
    return F.get(F.filter(pairs, lambda p: told(p["alias"], p["key"])), F.lit(0))["key"]


# Which template and which value field answers each kind of question.
KINDS = {
    "max_spend": "chat_max_spend",
    "min_spend": "chat_min_spend",
    "max_licences": "chat_max_lic",
    "region": "chat_single_region",
    "fallback": "chat_single_region",
}


def classified(prompts: DataFrame, digest: Column, prompt: str, aliases) -> DataFrame:
    """Add the folded prompt, the kind of question, and the fact row that answers it.

    Each step is its own projection: a folded prompt is computed once however
    many patterns look at it.
    """
    return (
        prompts.withColumn("_facts", digest)
        .withColumn("_folded", fold(F.col(prompt)))
        .withColumn("_intent", intent(F.col("_folded")))
        .withColumn(
            "_named",
            F.when(
                F.col("_intent").isNull(),
                region_of(F.col("_folded"), F.col("_facts.regions"), aliases),
            ),
        )
        .withColumn(
            "_kind",
            F.coalesce(
                "_intent", F.when(F.col("_named").isNotNull(), F.lit("region")), F.lit("fallback")
            ),
        )
        .withColumn(
            "_row",
            F.when(F.col("_kind") == "region", F.try_element_at("_facts.regions", "_named"))
            .when(F.col("_kind") == "max_spend", F.col("_facts.max_spend"))
            .when(F.col("_kind") == "min_spend", F.col("_facts.min_spend"))
            .when(F.col("_kind") == "max_licences", F.col("_facts.max_licences"))
            .otherwise(F.col("_facts.fallback")),
        )
    )


def render(template: str, **fields: tuple[Column, Column]) -> Column:
    """A format string as an expression; a field is (plain text, text with thousands marks)."""
    parts: list[Column] = []
    for text, field, spec, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            plain, grouped = fields[field]
            parts.append(grouped if spec == "," else plain)
    return F.concat(*parts)


def _by_language(lang: Column, labels: dict, text: Callable[[dict], Column]) -> Column:
    """The text in the prompt's language; unknown languages get Spanish."""
    out = text(labels["ES"])
    for code, texts in labels.items():
        if code != "ES":
            out = F.when(lang == code, text(texts)).otherwise(out)
    return out


def _replied(df: DataFrame, lang: Column, labels: dict) -> DataFrame:
    """Add ``answer`` to classified prompts."""
    spend, licences = F.col("_spend"), F.col("_licences")
    region, grouped = F.col("_row.region"), F.format_number("_row.licences", 0)

    def reply(texts: dict) -> Column:
        one = {"region": (region, region), "gasto": (spend, spend), "lic": (licences, licences)}
        values = {"max_spend": (spend, spend), "min_spend": (spend, spend)}
        cases = F.lit(None).cast("string")
        for kind, key in KINDS.items():
            value = values.get(kind, (licences, grouped))
            text = render(texts[key], value=value, **one)
            if kind == "fallback":
                text = F.concat(F.lit(texts["chat_analyze"] + " "), text)
            cases = F.when(F.col("_kind") == kind, text).otherwise(cases)
        return F.when(F.col("_facts.n") > 0, F.coalesce(cases, F.lit(texts["chat_error_data"])))\
            .otherwise(F.lit(texts["chat_error_data"]))

    shown = df.withColumns(
        {
            "_spend": shortest_text(F.col("_row.spend")),
            "_licences": F.col("_row.licences").cast("string"),
        }
    )
    return shown.withColumn("answer", _by_language(lang, labels, reply))


WORK = ("_facts", "_folded", "_intent", "_named", "_kind", "_row", "_spend", "_licences")


def _digest(facts: DataFrame, aliases, fallback_region: str | None) -> Column:
    row = facts_digest(facts, aliases, fallback_region)
    return row.select(F.struct(*row.columns)).scalar()


def answer(
    prompts: DataFrame,
    facts: DataFrame,
    lang: str | Column = "ES",
    prompt: str = "prompt",
    labels: dict | None = None,
    aliases=REGION_ALIASES,
    fallback_region: str | None = None,
) -> DataFrame:
    """Add ``answer`` to each prompt. ``labels`` maps language to templates."""
    code = F.lit(lang) if isinstance(lang, str) else lang
    known = classified(prompts, _digest(facts, aliases, fallback_region), prompt, aliases)
    return _replied(known, code, labels or ANSWER_LABELS).drop(*WORK)


def guarded_answer(
    prompts: DataFrame,
    facts: DataFrame,
    lang: str | Column = "ES",
    prompt: str = "prompt",
    score: str | None = None,
    terms=BLOCKED_TERMS,
    mode: str = "word",
    threshold: float = TOXIC_THRESHOLD,
    aliases=REGION_ALIASES,
    fallback_region: str | None = None,
) -> DataFrame:
    """Add ``blocked`` and ``answer``: blocklist first, then the score, then the facts."""
    code = F.lit(lang) if isinstance(lang, str) else lang
    by_score = F.lit(False) if score is None else over_threshold(F.col(score), threshold)
    known = classified(prompts, _digest(facts, aliases, fallback_region), prompt, aliases)
    checked = known.withColumn(
        "blocked", lexical_flag(F.col("_folded"), terms, mode) | by_score
    )
    reply = F.when(F.col("blocked"), blocked_message(code)).otherwise(F.col("answer"))
    return (
        _replied(checked, code, ANSWER_LABELS)
        .withColumn("answer", ws_rejoin(reply))
        .drop(*WORK)
    )
