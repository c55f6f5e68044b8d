"""Blocklist and score rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.scores import over_threshold
from padron.functions.text import as_words, contains_any, fold_long, matched_terms
from padron.lookups import BLOCKED_EN, BLOCKED_ES, BLOCKED_TERMS, TOXIC_THRESHOLD


def lexical_flag(folded: Column, terms=BLOCKED_TERMS, mode: str = "word") -> Column:
    """True for a folded text with a blocked term; ``substring`` also hits inside words."""
    return F.coalesce(contains_any(folded, terms, mode), F.lit(False))


def lexical_hits(folded: Column, terms=BLOCKED_TERMS, mode: str = "word") -> Column:
    return matched_terms(folded, terms, mode)


def flags_and_hits(df: DataFrame, folded: str, terms=BLOCKED_TERMS) -> DataFrame:
    """Add ``hits`` (terms found anywhere), ``substring`` and ``word``.

    The terms are searched for once; word limits are only looked at where one was found.
    """
    found = df.withColumn("hits", matched_terms(F.col(folded), terms, "substring"))
    some = F.coalesce(F.size("hits") > 0, F.lit(False))
    return found.withColumns({"substring": some, "word": some & as_words(F.col(folded), terms)})


def moderated(
    df: DataFrame,
    text: str = "text",
    score: str | None = None,
    terms=BLOCKED_TERMS,
    mode: str = "word",
    threshold: float = TOXIC_THRESHOLD,
) -> DataFrame:
    """Add ``blocked_by`` (lexical, score, or null) and ``hits``, the terms found."""
    by_score = F.lit(False) if score is None else over_threshold(F.col(score), threshold)
    folded = df.withColumn("_folded", fold_long(F.col(text)))
    found = folded.withColumn("hits", lexical_hits(F.col("_folded"), terms, mode))
    rule = F.when(F.size("hits") > 0, F.lit("lexical")).when(by_score, F.lit("score"))
    return found.withColumn("blocked_by", rule).drop("_folded")


def blocked_message(lang: Column) -> Column:
    return F.when(lang == "ES", F.lit(BLOCKED_ES)).otherwise(F.lit(BLOCKED_EN))
