"""Territory names: keys, harmonising, and the region dimension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from padron.functions.text import fold, fold_text
from padron.lookups import REGION_ALIASES, REGION_KEYS, REGIONS


def region_key(name: Column) -> Column:
    """Lower case without accents; null stays null."""
    return fold(name)


def harmonise(key: Column, mapping: dict[str, str] = REGION_KEYS) -> Column:
    """The mapped key, or the key itself. A fixed mapping needs no join."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def harmonise_by_table(df: DataFrame, key: str, mapping: DataFrame, target: str) -> DataFrame:
    """``harmonise`` for a mapping table with columns ``from_key`` and ``to_key``.

    The strategy is left to adaptive execution, which broadcasts the table only
    while its measured size allows it. Each ``from_key`` is used once.
    """
    lookup = mapping.groupBy("from_key").agg(F.min("to_key").alias("to_key"))
    joined = df.join(lookup, df[key] == lookup["from_key"], "left")
    return joined.withColumn(target, F.coalesce("to_key", F.col(key))).drop("from_key", "to_key")


def comma_to_parens(key: Column) -> Column:
    """``x, y`` -> ``x (y)``, the rule behind the fixed mapping."""
    return F.regexp_replace(key, r"^(.+), (.+)$", "$1 ($2)")


def spelling_key(name: Column) -> Column:
    """One key for every spelling: accents, comma or parentheses, spaced dashes."""
    return F.regexp_replace(comma_to_parens(region_key(name)), r" *- *", "-")


def spelling_text(name: str) -> str:
    """``spelling_key`` of a fixed name."""
    return re.sub(r" *- *", "-", re.sub(r"^(.+), (.+)$", r"\1 (\2)", fold_text(name)))


def canonical_region(name: Column) -> Column:
    """The official name for any spelling; null for a name that is no territory."""
    plain = {fold_text(r).replace(" - ", "-"): r for r in REGIONS}
    keys = {REGION_KEYS.get(k, k): r for k, r in plain.items()}
    pairs = [F.lit(part) for pair in keys.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), spelling_key(name))


def region_dimension(spark: SparkSession) -> DataFrame:
    """Official name, spend-side key and question words of each territory."""
    aliases: dict[str, list[str]] = {r: [] for r in REGIONS}
    for alias, official in REGION_ALIASES:
        aliases[official.replace(" - ", "-")].append(fold_text(alias))
    rows = [(r, aliases[r]) for r in REGIONS]
    base = spark.createDataFrame(rows, "canonical string, aliases array<string>")
    return base.withColumn("region_key", spelling_key(F.col("canonical")))
