"""Labelled texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.functions.numbers import fixed_text
from padron.functions.text import strip
from padron.lookups import SEED
from padron.operators.sampling import shuffled
from padron.session import saved
from padron.sources.files import write_csv, write_jsonl


def labelled_text(texts: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Texts with their label, joined on a key that is unique on both sides."""
    return texts.join(labels.select(key, F.col(label).cast("int").alias("label")), key, "inner")


#: Most ids to send to all workers; beyond it texts are not moved for the sake of a filter.
MAX_SENT_IDS = 1_000_000


def only_labelled(texts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Texts that have a label, before anything dear is done with them.

    Labels of known, small number are sent to the texts. More of them would move the texts
    through a shuffle, which costs more than it saves: then all texts are returned, and the
    join with the labels comes after the texts are reduced.
    """
    if labels.count() > MAX_SENT_IDS:
        return texts
    return texts.join(F.broadcast(labels.select(key)), key, "left_semi")


def labelled_union(*parts: tuple[DataFrame, int | None], keep: list[str] = ()) -> DataFrame:
    """One (text, label) table from lists; ``None`` keeps a list's own labels."""
    frames = [
        df.select(
            *keep,
            strip(F.col("text")).alias("text"),
            (F.col("label") if label is None else F.lit(label)).cast("int").alias("label"),
        )
        for df, label in parts
    ]
    return reduce(DataFrame.unionByName, frames)


def write_labelled_set(
    df: DataFrame, keys: list[str], csv_path: str, jsonl_path: str, seed: int = SEED
) -> None:
    """Shuffle labelled texts by their unique ``keys`` and write both formats in that order."""
    ordered = shuffled(saved(df, "labelled"), keys, seed)
    rows = ordered.repartitionByRange("position").sortWithinPartitions("position")
    write_csv(rows.select("text", "label"), csv_path)
    write_jsonl(rows.select("text", "label"), jsonl_path)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of each class, the share with one decimal."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("total", total).withColumn(
        "pct", fixed_text(F.col("n") / F.col("total") * F.lit(100.0), 1)
    )
