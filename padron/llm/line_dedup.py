"""Drop lines that many documents repeat.

A line's key is the line without white space at its ends, A-Z lowered. Keys of ``min_chars`` code
points or more that ``min_docs`` documents or more hold lose all their lines, except in the
document with the largest id among them.

Only hashes of lines and their places are dealt out by key; a text moves once, by document, and
only to meet the places to drop. Keys are counted before they meet (one row for each key and
task), and a key that a third of all documents hold is a skewed join, which adaptive execution
splits.

Defined results: a null or empty text is one empty line. Rows are told apart by id and text, so
repeated rows give repeated results and count as one document. A row without id counts as no
document, and loses the lines that are over the threshold. Other columns are left alone by
``deduplicated`` and absent from ``line_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE_SPACE)), UPPER, LOWER)


def _hash(value: Column) -> list[Column]:
    """128 bits: enough for lines to be told apart among trillions."""
    return [F.xxhash64(value).alias("_k1"), F.xxhash64(F.lit("line"), value).alias("_k2")]


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_all, _id, _row, _text): whole rows, and what tells texts of one id apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
        F.col(key).alias("_id"),
        F.xxhash64(F.lit("row"), body).alias("_row"),
        body.alias("_text"),
    )


def dropped_places(
    rows: DataFrame, min_chars: int, min_docs: int
) -> DataFrame:
    """(_id, _row, _places): the places of lines to drop, for documents that have any."""
    places = (
        rows.select("_id", "_row", F.posexplode(lines_of(F.col("_text"))).alias("_place", "_line"))
        .select("_id", "_row", "_place", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_row", "_place", *_hash(F.col("_key")))
    )
    common = (
        places.groupBy("_k1", "_k2")
        .agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
        .select("_k1", "_k2", "_keeper")
        # Dealt out anew: both sides of the join are then plain shuffles, and adaptive execution
        # may split the rows of a line that very many documents hold.
        .hint("rebalance")
    )
    lost = ~F.col("_id").eqNullSafe(F.col("_keeper"))
    return (
        places.join(common, ["_k1", "_k2"])
        .where(lost)
        .groupBy("_id", "_row")
        .agg(F.collect_set("_place").alias("_places"))
    )


def _with_places(
    df: DataFrame, key: str, text: str, min_chars: int, min_docs: int
) -> tuple[DataFrame, Column, Column]:
    """Rows joined with the places to drop; kept text and number of lines dropped."""
    rows = _marked(df, key, text)
    drop = dropped_places(rows.select("_id", "_row", "_text"), min_chars, min_docs)
    drop = drop.withColumnsRenamed({"_id": "_drop_id", "_row": "_drop_row"})
    same = F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_row") == F.col("_drop_row"))
    joined = rows.join(drop, same, "left")
    lines = lines_of(F.col("_text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))
    rebuilt = F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n")
    unchanged = F.col("_places").isNull()
    text_kept = F.when(unchanged, F.col("_text")).otherwise(rebuilt)
    n_dropped = F.when(unchanged, F.lit(0)).otherwise(F.size("_places"))
    return joined, text_kept, n_dropped.cast("long")


def deduplicated(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """The rows and columns of ``df`` with the kept lines as ``text``."""
    joined, kept, n_dropped = _with_places(df, key, text, min_chars, min_docs)
    column = {c: F.col("_all")[c] for c in df.columns}
    column[text] = F.when(n_dropped == 0, column[text]).otherwise(kept)
    return joined.select(*[column[c].alias(c) for c in df.columns])


def line_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Per row: id, lines before, lines dropped, digest of the kept text."""
    rows = df.select(F.col(key), F.col(text))
    joined, kept, n_dropped = _with_places(rows, key, text, min_chars, min_docs)
    return joined.select(
        F.col("_id").alias(key),
        F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"),
        n_dropped.alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
