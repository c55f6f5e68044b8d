"""Small tables and slow, plain versions to compare with."""

import random

import pandas as pd
from pyspark.sql import functions as F

CLASHING = (
    "key n g a b c _id _row _text _all score component_id lines places rows words chunk name seq turn"
    " tokens prefix bitmap item verdict posterior kept held_out"
).split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs(spark, texts, ids=None, lang="en"):
    """Documents with ids 1, 2, ... and the columns of the given table."""
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    rows = [(i, t, lang, "src0", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema)


def prose(seed, n, vocabulary=4000):
    """Words of a made-up language; frequent ones come often."""
    rng = random.Random(seed)
    common = "the of and to in a is that for it".split()
    out = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(vocabulary)}x" for _ in range(n)]
    return " ".join(out)


def lines(seed, n_lines, words_per_line=9):
    return "\n".join(prose((seed, i).__hash__(), words_per_line) + "." for i in range(n_lines))


ODD_TEXTS = [
    None, "", "", " \t\n\r\x0b\x0c ", "one", "\n\n\n", "ñandú 日本語 😀 é \x00", prose(1, 60), prose(1, 60),
    "x" * 100_000, prose(2, 30_000), "\n".join(["same line of forty characters or more, again"] * 300),
]
ODD_IDS = [1, 2, 3, 4, 5, 6, None, 8, 8, 10, (1 << 60) + 1, None]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, large ids, columns of clashing names."""
    out = docs(spark, ODD_TEXTS, ODD_IDS).withColumn("lang", F.when(F.col("doc_id") != 5, F.col("lang")))
    return out.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def empty(spark):
    return docs(spark, [])


def rows(df) -> pd.DataFrame:
    """All rows; ids as they are, since pandas would turn integers beside nulls into floats."""
    found = df.collect()
    out = pd.DataFrame([r.asDict() for r in found], columns=df.columns)
    for name in {"doc_id", "conv_id"} & set(df.columns):
        out[name] = pd.Series([r[name] for r in found], dtype=object)
    return out


def ids(df) -> list:
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))


ALL_IDS = sorted(ODD_IDS, key=lambda i: (i is None, i or 0))
