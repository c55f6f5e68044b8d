"""Single-format readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of the consolidated indicator file.
CONSOLIDATED = "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long, Poblacion_Activa_Dep long"
CHAT_SCHEMA = "messages array<struct<role:string,content:string>>"
LABELLED_SCHEMA = "text string, label int"

# Rows per written file, so that one huge partition never becomes one huge file.
MAX_RECORDS_PER_FILE = 5_000_000
# Cells with line breaks keep a reader from splitting a file, so these stay small.
MAX_TEXTS_PER_FILE = 100_000


def read_semicolon(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """``;`` file with a header line; every column stays text, nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(sep=";", header=True, encoding="UTF-8").csv(path)


def read_comma(spark: SparkSession, path, schema: str = CONSOLIDATED) -> DataFrame:
    """Comma file with quoted cells and a declared schema; a bad cell fails the read."""
    return (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"', mode="FAILFAST")
        .csv(path)
    )


def read_labelled_csv(spark: SparkSession, path, schema: str = LABELLED_SCHEMA) -> DataFrame:
    """What ``write_csv`` writes; a cell may hold line breaks and quotes."""
    return (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")
        .csv(path)
    )


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a broken line or a missing path fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One UTF-8 object per line, letters unescaped."""
    df.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma file with a header; quotes are doubled, and no cell is altered."""
    (
        df.write.options(
            header=True,
            quote='"',
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .option("maxRecordsPerFile", MAX_TEXTS_PER_FILE)
        .mode("errorifexists")
        .csv(path)
    )


def write_semicolon(df: DataFrame, path: str) -> None:
    """Lake layout: ``;``, a header that opens with a byte-order mark."""
    first, *rest = df.columns
    (
        df.toDF("\ufeff" + first, *rest)
        .write.options(header=True, sep=";", quote='"', escape='"', emptyValue="")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .mode("errorifexists")
        .csv(path)
    )


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Hive-style folders; a rerun replaces only the partitions it brings.

    ``rebalance`` gathers each folder's rows into few files and lets adaptive
    execution split a folder that is too large for one task.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*by)
        .parquet(path)
    )


def split_manifest(df: DataFrame, split_col: str, parameters: dict) -> DataFrame:
    """One row: examples per split, all examples, and the run's parameters, also as JSON."""
    counts = [
        F.count_if(F.col(split_col) == name).alias(f"{name}_examples") for name in ("train", "test")
    ]
    row = df.agg(*counts, F.count(F.lit(1)).alias("examples")).withColumns(
        {name: F.lit(value) for name, value in parameters.items()}
    )
    return row.withColumn("manifest", F.to_json(F.struct(*row.columns)))
