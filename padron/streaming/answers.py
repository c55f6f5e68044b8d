"""Guarded answers for arriving messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from padron.operators.qa import guarded_answer


def read_messages(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Messages from a folder of Parquet files as they arrive."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def write_answers(
    messages: DataFrame,
    facts: DataFrame,
    out: str,
    checkpoint: str,
    lang="ES",
    available_now: bool = True,
    **options,
):
    """Start the stateless job; files are committed once per message.

    ``availableNow`` works off what is there and stops; otherwise it runs on.
    """
    answers = guarded_answer(messages, facts, lang, **options)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return (
        answers.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(out)
    )
