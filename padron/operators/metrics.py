"""Classifier quality from predictions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.numbers import round_even

DIGITS = 4


def confusion_matrix(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """tp, fp, fn and tn in one pass."""
    cell = lambda p, y: F.count_if((F.col(pred) == p) & (F.col(label) == y))
    return df.agg(
        cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(F.lit(2.0) * precision * recall, precision + recall)


def binary_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1, 0 where undefined, four decimals."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return matrix.select(
        "tp", "fp", "fn", "tn",
        round_even(_ratio(tp + tn, tp + tn + fp + fn), DIGITS).alias("accuracy"),
        round_even(precision, DIGITS).alias("precision"),
        round_even(recall, DIGITS).alias("recall"),
        round_even(_f1(precision, recall), DIGITS).alias("f1"),
    )


def class_report(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Per class and averaged: precision, recall, F1, support.

    Pairs are counted first, so everything after runs on classes squared rows.
    """
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("chosen"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = (
        sides.groupBy("cls")
        .agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit"))
        .withColumns({
            "precision": _ratio(F.col("hit"), F.col("chosen")),
            "recall": _ratio(F.col("hit"), F.col("support")),
        })
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )
    measures = ("precision", "recall", "f1")
    rows = F.sum("support")
    macro = per_class.agg(
        F.lit("macro avg").alias("class"),
        *[F.avg(m).alias(m) for m in measures],
        rows.alias("support"),
    )
    weighted = per_class.agg(
        F.lit("weighted avg").alias("class"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), rows).alias(m) for m in measures],
        rows.alias("support"),
    )
    accuracy = per_class.agg(
        F.lit("accuracy").alias("class"),
        *[_ratio(F.sum("hit"), rows).alias(m) for m in measures],
        rows.alias("support"),
    )
    classes = per_class.select(F.col("cls").cast("string").alias("class"), *measures, "support")
    report = classes.unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return report.select(
        "class", *[round_even(F.col(m), DIGITS).alias(m) for m in measures], "support"
    )
