"""Checks of a processed dataset, as one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _checks(
    df: DataFrame, required: list[str], rows: int | Column | None, constants: dict[str, object]
) -> list[Column]:
    present = all(c in df.columns for c in required)
    count = F.count(F.lit(1))
    checks = [
        count.alias("n_rows"),
        F.lit(present).alias("has_columns"),
        (F.lit(True) if rows is None else count == rows).alias("rows_ok"),
    ]
    for name, value in constants.items():
        column = F.col(name)
        checks.append(F.coalesce(F.min(column) == F.max(column), F.lit(False)).alias(f"{name}_constant"))
        checks.append(
            F.coalesce(F.bool_and(column.eqNullSafe(F.lit(value))), F.lit(False)).alias(f"{name}_ok")
        )
    return checks


def contract_checks(
    df: DataFrame,
    required: list[str],
    rows: int | Column | None,
    constants: dict[str, object],
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """Required columns, expected row count, and columns with one known value, in one pass.

    ``rows`` may be a scalar subquery. ``distinct``: columns to count the values of, with the
    name of the result.
    """
    counts = [F.count_distinct(F.col(c)).alias(n) for c, n in (distinct or {}).items()]
    return df.agg(*_checks(df, required, rows, constants), *counts)


def written_checked(
    df: DataFrame,
    write: Callable[[DataFrame], None],
    required: list[str],
    rows: int | None,
    constants: dict[str, object],
    counted: dict[str, Column] | None = None,
) -> DataFrame:
    """Write and check in the same pass; one row of results.

    The checks are gathered from the rows as they are written, so the table is read once and the
    written files not at all. ``counted``: names and conditions, whose rows are counted (the
    examples of each split for a run's manifest). ``write`` must run one job over its input.
    """
    seen = Observation()
    counts = [F.count_if(condition).alias(name) for name, condition in (counted or {}).items()]
    checks = [c for c in _checks(df, required, rows, constants)]
    write(df.observe(seen, *checks, *counts))
    found = seen.get
    shape = df.limit(0).agg(*checks, *counts).schema
    return df.sparkSession.createDataFrame([tuple(found[f.name] for f in shape)], shape)


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; the approximate form needs no wide shuffle."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"{c}_distinct") for c in columns])
