"""Projections and header work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padron.functions.periods import year_cast
from padron.functions.text import clean_cell, fold_text, repair_text
from padron.lookups import TABLE_LABELS

SOURCE_YEAR = 2023
SOURCE_NAME = "gasto_y_federado_2023"


def add_metadata(df: DataFrame, year: int = SOURCE_YEAR, source: str = SOURCE_NAME) -> DataFrame:
    return df.withColumns({"anio": F.lit(year), "fuente": F.lit(source)})


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Absent columns are left out, as in a rename by dictionary."""
    return df.withColumnsRenamed(names)


def assistant_columns(df: DataFrame) -> DataFrame:
    """Underscored indicator headings to the spaced ones."""
    return rename_columns(
        df,
        {
            "Gasto_Promedio_Hogar_Eur": "Gasto Promedio Hogar Eur",
            "Licencias_Federadas": "Licencias Federadas",
        },
    )


def localised(df: DataFrame, lang: str = "ES") -> DataFrame:
    return rename_columns(df, TABLE_LABELS.get(lang, TABLE_LABELS["ES"]))


def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] = ()) -> DataFrame:
    kept = df.select(*keep) if keep else df
    return kept.drop(*drop)


def clean_strings(df: DataFrame) -> DataFrame:
    """Header names and text cells without byte-order marks and outer white space."""
    cells = [
        clean_cell(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    names = [c.replace("\ufeff", "").strip() for c in df.columns]
    return df.select(*[cell.alias(name) for cell, name in zip(cells, names, strict=True)])


def header_key(name: str) -> str:
    """A header name repaired, in lower case, without accents."""
    return fold_text(repair_text(name))


def alias_candidates(columns: list[str], aliases: list[str]) -> list[str]:
    """Per alias the exact matches, then longer names that end with it; each column once."""
    keyed = [(header_key(c), c) for c in columns]
    ranked: dict[str, None] = {}
    for wanted in map(header_key, aliases):
        ranked |= dict.fromkeys(c for key, c in keyed if key == wanted)
        ranked |= dict.fromkeys(c for key, c in keyed if key != wanted and key.endswith(wanted))
    return list(ranked)


def coalesce_columns(df: DataFrame, canonical: dict[str, list[str]]) -> DataFrame:
    """Canonical columns from header variants: the first non-null candidate.

    A name without a candidate is not added. Candidates of later names are
    looked up among the original headers only.
    """
    columns = df.columns
    found = {name: alias_candidates(columns, aliases) for name, aliases in canonical.items()}
    return df.withColumns(
        {
            name: F.coalesce(*[F.col(f"`{c}`") for c in candidates])
            for name, candidates in found.items()
            if candidates
        }
    )


def with_year(df: DataFrame, column: str = "periodo") -> DataFrame:
    """The column as a year; an integer column is kept so that filters reach the scan."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return df
    return df.withColumn(column, year_cast(F.col(column)))
