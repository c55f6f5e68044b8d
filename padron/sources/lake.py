"""A tree of ``;`` files with differing headers as one fact table with lineage."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padron.functions.numbers import parse_number_es
from padron.functions.periods import path_category, path_year
from padron.functions.text import clean_cell, repair_text
from padron.lookups import (
    CATEGORY_FAMILY,
    LAKE_HEADERS,
    LICENCE_FILE,
    MISSING_CELLS,
    SAMPLE_CAP,
    SPEND_FILE,
)
from padron.operators.columns import alias_candidates
from padron.session import saved, scratch_dir
from padron.sources import records
from padron.sources.records import SEP, decoded_path

LINEAGE = ["category", "wave", "file_name", "file_path", "source_path"]
# The last column is never read, which keeps the reader on its pruned path: cells by
# position, no error for a row that is shorter or longer than the widest header.
UNREAD = "_unread"
#: Most files whose names and layouts are sent to the rows; beyond it, rows move to them.
MAX_SENT_FILES = 20_000


def below_raw(path: Column) -> Column:
    """The path from the ``raw`` folder on, so that parent folders never count."""
    tail = F.regexp_extract(path, r"(?i)(?:^|/)(raw/.*)$", 1)
    return F.when(tail != "", tail).otherwise(path)


def lineage(path: Column) -> dict[str, Column]:
    """Category, survey wave, file and path; part files count as the file they sit in."""
    inner = below_raw(path)
    wave = F.regexp_extract(inner, r"/(?:[^/=]+=)?((?:19|20)[0-9]{2}(?:[_-](?:19|20)[0-9]{2})?)/", 1)
    return {
        "category": path_category(inner),
        "wave": F.nullif(wave, F.lit("")),
        "file_name": F.regexp_extract(inner, r"([^/]+?\.csv)(?:/|$)", 1),
        "file_path": path,
        # The source: a file, or the folder that a writer filled with part files.
        "source_path": F.regexp_extract(path, r"^(.*?/[^/]+?\.csv)(?:/|$)", 1),
    }


def discover(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Every CSV below ``root`` with its lineage, but for files of no bytes. No content is read."""
    listed = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter="*.csv")
        .load(root)
        .select(F.col("path"), F.col("length").alias("bytes"))
    )
    return listed.withColumns(lineage(F.col("path"))).withColumn(
        "year", path_year(below_raw(F.col("path")))
    )


def header_columns(header: str) -> list[str]:
    """Column names of a header line, cleaned; a repeated name gets a number."""
    names: list[str] = []
    for raw in next(csv.reader([header], delimiter=SEP)):
        name = repair_text(raw)
        taken = {n.lower() for n in names}
        unique, n = name, 1
        while unique.lower() in taken:
            unique, n = f"{name}_{n}", n + 1
        names.append(unique)
    return names


NOT_UTF8, UNREADABLE, OPEN_QUOTE = "not UTF-8", "unreadable", "quote never closed"


def _survey(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, split, lines, first, faults, widest): a row per split, from one scan of all lines.

    ``faults``: which of two things some line has: bytes that are no UTF-8, a cell left open.
    """
    line = F.col("line")
    fault = F.when(~F.is_valid_utf8(line), F.lit(NOT_UTF8)).when(
        records.leaves_open(line), F.lit(OPEN_QUOTE)
    )
    found = records.read_lines(spark, root).groupBy("path", "split").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min_by(F.when(F.col("split") == 0, line), "id").alias("first"),
        F.collect_set(fault).alias("faults"),
        F.max(records.n_cells(line)).alias("widest"),
    )
    return saved(found, "survey")


def _folded(spark: SparkSession, root: str | list[str], files: DataFrame) -> str | None:
    """The folder of the records of those files whose lines are not records, if there are any."""
    several = files.where(F.col("folds")).select("path")
    if several.isEmpty():
        return None
    lines = records.read_lines(spark, root).join(several, "path", "left_semi")
    folder = scratch_dir(spark, "records")
    first = F.col("number") == 1
    records.fold_lines(lines).withColumn("is_header", first).write.parquet(folder)
    return folder


def manifest(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Every CSV below ``root``: lineage, header, ``columns``, or the ``error`` that bars it.

    A file that can't be read, has a byte that is not UTF-8 anywhere, or a quote that is never
    closed has an error and no columns; loads go on without it. ``overlong``: some row has more
    cells than the header. A header may hold line breaks in quotes. All this comes from one scan,
    and one more of those files where a cell holds line breaks (their records are written to
    ``records``, a folder). What reaches the driver are the distinct headers. Lines end with \\n
    or \\r\\n.
    """
    survey = _survey(spark, root)
    per_file = survey.groupBy("path").agg(
        F.max("first").alias("header"),
        F.max(F.array_contains("faults", F.lit(NOT_UTF8))).alias("undecodable"),
        F.max(F.array_contains("faults", F.lit(OPEN_QUOTE))).alias("folds"),
        F.max("widest").alias("widest"),
    )
    per_file = per_file.withColumn("folds", F.col("folds") & ~F.col("undecodable"))
    folder = _folded(spark, root, per_file)
    if folder is not None:
        own = (
            spark.read.parquet(folder)
            .groupBy("path")
            .agg(
                F.max(F.when(F.col("is_header"), F.col("record"))).alias("whole_header"),
                F.max("open").alias("unclosed"),
                F.max(records.n_cells(F.col("record"))).alias("widest_record"),
            )
        )
        per_file = (
            per_file.join(own, "path", "left")
            .withColumn("header", F.coalesce("whole_header", "header"))
            .withColumn("widest", F.coalesce("widest_record", "widest"))
        )
    else:
        per_file = per_file.withColumn("unclosed", F.lit(False))
    error = (
        F.when(F.col("undecodable"), F.lit(NOT_UTF8))
        .when(F.col("unclosed"), F.lit(OPEN_QUOTE))
        .when(F.col("header").isNull() & (F.col("bytes") > 0), F.lit(UNREADABLE))
    )
    listed = discover(spark, root).join(per_file, "path", "left").withColumns(
        {
            "error": error,
            "header": F.coalesce("header", F.lit("")),
            "records": F.when(F.col("folds"), F.lit(folder).cast("string")),
        }
    )
    listed = saved(listed.drop("undecodable", "folds", "unclosed", "whole_header", "widest_record"), "manifest")
    headers = listed.filter("error IS NULL").select("header").distinct().collect()
    parsed = [(r.header, header_columns(r.header)) for r in headers]
    names = spark.createDataFrame(parsed, "header string, columns array<string>")
    named = listed.join(names, "header", "left")
    return named.withColumns(
        {
            "columns": F.when(F.col("error").isNull(), F.col("columns")),
            "overlong": F.coalesce(F.col("error").isNull() & (F.col("widest") > F.size("columns")), F.lit(False)),
        }
    ).drop("widest")


def quarantine(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """(file_path, line, reason, content): the rows for which a manifest bars or marks a file.

    One row per line that is not UTF-8 (content decoded with replacement marks), per record with
    more cells than the header, and per quote that is never closed (its first line). ``line`` counts
    from 1. Only files that the manifest names are looked at again; nothing is read if there are
    none.
    """
    listed = manifest(spark, root) if listed is None else listed
    named = listed.where((F.col("error") == NOT_UTF8) | F.col("overlong"))
    wanted = named.where("records IS NULL").select("path", "error", F.size("columns").alias("width"))
    shape = "file_path string, line long, reason string, content string"
    found = spark.createDataFrame([], shape)
    line, is_bad = F.col("line"), F.col("error") == NOT_UTF8
    too_long = F.lit("more cells than the header")
    if not wanted.isEmpty():
        lines = records.read_lines(spark, root).join(wanted, "path")
        in_split = Window.partitionBy("path", "split").orderBy("id")
        placed = saved(lines.withColumn("place", F.row_number().over(in_split)), "barred-lines")
        above = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        splits = placed.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n")).select(
            "path", "split", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")
        )
        reason = F.when(is_bad & ~F.is_valid_utf8(line), F.lit(NOT_UTF8)).when(
            ~F.coalesce(is_bad, F.lit(False)) & (records.n_cells(line) > F.col("width")), too_long
        )
        rows = placed.join(splits, ["path", "split"]).select(
            F.col("path").alias("file_path"),
            (F.col("above") + F.col("place")).alias("line"),
            reason.alias("reason"),
            F.make_valid_utf8(line).alias("content"),
        )
        found = found.unionByName(rows.where("reason IS NOT NULL"))
    for folder in _record_folders(listed):
        files = listed.where("records IS NOT NULL").select("path", F.size("columns").alias("width"))
        reason = F.when(F.col("open"), F.lit(OPEN_QUOTE)).when(
            records.n_cells(F.col("record")) > F.col("width"), too_long
        )
        rows = spark.read.parquet(folder).join(files, "path").select(
            F.col("path").alias("file_path"),
            F.col("number").alias("line"),
            reason.alias("reason"),
            F.col("record").alias("content"),
        )
        found = found.unionByName(rows.where("reason IS NOT NULL"))
    return found


def _record_folders(listed: DataFrame) -> list[str]:
    """Where the manifest's files with line breaks in cells have their records: one folder, if any."""
    return [r.records for r in listed.where("records IS NOT NULL").select("records").distinct().collect()]


def schema_profile(spark: SparkSession, root: str) -> DataFrame:
    """The columns of each category's first file, or why it cannot be read.

    Files are listed; of their content, that of one file per category is read.
    """
    first = discover(spark, root).groupBy("category").agg(F.min("path").alias("path"))
    # A row per category reaches the driver. Marks of patterns in a path stand for themselves.
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in first.collect()]
    if not paths:
        return spark.createDataFrame([], "category string, columns string")
    error = F.concat(F.lit("error: "), F.col("error"))
    return manifest(spark, paths).select(
        "category", F.coalesce(F.array_join("columns", ", "), error).alias("columns")
    )


def _no_missing_text(cell: Column) -> Column:
    return F.when(~cell.isin(*MISSING_CELLS), cell)


def _places(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, list[int]]:
    """For each output column the places of its cells in a row: the first one filled counts.

    Keys are in lower case, since column names are told apart without it.
    """
    places = {name.lower(): [at] for at, name in enumerate(columns)}
    for canon, names in aliases.items():
        if canon.lower() not in places:
            candidates = alias_candidates(columns, names)
            if candidates:
                places[canon.lower()] = [columns.index(c) for c in candidates]
    return places


def load_lake(
    spark: SparkSession,
    root: str,
    aliases: dict[str, list[str]] | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Every readable file as one table: union of all columns as text, ``total_num``, lineage.

    One scan for all layouts: cells are read by position and named through the manifest, a row
    per file. A cell is cleaned once it is chosen, so columns that nobody asks for cost nothing.
    Files whose cells hold line breaks come from the records that the manifest has made of them;
    files of any size are many tasks. ``overlong`` marks rows with more cells than their header,
    ``bad_file`` all rows of a file that has such a row. ``listed``: the manifest, if at hand.
    """
    listed = manifest(spark, root) if listed is None else listed
    readable = listed.filter("error IS NULL AND header <> ''")
    heads = readable.groupBy("header").agg(
        F.min("path").alias("first"), F.any_value("columns").alias("columns")
    )
    found = sorted(heads.collect(), key=lambda r: r.first)  # one row a layout
    if not found:
        raise FileNotFoundError(f"no readable CSV below {root}")
    wanted = LAKE_HEADERS if aliases is None else aliases
    layouts = [(r.header, len(r.columns), _places(r.columns, wanted)) for r in found]
    spelt = [n for r in found for n in r.columns] + list(wanted) + ["Total"]
    used = {n for _, _, places in layouts for n in places} | {"total"}
    first: dict[str, str] = {}
    for name in spelt:
        if name.lower() in used:
            first.setdefault(name.lower(), name)
    names = list(first.values())
    width = max(n for _, n, _ in layouts) + 1
    shape = [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
    options = {"sep": SEP, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    raw = (
        spark.read.schema(T.StructType([*shape, T.StructField(UNREAD, T.StringType())]))
        .options(
            header=True, encoding="UTF-8", recursiveFileLookup=True, pathGlobFilter="*.csv",
            ignoreCorruptFiles=True, **options,
        )
        .csv(root)
    )
    whole = [c.name for c in shape]
    by_header = spark.createDataFrame(
        layouts, "header string, _width int, _places map<string, array<int>>"
    )
    about = readable.select("path", "header", "records", F.col("overlong").alias("bad_file")).join(
        by_header, "header"
    )
    # A row per file goes to the rows, which would else be dealt out by their file.
    sent = F.broadcast if readable.count() <= MAX_SENT_FILES else lambda rows: rows
    plain = raw.select(
        decoded_path(F.col("_metadata.file_path")).alias("path"), F.array(*whole).alias("_cells")
    ).join(sent(about.where("records IS NULL")), "path")
    for folder in _record_folders(listed):
        rows = spark.read.parquet(folder).where("NOT is_header AND NOT open AND trim(record) <> ''")
        parsed = F.from_csv("record", ", ".join(f"{c} string" for c in whole), options)
        cells = rows.select("path", parsed.alias("_row")).select(
            "path", F.array(*[F.col(f"_row.{c}") for c in whole]).alias("_cells")
        )
        plain = plain.unionByName(cells.join(sent(about.where("records IS NOT NULL")), "path"))

    def cell(name: str) -> Column:
        places = F.try_element_at("_places", F.lit(name.lower()))
        cleaned = F.transform(places, lambda at: _no_missing_text(clean_cell(F.get("_cells", at))))
        return F.get(F.filter(cleaned, lambda x: x.isNotNull()), F.lit(0)).alias(name)

    named = plain.select(
        *[cell(n) for n in names],
        *[expr.alias(name) for name, expr in lineage(F.col("path")).items()],
        F.get("_cells", F.col("_width")).isNotNull().alias("overlong"),
        "bad_file",
    )
    return named.select(
        *[F.col(f"`{c}`") for c in names],
        parse_number_es(F.col("Total")).alias("total_num"),
        path_year(below_raw(F.col("file_path"))).alias("path_year"),
        *LINEAGE,
        "overlong",
        "bad_file",
    )


def good_files(facts: DataFrame) -> DataFrame:
    """Facts without the files that hold an overlong row: a bad file brings nothing.

    The manifest knows them, so the lake is not parsed for it.
    """
    return facts.filter(~F.col("bad_file"))


def ingest_report(listed: DataFrame, facts: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """One row per file of a manifest: OK with its record count, SKIP with the reason, or ERROR."""
    routed = F.col("category").isin(*CATEGORY_FAMILY)
    per_file = facts.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("total_num").alias("with_total"),
    )
    status = (
        F.when(~routed, F.lit("SKIP_CATEGORY"))
        .when(F.col("error").isNotNull(), F.lit("ERROR"))
        .when(~F.array_contains("columns", F.lit("Total")), F.lit("SKIP_NO_TOTAL"))
        .when(F.col("overlong"), F.lit("ERROR"))
        .otherwise(F.lit("OK"))
    )
    return listed.join(per_file, "file_path", "left").select(
        "category",
        "wave",
        "file_name",
        "file_path",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("with_total", F.lit(0)).alias("with_total"),
        status.alias("status"),
        F.when(status == "OK", F.least(F.coalesce("with_total", F.lit(0)), F.lit(cap)))
        .otherwise(F.lit(0))
        .alias("records"),
    )


def indicator_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The licence and the spend table of a lake, as the indicators read them."""

    def table(category: str, file_name: str, dims: list[str]) -> DataFrame:
        rows = facts.filter((F.col("category") == category) & (F.col("file_name") == file_name))
        return rows.select(*dims, "periodo", "Total", F.col("file_name").alias("archivo_origen"))

    return (
        table("deporte_federado", LICENCE_FILE, ["Federación", "Comunidad autónoma"]),
        table("gasto_hogares", SPEND_FILE, ["Indicador", "Comunidad autónoma"]),
    )
