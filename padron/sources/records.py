"""Records of delimited files from lines, so that a file of any size is many tasks.

A cell in quotes may hold line breaks. Whether a line starts a record depends on all lines
before it, but only by one bit: whether a quote is open. Each line maps that bit to the next
line's, so lines of one split are folded by a running count, splits of one file likewise (a row
per split), and every line learns its state without any task reading a file whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from padron.functions.text import BOM
from padron.session import saved

SEP = ";"
#: A record of more lines is an open quote that swallows the file, not a cell.
MAX_LINES = 10_000
#: Most splits whose states are sent to the lines; beyond it, lines move to them.
MAX_SENT_SPLITS = 100_000

# Complete cells from the start of a line, each with its separator.
_CELLS = r'\G(?:"[^"]*+(?:""[^"]*+)*+"[^;]*+|[^";][^;]*+|);'
# What is left is the last cell: its quote is not closed.
_OPEN = r'^"[^"]*+(?:""[^"]*+)*+$'


def decoded_path(path: Column) -> Column:
    """A metadata path as listed: it is percent-encoded, with plus signs left as they are."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, split, id, line): ``id`` rises within a split; ``split`` is its place in the file."""
    lines = (
        spark.read.options(
            recursiveFileLookup=True, pathGlobFilter="*.csv", ignoreCorruptFiles=True, lineSep="\n"
        )
        .text(root)
        .select(
            decoded_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
            F.rtrim("value", F.lit("\r")).alias("line"),
        )
    )
    bare = F.when(F.startswith("line", F.lit(BOM)), F.substr("line", F.lit(2))).otherwise(F.col("line"))
    return lines.withColumn("line", bare)


def leaves_open(line: Column) -> Column:
    """Whether a quoted cell is open at the end of a line that starts outside of one."""
    last = F.regexp_replace(line, _CELLS, "")
    return F.contains(line, F.lit('"')) & last.rlike(_OPEN)


def stays_open(line: Column) -> Column:
    """The same for a line that starts inside of one."""
    return ~F.contains(line, F.lit('"')) | leaves_open(F.concat(F.lit('"'), line))


def n_cells(record: Column) -> Column:
    """Cells up to the last one that is filled."""
    quoted = F.regexp_replace(record, '"[^"]*"', "x")
    plain = F.when(F.contains(record, F.lit('"')), quoted).otherwise(record)
    filled = F.rtrim(plain, F.lit(SEP + " \t\r\n"))
    return F.length(filled) - F.length(F.replace(filled, F.lit(SEP), F.lit(""))) + 1


def _states(rows: DataFrame, keys: list[str], order: str, after_shut: Column, after_open: Column) -> DataFrame:
    """Add ``if_shut`` and ``if_open``: the state before each row, for both states before the first.

    A row either sets the state (both results equal), turns it, or leaves it: so it is that of
    the last row that sets it, turned as often as rows since then turn.
    """
    turns = (after_shut & ~after_open).cast("long")
    sets = after_shut == after_open
    upto = Window.partitionBy(*keys).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumns({"_turns": F.sum(turns).over(upto), "_own": turns})
    mark = F.when(sets, F.struct(after_shut.alias("state"), F.col("_turns").alias("turns")))
    counted = counted.withColumn("_mark", mark).withColumn(
        "_last", F.last("_mark", ignorenulls=True).over(before)
    )
    turned = F.col("_turns") - F.col("_own")
    odd = F.pmod(turned - F.coalesce("_last.turns", F.lit(0)), F.lit(2)) == 1
    known = F.col("_last.state") != odd
    return counted.withColumns(
        {"if_shut": F.coalesce(known, odd), "if_open": F.coalesce(known, ~odd)}
    ).drop("_turns", "_own", "_mark", "_last")


def fold_lines(lines: DataFrame) -> DataFrame:
    """Records of whole files: (path, id, number, record, lines, open).

    ``id`` rises with the place in a split; ``number`` is the line it starts with, from 1.
    ``open``: its quote is never closed, or only after ``MAX_LINES``; then ``record`` is its first
    line. The lines are written once, with both states that they may start in; the states of
    splits are sent to them.
    """
    in_split = ["path", "split"]
    shut, opened = leaves_open(F.col("line")), stays_open(F.col("line"))
    found = _states(
        lines.withColumns({"a_shut": shut, "a_open": opened}), in_split, "id", F.col("a_shut"), F.col("a_open")
    )
    place = F.row_number().over(Window.partitionBy(*in_split).orderBy("id"))
    found = saved(found.withColumn("place", place), "lines")

    # One row per split: its effect as a whole, and so the state that it starts in.
    after = [
        F.when(F.col(c), F.col("a_open")).otherwise(F.col("a_shut")).alias(n)
        for c, n in (("if_shut", "a_shut"), ("if_open", "a_open"))
    ]
    splits = found.groupBy(*in_split).agg(
        F.max_by(F.struct(*after), "id").alias("last"), F.count(F.lit(1)).alias("n")
    ).select(*in_split, "last.a_shut", "last.a_open", "n")
    upto = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = _states(splits, ["path"], "split", F.col("a_shut"), F.col("a_open")).select(
        *in_split, F.col("if_shut").alias("inside"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("above")
    )

    splits = saved(splits, "splits")
    sent = F.broadcast if splits.count() <= MAX_SENT_SPLITS else lambda rows: rows

    before = F.when(F.col("inside"), F.col("if_open")).otherwise(F.col("if_shut"))
    stated = found.join(sent(splits), in_split).withColumn("before", before)
    stated = stated.withColumn(
        "after", F.when(F.col("before"), F.col("a_open")).otherwise(F.col("a_shut"))
    ).withColumn("number", F.col("above") + F.col("place"))
    stated = stated.select(*in_split, "id", "line", "number", "before", "after")

    single = stated.where(~F.col("before") & ~F.col("after")).select(
        "path", "id", "number", F.col("line").alias("record"), F.lit(1).cast("long").alias("lines"),
        F.lit(False).alias("open"),
    )
    # Lines of longer records: the start is in the same split, or the last one of those above.
    parts = stated.where(F.col("before") | F.col("after"))
    own = F.last(F.when(~F.col("before"), F.struct("number", "id")), ignorenulls=True)
    started = parts.withColumn("start", own.over(Window.partitionBy(*in_split).orderBy("id")))
    last = parts.where(~F.col("before")).groupBy(*in_split).agg(F.max(F.struct("number", "id")).alias("s"))
    every = parts.select(*in_split).distinct().join(last, in_split, "left")
    carried = every.select(*in_split, F.last("s", ignorenulls=True).over(upto).alias("carried"))
    carried = saved(carried, "carried")  # a row per split at most
    started = started.join(sent(carried), in_split).withColumn("start", F.coalesce("start", "carried"))
    # At most MAX_LINES lines of a record meet in one group.
    near = F.col("number") < F.col("start.number") + MAX_LINES
    whole = started.groupBy("path", "start").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max_by("after", "number").alias("unclosed"),
        F.sort_array(F.collect_list(F.when(near, F.struct("number", "line")))).alias("found"),
    )
    is_open = F.col("unclosed") | (F.col("lines") > MAX_LINES)
    kept = F.when(is_open, F.slice("found", 1, 1)).otherwise(F.col("found"))
    whole = whole.select("path", "start", "lines", is_open.alias("open"), kept["line"].alias("found"))
    longer = whole.select(
        "path", "start.id", "start.number", F.array_join("found", "\n").alias("record"), "lines", "open"
    )
    return single.unionByName(longer)
