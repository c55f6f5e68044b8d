"""Transcripts to turns: a hidden Markov model over lines recovers who speaks.

A transcript is rows (key, order, text). Each line has a symbol: the kind of speaker marker it
begins with, whether it follows a blank line, its length, and whether it asks. States are a role
and whether the line begins a turn or goes on. Start, transition and symbol probabilities are
counted in Spark over rows whose role is known; Viterbi gives the most probable states; a turn is
a begin line without its marker and what follows it as it is, without outer blank lines. The
query knows the roles of half of the conversations, by a hash of the key, and recovers all.

A conversation may be longer than a task can hold. Lines are sorted into chunks of at most
``CHUNK`` lines. Chunks of a conversation that has several are first reduced to a matrix (best
score from each state before to each state at the end); the matrices fix the states at the chunks'
borders, and then all chunks are decoded by themselves. What the line before a chunk was is carried
over its border, a row per chunk. So counts and path are those of the whole.

Defined results: a null text is one blank line; a null key is a conversation of its own; a null
order comes first. Rows of equal key and order keep the order they are read in. Blank-only turns
stay, with an empty text. Rows with an unknown role are not learned from. A table without known
roles gives the model's starting beliefs (markers mean what they say). Input columns other than
those named are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from padron.llm.words import runs
from padron.session import saved

ROLES = ("system", "user", "assistant")
#: State numbers: role * 2, plus 1 for a line that goes on.
STATES = 2 * len(ROLES)
CHUNK = 4096

# How speakers are marked.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "question", "q", "you", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model"),
}
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instructions: ", "### Human: ", "### Assistant: "),
    ("[SYSTEM] ", "[USER] ", "[BOT] "),
    ("context> ", "you> ", "ai> "),
    ("Sys: ", "Q: ", "A: "),
)
_LENGTHS = (1, 60, 200, 600)
SYMBOLS = 5 * 2 * 5 * 2


def _marker(names: tuple[str, ...]) -> str:
    either = "|".join(names)
    return rf"(?i)^\s*(?:#+\s*)?(?:\[\s*(?:{either})\s*\]|(?:{either})\s*[:>])\s*"


_ANY = r"^\s*[\p{L}][\p{L}\p{N} _]{0,20}:\s"
_ALL = _marker(tuple(n for names in MARKERS.values() for n in names))


def without_marker(line: Column) -> Column:
    return F.regexp_replace(line, _ALL, "")


def _symbol(line: Column, after_blank: Column) -> Column:
    """A line's observation as one number."""
    kind = F.when(line.rlike(_marker(MARKERS["system"])), 1)
    kind = kind.when(line.rlike(_marker(MARKERS["user"])), 2)
    kind = kind.when(line.rlike(_marker(MARKERS["assistant"])), 3)
    kind = kind.when(line.rlike(_ANY), 4).otherwise(0)
    size = F.lit(0)
    for least in _LENGTHS:
        size = size + (F.length(F.btrim(line)) >= least).cast("int")
    asks = F.btrim(line).endswith("?").cast("int")
    return ((kind * 2 + after_blank.cast("int")) * 5 + size) * 2 + asks


def transcript_rows(
    df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Turns as raw transcript text: one of five marker styles a conversation; one marker in eight
    is missing; a blank line ends each turn. The role is kept for learning and comparison."""
    style = F.pmod(F.xxhash64(F.lit("style"), F.col(key)), F.lit(len(STYLES)))
    marker = F.lit("")
    for number, marks in enumerate(STYLES):
        for name, mark in zip(ROLES, marks, strict=True):
            marker = F.when((style == number) & (F.col(role) == name), F.lit(mark)).otherwise(marker)
    missing = F.pmod(F.xxhash64(F.lit("marker"), F.col(key), F.col(order)), F.lit(8)) == 0
    marker = F.when(missing, F.lit("")).otherwise(marker)
    raw = F.concat(marker, F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    return df.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(role).alias("role"), raw.alias("raw"))


def sorted_lines(rows: DataFrame) -> DataFrame:
    """(name, chunk, seq, line, symbol, before, state): lines in order, written.

    ``name`` is the key as text, ``before`` the state of the line before. ``seq`` rises along the whole table; a chunk is a stretch of one file part. Rows are dealt
    out by range, so a long conversation lies in several parts.
    """
    known = F.lit(None).cast("int")
    for number, name in enumerate(ROLES):
        known = F.when(F.col("role") == name, 2 * number).otherwise(known)
    name = F.coalesce(F.col("key").cast("string"), F.lit("\0"))
    lines = F.split(F.coalesce("raw", F.lit("")), "\n", -1)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        rows.select(name.alias("name"), "order", known.alias("begin"), "raw")
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, "name", "order", "tie")
        .sortWithinPartitions("name", "order", "tie")
        .withColumn("row", F.monotonically_increasing_id())
    )
    exploded = placed.select("name", "row", "begin", F.posexplode(lines).alias("at", "line"))
    exploded = exploded.withColumn("seq", F.monotonically_increasing_id())
    chunk = F.expr(f"(seq >> 33) * {1 << 33} + (seq & {(1 << 33) - 1}) div {CHUNK}")
    written = saved(exploded.withColumn("chunk", chunk), "chat-lines")
    state = F.col("begin") + (F.col("at") > 0).cast("int")
    own = F.struct((F.btrim("line") == "").alias("blank"), state.alias("state"))
    told = written.withColumn("own", own)
    inside = Window.partitionBy("name", "chunk").orderBy("seq")
    # The last line of the chunk before, for conversations of several chunks.
    ends = told.groupBy("name", "chunk").agg(F.max_by("own", "seq").alias("last"))
    carried = ends.withColumn("last", F.lag("last").over(Window.partitionBy("name").orderBy("chunk")))
    told = told.join(carried.where("last IS NOT NULL"), ["name", "chunk"], "left")
    before = F.coalesce(F.lag("own").over(inside), F.col("last"))
    told = told.withColumn("line_before", before)
    after_blank = F.coalesce(F.col("line_before.blank"), F.lit(True))
    return saved(
        told.select(
            "name", "chunk", "seq", "line",
            _symbol(F.col("line"), after_blank).alias("symbol"),
            F.col("line_before").isNull().alias("first"),
            F.col("line_before.state").alias("before"),
            F.col("own.state").alias("state"),
        ),
        "chat-symbols",
    )


@dataclass
class Model:
    """Logarithms of probabilities."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # state x symbol


def believed() -> Model:
    """Counts to begin with: a few made-up observations that say what markers mean."""
    start = np.ones(STATES) * 0.01
    start[::2] = 1
    moves = np.full((STATES, STATES), 0.01)
    for role in range(len(ROLES)):
        moves[2 * role : 2 * role + 2, 2 * role + 1] = 2
        for other in range(len(ROLES)):
            moves[2 * role : 2 * role + 2, 2 * other] = 0.2 if role == other else 0.5
    emits = np.full((STATES, SYMBOLS), 0.02)
    per = SYMBOLS // 5
    for role in range(len(ROLES)):
        emits[2 * role, (role + 1) * per : (role + 2) * per] += 0.3
        emits[2 * role, :per] += 0.02
        emits[2 * role + 1, :per] += 0.2
    return Model(start, moves, emits)


def learned(lines: DataFrame) -> Model:
    """Probabilities from all lines whose state is known; a step needs both of its states."""
    model = believed()
    labelled = lines.where("state IS NOT NULL")
    for row in labelled.groupBy("state", "symbol").count().collect():
        model.emits[row["state"], row["symbol"]] += row["count"]
    for row in labelled.groupBy("first", "before", "state").count().collect():
        if row["first"]:
            model.start[row["state"]] += row["count"]
        elif row["before"] is not None:
            model.moves[row["before"], row["state"]] += row["count"]
    return Model(
        np.log(model.start / model.start.sum()),
        np.log(model.moves / model.moves.sum(1, keepdims=True)),
        np.log(model.emits / model.emits.sum(1, keepdims=True)),
    )


def decoded(symbols: list[int], model: Model, entry: int | None, exit_: int | None) -> list[int]:
    """The best states, after ``entry`` (None: a start) and ending in ``exit_`` (None: any)."""
    moves, emits = model.moves.T.tolist(), model.emits.T.tolist()
    first = model.start if entry is None else model.moves[entry]
    best = (first + model.emits[:, symbols[0]]).tolist()
    back = []
    for symbol in symbols[1:]:
        emit, new, origin = emits[symbol], [], []
        for to in range(STATES):
            options = [b + m for b, m in zip(best, moves[to], strict=True)]
            top = max(options)
            new.append(top + emit[to])
            origin.append(options.index(top))
        best = new
        back.append(origin)
    state = best.index(max(best)) if exit_ is None else exit_
    out = [state]
    for origin in reversed(back):
        state = origin[state]
        out.append(state)
    return out[::-1]


def reduced(symbols: list[int], model: Model, entry: bool) -> np.ndarray:
    """Best scores from each state before (or, for a first chunk, the start) to each at the end."""
    rows = model.moves if entry else np.where(np.arange(STATES)[:, None] == 0, model.start, -math.inf)
    best = rows + model.emits[:, symbols[0]]
    for symbol in symbols[1:]:
        best = (best[:, :, None] + model.moves[None]).max(1) + model.emits[:, symbol]
    return best


def _borders(lines: DataFrame, model: Model) -> DataFrame:
    """(name, chunk, entry, exit) for conversations of several chunks."""
    # A row per chunk: a conversation's lines never meet in one task.
    chunks = lines.select("name", "chunk").distinct()
    several = (
        chunks.groupBy("name")
        .agg(F.min("chunk").alias("head"), F.max("chunk").alias("tail"))
        .where("head <> tail")
    )
    marked = chunks.join(several, "name").select("name", "chunk", "head")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in runs(batches, ["name", "chunk"]):
            rows = [
                (name, chunk, reduced(part["symbol"].tolist(), model, chunk != part["head"].iat[0]).ravel().tolist())
                for (name, chunk), part in batch.groupby(["name", "chunk"], sort=False)
            ]
            yield pd.DataFrame(rows, columns=["name", "chunk", "scores"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        steps = [np.array(s).reshape(STATES, STATES) for s in rows["scores"]]
        best, back = steps[0][0], []
        for step in steps[1:]:
            options = best[:, None] + step
            back.append(options.argmax(0))
            best = options.max(0)
        state = int(best.argmax())
        ends = [state]
        for origin in reversed(back):
            state = int(origin[state])
            ends.append(state)
        ends.reverse()
        return pd.DataFrame(
            {"name": rows["name"], "chunk": rows["chunk"], "entry": [-1, *ends[:-1]], "exit": ends}
        )

    parts = lines.join(marked, ["name", "chunk"]).select("name", "chunk", "seq", "symbol", "head")
    matrices = (
        parts.repartition("name", "chunk")
        .sortWithinPartitions("name", "chunk", "seq")
        .mapInPandas(reduce, "name string, chunk long, scores array<double>")
    )
    return matrices.groupBy("name").applyInPandas(
        chain, "name string, chunk long, entry int, exit int"
    )


def labelled(lines: DataFrame, model: Model) -> DataFrame:
    """(name, chunk, seq, line, found, nth): decoded states; ``nth`` turns begin in the chunk so far."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in runs(batches, ["name", "chunk"]):
            found = []
            for _, part in batch.groupby(["name", "chunk"], sort=False):
                entry, end = part["entry"].iat[0], part["exit"].iat[0]
                several = not pd.isna(end)
                first = not several or entry < 0
                states = decoded(
                    part["symbol"].tolist(), model, None if first else int(entry), int(end) if several else None
                )
                begins = np.array(states) % 2 == 0
                begins[0] |= first
                found.append((states, np.cumsum(begins)))
            yield batch[["name", "chunk", "seq", "line"]].assign(
                found=np.concatenate([f[0] for f in found]), nth=np.concatenate([f[1] for f in found])
            )

    joined = lines.join(_borders(lines, model), ["name", "chunk"], "left")
    return (
        joined.select("name", "chunk", "seq", "line", "symbol", "entry", "exit")
        .repartition("name", "chunk")
        .sortWithinPartitions("name", "chunk", "seq")
        .mapInPandas(decode, "name string, chunk long, seq long, line string, found int, nth long")
    )


def turns(lines: DataFrame, model: Model, kind: DataType) -> DataFrame:
    """(key, turn, role, text, rendered) of each recovered turn, numbered from 0."""
    states = saved(labelled(lines, model), "chat-states")
    counts = states.groupBy("name", "chunk").agg(F.max("nth").alias("begun"))
    earlier = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "name", "chunk", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("before")
    )
    begins = F.col("found") % 2 == 0
    body = F.when(begins, without_marker(F.col("line"))).otherwise(F.col("line"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.shiftright("found", 1) + 1).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", body.alias("body"), role.alias("role"))))
    grouped = (
        states.join(offsets, ["name", "chunk"])
        .withColumn("turn", F.col("nth") + F.col("before") - 1)
        .groupBy("name", "turn")
        .agg(ordered.alias("lines"))
    )
    joined = F.array_join(F.transform("lines", lambda x: x["body"]), "\n")
    text = F.regexp_replace(joined, r"^\n+|\n+$", "")
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return (
        grouped.select(F.nullif("name", F.lit("\0")).cast(kind).alias("key"), "turn", F.get("lines", F.lit(0))["role"].alias("role"), text.alias("text"))
        .withColumn("rendered", rendered)
    )


def learned_from(key: Column) -> Column:
    """Whether a conversation is of the half whose roles the query knows."""
    return F.pmod(F.xxhash64(F.lit("learn"), key), F.lit(2)) == 0


def report(df: DataFrame) -> DataFrame:
    """Turns recovered from transcripts of a conversation table, roles of one half being known."""
    rows = transcript_rows(df)
    found = parsed(rows.withColumn("role", F.when(learned_from(F.col("key")), F.col("role"))))
    return found.withColumnRenamed("key", "conv_id")


def parsed(rows: DataFrame) -> DataFrame:
    """Turns of transcript rows (key, order, role or null, raw)."""
    lines = sorted_lines(rows)
    return turns(lines, learned(lines), rows.schema["key"].dataType)
