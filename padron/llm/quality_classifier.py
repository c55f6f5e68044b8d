"""Quality classifier from overlapping weak labellers.

1. Nine heuristic labellers vote good, bad or nothing on each document.
2. Documents with equal votes are counted, over all rows. Expectation-maximisation on these counts
   (at most 3**9 rows) estimates how often each labeller is right about good and about bad
   documents, and the share of good ones. No labels are used.
3. The posterior of a document's votes is the soft label on which a linear scorer of hashed
   features is trained, from all documents. Each text is read once: its votes and features are
   written beside its row, and every round of training is a Spark job that adds up a gradient of
   them. From ``2 * PART_DOCS`` documents on, parts of the documents take turns in the rounds
   (``PARTS`` at most, dealt by a hash of id and text), so each is learned from 15 times or more.
4. The scorer judges every document.

Defined results: a null or empty text has no words and no features but "empty"; all labellers but
one are silent on it and it is rejected. Rows of equal text have equal scores. Rows without id are
learned from like others. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.llm.quality_rules import COMMON, repeat_words
from padron.llm.words import ROWS_AT_ONCE, WordMemory, remembered, slices, word_hash
from padron.session import removed, saved, scratch_dir, small_batches

#: Parts of the documents that take turns in training, at most, and the documents of a part, at least.
PARTS, PART_DOCS = 8, 8000
#: Divided evenly by any number of parts.
TURNS = 840
#: Hashed features.
BITS = 15
ROUNDS = 120
GOOD, BAD, SILENT = 1, 0, 2

_COMMON = {w.encode() for text in COMMON.values() for w in text.split()}
_EDGES = b".,;:!?'\"()-"
_SYMBOLS, _WHITE = list(b"#*$%&|<>^~{}=\\"), list(b" \t\n\x0b\x0c\r")

# Labeller: (name, bad below, good from, good to, bad above); between, it is silent.
RULES = (
    ("words", 1, 20, 1e9, 1e18),
    ("symbols", -1, 0, 0.01, 0.04),
    ("repeats", -1, 0, 0.2, 0.85),
    ("dup_lines", -1, 0, 0.1, 0.5),
    ("capitals", -1, 0, 0.12, 0.3),
    ("function_words", 0.06, 0.12, 1, 2),
    ("word_length", 2.2, 3, 9, 14),
    ("bare_symbols", -1, 0, 0.01, 0.05),
    ("distinct_words", 0.12, 0.3, 1, 2),
)
#: Labellers that say nothing about texts of fewer words.
LEAST_WORDS = 20


def _code(word: bytes) -> int:
    """A word's bucket, its shape's bucket and whether it is common or bare, in one number."""
    core = word.strip(_EDGES)
    shape = bytes(
        dict.fromkeys(
            120 if 97 <= b <= 122 or b >= 128 else 88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b
            for b in word[:40]
        )
    )
    common = core.lower() in _COMMON
    bare = not any(b >= 128 or chr(b).isalnum() for b in word)
    mask = (1 << BITS) - 1
    h = word_hash(word)
    return (h & mask) | (word_hash(b"shape " + shape) & mask) << 16 | common << 32 | bare << 33 | (h >> 36) << 36


@dataclass
class Document:
    """What the labellers and the scorer see of a text."""

    numbers: dict[str, float]
    words: np.ndarray
    shapes: np.ndarray


def seen(text: str | None, memory: WordMemory) -> Document:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    n = len(found)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    code = np.fromiter(map(memory.__getitem__, found), np.uint64, n)
    chars = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(found))
    low = np.uint64((1 << 16) - 1)
    per = max(1, n)
    numbers = {
        "words": n,
        "symbols": int(bytes_[_SYMBOLS].sum()) / chars,
        "repeats": repeat_words(code) / per,
        "dup_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "capitals": int(bytes_[65:91].sum()) / chars,
        "function_words": float((code >> np.uint64(32) & np.uint64(1)).sum()) / per,
        "word_length": (len(data) - int(bytes_[_WHITE].sum())) / per,
        "bare_symbols": float((code >> np.uint64(33) & np.uint64(1)).sum()) / per,
        "distinct_words": distinct / per if n < 300 else distinct / (300 * n) ** 0.5,
    }
    return Document(
        numbers, (code & low).astype(np.int64), (code >> np.uint64(16) & low).astype(np.int64)
    )


def votes(doc: Document) -> list[int]:
    out = []
    for name, bad_below, good_from, good_to, bad_above in RULES:
        x = doc.numbers[name]
        if name != "words" and doc.numbers["words"] < LEAST_WORDS:
            out.append(SILENT)
        elif x < bad_below or x > bad_above:
            out.append(BAD)
        else:
            out.append(GOOD if good_from <= x <= good_to else SILENT)
    return out


@dataclass
class LabelModel:
    """Share of good documents; per labeller, how often it is right about good and bad ones."""

    good: float
    right: np.ndarray  # row 0: on bad documents, row 1: on good ones

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        odds = np.full(len(votes), np.log(self.good / (1 - self.good)))
        on_bad, on_good = self.right
        odds += np.where(votes == GOOD, np.log(on_good / (1 - on_bad)), 0).sum(1)
        odds += np.where(votes == BAD, np.log((1 - on_good) / on_bad), 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def estimated(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct rows of votes and how often they occur.

    It starts from "one bad vote makes it rather bad" and adds a few made-up right votes to each
    labeller, so that one that never votes keeps a defined accuracy.
    """
    p = np.where((votes == BAD).any(1), 0.25, 0.95)
    n_bad, n_good = (votes == BAD), (votes == GOOD)
    model = LabelModel(0.5, np.full((2, votes.shape[1]), 0.7))
    for _ in range(rounds):
        good, bad = counts * p, counts * (1 - p)
        total = max(float(counts.sum()), 1.0)
        right_good = ((good[:, None] * n_good).sum(0) + 4) / ((good[:, None] * (n_good | n_bad)).sum(0) + 5)
        right_bad = ((bad[:, None] * n_bad).sum(0) + 2) / ((bad[:, None] * (n_good | n_bad)).sum(0) + 5)
        model = LabelModel(
            min(max(float(good.sum()) / total, 0.01), 0.99),
            np.clip(np.array([right_bad, right_good]), 0.01, 0.999),
        )
        new = model.posterior(votes)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


# Hashed features: words and shapes by share, number levels by presence.

_LEVELS = {
    "symbols": (0.002, 0.01, 0.02, 0.04, 0.08),
    "repeats": (0.05, 0.2, 0.35, 0.5, 0.7),
    "dup_lines": (0.1, 0.3, 0.5),
    "capitals": (0.02, 0.06, 0.12, 0.3, 0.5),
    "function_words": (0.03, 0.06, 0.09, 0.12, 0.2),
    "word_length": (2.2, 3, 4, 6, 9, 14),
    "bare_symbols": (0.001, 0.01, 0.05, 0.2),
    "distinct_words": (0.05, 0.12, 0.2, 0.3, 0.5),
}


def features(doc: Document) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values."""
    n = len(doc.words)
    mask = (1 << BITS) - 1
    if n == 0:
        return np.array([word_hash(b"empty") & mask]), np.ones(1)
    names = [
        f"{name} {sum(doc.numbers[name] >= s for s in steps) if n >= LEAST_WORDS else 'short'}"
        for name, steps in _LEVELS.items()
    ]
    levels = np.array([word_hash(x.encode()) & mask for x in names])
    buckets = np.concatenate([doc.words, doc.shapes, levels])
    values = np.concatenate([np.full(2 * n, 2.0 / n), np.ones(len(levels))])
    return buckets, values


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray


def _memory() -> WordMemory:
    """One word memory per worker."""
    return remembered("codes", lambda: WordMemory(_code))


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(RULES)) % 3


def _noted(df: DataFrame, keep: list[str], key: str, text: str) -> DataFrame:
    """The kept columns, a turn, and each text's votes and features; the one pass over the texts."""

    @F.arrow_udf("code long, buckets binary, values binary")
    def notes(texts: pa.Array) -> pa.Array:
        memory, made = _memory(), []
        for a in range(0, max(1, len(texts)), ROWS_AT_ONCE):
            codes, lists, shares = [], [], []
            for text in texts[a : a + ROWS_AT_ONCE]:  # a document's words are held one document at a time
                doc = seen(text.as_py(), memory)
                buckets, values = features(doc)
                buckets, at = np.unique(buckets, return_inverse=True)
                codes.append(sum(v * 3**i for i, v in enumerate(votes(doc))))
                lists.append(buckets.astype(np.uint16).tobytes())
                shares.append(np.bincount(at, values).tobytes())
            columns = [pa.array(codes, pa.int64()), pa.array(lists, pa.binary()), pa.array(shares, pa.binary())]
            made.append(pa.StructArray.from_arrays(columns, ["code", "buckets", "values"]))
        return pa.concat_arrays(made)

    turn = F.pmod(F.xxhash64(key, text), F.lit(TURNS))
    return saved(df.select(*keep, turn.alias("_turn"), notes(F.col(text)).alias("_seen")), "features")


def _side_by_side(buckets: Iterable[bytes], values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of documents in a row, and how many each has: one or more."""
    buckets = list(buckets)
    lengths = np.array([len(b) for b in buckets], int) // 2
    return np.frombuffer(b"".join(buckets), np.uint16), np.frombuffer(b"".join(values)), lengths


def _margins(weights: np.ndarray, buckets: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.zeros(0)
    return weights[-1] + np.add.reduceat(weights[buckets] * values, np.cumsum(lengths) - lengths)


def _probability(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -50, 50)))


def _gradient(rows: DataFrame, weights: np.ndarray, labels: Broadcast) -> np.ndarray:
    """Errors times features, summed in tasks and over them; the bias is last.

    A row of one number per bucket comes back from each task, four tasks a core at most.
    """
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, (target, importance) = sent.value, labels.value
        out = np.zeros(len(weights))
        for batch in slices(batches):
            code, *lists = (batch.column(c) for c in ("code", "buckets", "values"))
            code = code.to_numpy()
            buckets, values, lengths = _side_by_side(*(c.to_pylist() for c in lists))
            values = values.astype(np.float32)
            error = (target[code] - _probability(_margins(weights, buckets, values, lengths))) * importance[code]
            out += np.bincount(buckets, np.repeat(error, lengths) * values, len(out))
            out[-1] += error.sum()
        yield pa.RecordBatch.from_pydict({"part": [out.tobytes()]})

    with small_batches(rows.sparkSession):
        parts = rows.coalesce(4 * context.defaultParallelism).mapInArrow(run, "part binary").collect()
    sent.destroy()
    return sum((np.frombuffer(r["part"]) for r in parts), np.zeros(len(weights)))


def _turns(noted: DataFrame, parts: int) -> tuple[str, list[DataFrame]]:
    """What is learned from, in files by turn, so that a round reads its own part alone."""
    spark = noted.sparkSession
    path = scratch_dir(spark, "turns")
    part = (F.col("_turn") % parts).cast("int").alias("part")
    rows = noted.select("_seen.code", "_seen.buckets", "_seen.values", part)
    rows.coalesce(4 * spark.sparkContext.defaultParallelism).write.partitionBy("part").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    return path, [written.where(F.col("part") == at).drop("part") for at in range(parts)]


def trained(noted: DataFrame) -> Classifier:
    """The label model and a logistic regression on its soft labels, in which both classes weigh the same."""
    counted = noted.groupBy(F.col("_seen.code").alias("code")).count().toPandas().sort_values("code")
    votes, counts = _decoded(counted["code"].to_numpy(np.int64)), counted["count"].to_numpy(float)
    labels = estimated(votes, counts)
    p = labels.posterior(votes)
    good, bad = max(float(counts @ p), 1e-9), max(float(counts @ (1 - p)), 1e-9)
    target = labels.posterior(_decoded(np.arange(3 ** len(RULES))))
    sent = noted.sparkSession.sparkContext.broadcast((target, (target / good + (1 - target) / bad) / 2))
    parts = min(PARTS, max(1, int(counts.sum()) // PART_DOCS))
    path, turns = _turns(noted, parts)
    size = 1 << BITS
    weights, slow = np.zeros(size + 1), np.full(size + 1, 1e-6)
    for at in range(ROUNDS if len(counted) else 0):
        grad = parts * _gradient(turns[at % parts], weights, sent)
        grad[:size] -= 1e-5 * weights[:size]
        slow += grad * grad
        weights += 0.3 * grad / np.sqrt(slow)
    removed(noted.sparkSession, path)
    return Classifier(labels, weights)


def judged(noted: DataFrame, model: Classifier) -> Column:
    """Column of (posterior, score) per row."""
    sent = noted.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("posterior double, score double")
    def judge(codes: pa.Array, buckets: pa.Array, values: pa.Array) -> pa.Array:
        classifier = sent.value
        margins = np.zeros(len(codes))
        for a in range(0, len(codes), ROWS_AT_ONCE):
            b = a + ROWS_AT_ONCE
            lists = (c[a:b].to_pylist() for c in (buckets, values))
            margins[a:b] = _margins(classifier.weights, *_side_by_side(*lists))
        posterior = classifier.labels.posterior(_decoded(codes.to_numpy()))
        columns = [pa.array(posterior), pa.array(_probability(margins))]
        return pa.StructArray.from_arrays(columns, ["posterior", "score"])

    return judge("_seen.code", "_seen.buckets", "_seen.values")


def kept(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that the scorer does not reject, all columns."""
    noted = _noted(df, ["*"], key, text)
    return noted.where(judged(noted, trained(noted))["score"] >= least).drop("_turn", "_seen")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Per row: id, posterior of the labellers, score, kept."""
    noted = _noted(df, [key], key, text)
    return noted.select(F.col(key), judged(noted, trained(noted)).alias("v")).select(
        F.col(key), "v.posterior", "v.score", (F.col("v.score") >= least).alias("kept")
    )
