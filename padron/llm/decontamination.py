"""Benchmark passages in documents, found in a latent space and checked word by word.

The benchmark is the query set; it is searched for in blocks of ``BLOCK`` passages, so what is
sent to the workers has a bound. For each block:

1. Document frequencies of the block's words are counted over all documents.
2. A randomised singular value decomposition of TF-IDF passages (the block's own, and all documents
   cut into windows of 32 words, which together weigh as much) gives ``rank`` latent directions:
   each round is a Spark job that sums A'(AQ) by word; only a words x rank matrix comes back. The
   windows are numbered words, written once and removed when the space is there.
3. Each document is cut into windows of 32 words, every 16 words. Windows and benchmark passages
   are compared in the latent space, in one matrix product. Candidates have a cosine and a
   projection on the passage over the thresholds. A space of fixed rank loses short passages among
   many, so candidates are also counted word by word: of the words that a passage may miss and
   ``m`` more, the rarest taken, ``m`` must be near each other; no text with enough of the
   passage's words close together has fewer. These, too, must hold ``projection`` of the
   passage's weight (squared idf), so that common words alone are no match.
4. A candidate's surroundings are compared with the passage by their longest common subsequence.
   Most words in order: a copy. Fewer: a paraphrase, if the answer (a column, or else the last
   words of the passage) is there in order, too.

Words are runs of letters and digits of ASCII (A-Z lowered) and anything beyond ASCII. Items of
more than ``PASSAGE`` words are cut into passages that overlap by half.

Defined results: null or empty texts and items match nothing; an empty benchmark flags nothing.
Each document row is judged by itself, so repeated rows give repeated results; items of equal text
are all reported. Ids keep their type; rows without an id are searched for, too, and reported as
one item with a null id. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.llm.words import forget, slices
from padron.session import removed, saved, scratch_dir, small_batches

STEP, WINDOW = 16, 32
PASSAGE = 64
#: Benchmark passages searched for at a time.
BLOCK = 2048
#: Corpus windows in a row of the table that the space is fitted on; windows and places taken at once.
PACKED, SLAB, GROUP = 16_384, 128, 16
OVERSAMPLE, ROUNDS = 16, 2
#: Words at the end of an item that count as its answer where no answer is given.
ANSWER_WORDS = 8


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.5
    projection: float = 0.3
    copy: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.5


_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def passages(found: list[bytes]) -> list[list[bytes]]:
    """The words in overlapping parts."""
    if len(found) <= PASSAGE:
        return [found] if found else []
    half = PASSAGE // 2
    return [found[a : a + PASSAGE] for a in range(0, len(found) - half, half)]


def subsequence(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of ``x`` at a time."""
    places: dict[int, int] = {}
    for at, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << at
    full = (1 << len(x)) - 1
    row = full
    for word in y:
        hit = row & places.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


# Fitting


@dataclass
class Corpus:
    """All words of all documents, in windows side by side, as numbers in a block's vocabulary."""

    path: str
    packed: DataFrame  # (windows) of PACKED windows or fewer; a window's words are sorted
    times: np.ndarray  # documents that hold a word
    n_docs: int
    n_windows: int

    def squared(self, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """A'A times the basis; the rows of A are the windows' TF-IDF rows, of length one."""
        kind, names = _kind(len(idf)), [f"v{i}" for i in range(basis.shape[1])]
        table = np.vstack([basis * idf[:, None], np.zeros(basis.shape[1])]).astype(np.float32)
        sent = self.packed.sparkSession.sparkContext.broadcast((table, np.append(idf, 0.0) ** 2))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, weights = sent.value
            out = np.zeros((len(table) - 1, table.shape[1]))
            for batch in batches:
                for packed in batch.column(0):
                    windows = np.frombuffer(packed.as_buffer(), kind).reshape(-1, WINDOW)
                    own, sums = _window_sums(windows, table, weights)
                    out[own] += sums
            ids = np.flatnonzero(out.any(axis=1))
            columns = [pa.array(ids.astype(np.int32)), *(pa.array(c) for c in out[ids].T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *names])

        return idf[:, None] * _summed(
            self.packed.mapInArrow(part, "id int, " + ", ".join(f"{c} double" for c in names)), basis, names
        )


def _kind(n_words: int) -> type:
    return np.uint16 if n_words < 1 << 16 else np.uint32


def _window_sums(windows: np.ndarray, table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and for each the sum of its windows' rows times the table, each by its squared length.

    Sums are taken of ``GROUP`` rows at a time: a matrix product with ones.
    """
    none, n = len(table) - 1, len(windows)
    rows = np.zeros((n + 1, table.shape[1]), np.float32)  # the last one fills groups up
    known = (windows != none).sum(axis=1)
    begins = np.ones(windows.shape, bool)  # equal words of a window are neighbours
    begins[:, 1:] = windows[:, 1:] != windows[:, :-1]
    begin = np.flatnonzero(begins)
    value = weights[windows.ravel()[begin]] * np.diff(begin, append=windows.size) ** 2
    length = np.bincount(begin // WINDOW, value, n)[:, None]
    for a in range(0, n, SLAB):
        slab = windows[a : a + SLAB, : known[a : a + SLAB].max()]
        total = np.matmul(np.ones((1, slab.shape[1]), np.float32), table[slab])[:, 0]
        rows[:n][a : a + SLAB] = total / length[a : a + SLAB]
    flat = windows.ravel()
    order = np.argsort(flat, kind="stable")[: int(known.sum())]
    flat = flat[order]
    first = np.flatnonzero(np.diff(flat.astype(np.int64), prepend=-1))
    count = np.diff(first, append=len(flat))
    groups = -(-count // GROUP)
    begin = np.cumsum(groups) - groups
    places = np.full(int(groups.sum()) * GROUP, n)
    places[np.repeat(begin * GROUP - first, count) + np.arange(len(flat))] = order // WINDOW
    places, one = places.reshape(-1, GROUP), np.ones((1, GROUP), np.float32)
    step = SLAB * WINDOW // GROUP
    sums = [np.matmul(one, rows[places[a : a + step]])[:, 0] for a in range(0, len(places), step)]
    return flat[first], np.add.reduceat(np.concatenate(sums), begin, axis=0, dtype=float)


def _packed(windows: list[np.ndarray], none: int) -> Iterator[bytes]:
    """Windows with a known word, their words sorted, by number of known words."""
    found = np.concatenate(windows)
    found.sort(axis=1)
    for a in range(0, len(found), PACKED):
        part = found[a : a + PACKED]
        known = (part != none).sum(axis=1)
        order = np.argsort(known, kind="stable")
        if part := part[order[np.count_nonzero(known == 0) :]].tobytes():
            yield part


def _corpus(docs: DataFrame, known: dict[bytes, int]) -> Corpus:
    """One pass over all documents, that counts and numbers their words."""
    spark, none, kind = docs.sparkSession, len(known), _kind(len(known))
    sent = spark.sparkContext.broadcast(known)
    shape = pa.schema([("word", pa.int32()), ("n", pa.int64()), ("windows", pa.binary())])

    def made(windows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part in _packed(windows, none):
            n = len(part) // (WINDOW * np.dtype(kind).itemsize)
            yield pa.RecordBatch.from_pydict({"word": [None], "n": [n], "windows": [part]}, shape)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vocabulary, times, n = sent.value, np.zeros(none + 1, np.int64), 0
        windows, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                found = words(text.as_py())
                n += 1
                ids = np.full(-(-len(found) // WINDOW) * WINDOW, none, kind)
                ids[: len(found)] = np.fromiter(map(vocabulary.get, found, repeat(none)), kind, len(found))
                times[np.unique(ids)] += 1
                windows.append(ids.reshape(-1, WINDOW))
                held += len(windows[-1])
                if held >= PACKED:
                    yield from made(windows)
                    windows, held = [], 0
        if windows:
            yield from made(windows)
        own = np.flatnonzero(times[:none])
        counts = {"word": [*own, -1], "n": [*times[own], n], "windows": [None] * (len(own) + 1)}
        yield pa.RecordBatch.from_pydict(counts, shape)

    path = scratch_dir(spark, "windows")
    with small_batches(spark):
        docs.select("text").mapInArrow(count, "word int, n long, windows binary").write.parquet(path)
    rows = spark.read.schema("word int, n long, windows binary").parquet(path)
    times = np.zeros(none)
    totals = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per word
    n_docs, n_windows = totals.pop(-1, 0), totals.pop(None, 0)
    times[list(totals)] = list(totals.values())
    return Corpus(path, rows.where("windows IS NOT NULL").select("windows"), times, n_docs, n_windows)


def _weighted(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and TF-IDF weights of length one."""
    own, times = np.unique(ids, return_counts=True)
    value = times * idf[own]
    norm = np.sqrt((value * value).sum())
    return own, value / norm if norm else value


def _passage_rows(spark, idf: np.ndarray, parts: list[list[int]]) -> DataFrame:
    """The block's passages as TF-IDF rows."""
    own = [_weighted(np.array(p), idf) for p in parts]
    ids, weights = pa.array([a for a, _ in own], pa.list_(pa.int32())), [b for _, b in own]
    columns = {"ids": ids, "weights": pa.array(weights, pa.list_(pa.float64())), "scale": np.ones(len(own))}
    rows = spark.createDataFrame(pa.table(columns))  # a list of rows would start Python workers of another kind
    return saved(rows.repartition(8), "fit-rows")


def _squared(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, summed by word over all rows."""
    width = basis.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(basis)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros_like(sent.value)
        touched = np.zeros(len(out), bool)
        for batch in batches:
            for ids, weights, scale in batch[["ids", "weights", "scale"]].itertuples(index=False):
                row = np.asarray(weights) * scale
                at = np.asarray(ids)
                out[at] += np.outer(row, row @ sent.value[at])
                touched[at] = True
        frame = pd.DataFrame(out[touched], columns=names)
        frame.insert(0, "id", np.flatnonzero(touched).astype(np.int32))
        yield frame

    names = [f"v{i}" for i in range(width)]
    return _summed(rows.mapInPandas(part, "id int, " + ", ".join(f"{c} double" for c in names)), basis, names)


def _summed(parts: DataFrame, basis: np.ndarray, names: list[str]) -> np.ndarray:
    """The tasks' parts, added up by word."""
    summed = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros_like(basis)
    out[summed["id"].to_numpy()] = summed[names].to_numpy()
    return out


def latent(
    rows: DataFrame, n_words: int, rank: int, seed: int = 7, more: Callable[[np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """Right singular vectors (words x rank) by randomised subspace iteration; ``more`` is A'A of more rows."""

    def squared(basis: np.ndarray) -> np.ndarray:
        own = _squared(rows, basis)
        return own if more is None else own + more(basis)

    width = min(rank + OVERSAMPLE, n_words)
    basis = np.random.default_rng(seed).standard_normal((n_words, width))
    for _ in range(ROUNDS):
        basis = np.linalg.qr(squared(basis))[0]
    _, vectors = np.linalg.eigh(basis.T @ squared(basis))
    return basis @ vectors[:, ::-1][:, :rank]


# Search


@dataclass
class Queries:
    """A block's passages, in words and in the latent space."""

    known: dict[bytes, int]
    keys: list[str | None]
    parts: list[list[int]]
    answers: list[list[int]]
    space: np.ndarray  # a word's weight times its latent vector; the last row is for other words
    vectors: np.ndarray
    lengths: np.ndarray
    limits: Limits
    weights: np.ndarray  # a word's squared idf

    def __post_init__(self) -> None:
        self.times = [Counter(p) for p in self.parts]
        self.totals = [float(self.weights[p].sum()) for p in self.parts]
        least = min(self.limits.copy, self.limits.paraphrase)
        self.wanted = np.ones(len(self.parts), np.int64)
        holders: list[tuple[int, int]] = []
        for at, part in enumerate(self.parts):
            need = min(len(part), max(1, math.ceil(least * len(part) - 1e-9)))
            self.wanted[at] = m = 1 + need // 8
            rarest = sorted(part, key=lambda w: (-self.weights[w], w))
            holders += [(w, at) for w in rarest[: len(part) - need + m]]
        holders.sort()
        self.holders = np.array([at for _, at in holders], np.int64)
        self.first = np.searchsorted([w for w, _ in holders], np.arange(len(self.known) + 2))
        self.reach = np.array([len(p) + WINDOW for p in self.parts], np.int64)

    def near(self, ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(window, passage) where enough of a passage's rarest words are near each other."""
        sizes = self.first[ids[at] + 1] - self.first[ids[at]]
        total = int(sizes.sum())
        if not total:
            return []
        place = np.repeat(self.first[ids[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
        item = self.holders[place]
        wide = len(ids) + 2 * int(self.reach.max())
        order = np.sort(item * wide + np.repeat(at, sizes))
        item = order // wide
        last = np.arange(total) + self.wanted[item] - 1
        inside = last < total
        inside[inside] = order[last[inside]] - order[inside] <= self.reach[item[inside]]
        rows = len(ids) // STEP + 1
        found = np.unique(item[inside] * rows + order[inside] % wide // STEP)
        return list(zip((found % rows).tolist(), (found // rows).tolist(), strict=True))

    def matches(self, found: list[bytes]) -> list[tuple]:
        """(item, verdict, start, end, lcs, words, cosine, answer share): the best of each item."""
        n = len(found)
        none = len(self.known)
        ids = np.fromiter(map(self.known.get, found, repeat(none)), np.int64, n)
        at = np.flatnonzero(ids != none)
        if not len(at):
            return []
        steps = np.full((n // STEP + 2, STEP), none)
        steps.ravel()[:n] = ids
        sums, one = np.zeros((len(steps), self.space.shape[1]), np.float32), np.ones((1, STEP), np.float32)
        for a in range(0, len(steps), SLAB):
            sums[a : a + SLAB] = np.matmul(one, self.space[steps[a : a + SLAB]])[:, 0]
        window = sums[:-1] + sums[1:]
        size = np.sqrt(np.einsum("ij,ij->i", window, window))
        far = np.flatnonzero(size >= self.limits.projection * self.lengths.min())
        product = window[far] @ self.vectors.T
        close = (product >= self.limits.projection * self.lengths**2) & (
            product >= self.limits.cosine * size[far, None] * self.lengths
        )
        best: dict[str | None, tuple] = {}
        least = min(self.limits.copy, self.limits.paraphrase)
        latent_ones = {(int(far[row]), int(item)) for row, item in zip(*np.nonzero(close), strict=True)}
        for row, item in sorted(latent_ones.union(self.near(ids, at))):
            part = self.parts[item]
            start = row * STEP
            a, b = max(0, start - len(part)), start + WINDOW + len(part)
            near = ids[a:b].tolist()
            times = self.times[item]
            here = times.keys() & set(near)
            if sum(map(times.__getitem__, here)) < least * len(part):
                continue  # too few of its words, in any order
            if (row, item) not in latent_ones:
                weight = sum(times[w] * self.weights[w] for w in here)
                if weight < self.limits.projection * self.totals[item]:
                    continue
            shared = subsequence(part, near)
            share = shared / len(part)
            answer = self.answers[item]
            told = subsequence(answer, near) / len(answer)
            verdict = (
                "copy"
                if share >= self.limits.copy
                else "paraphrase"
                if share >= self.limits.paraphrase and told >= self.limits.answer
                else None
            )
            cosine = float(window[row] @ self.vectors[item] / max(size[row] * self.lengths[item], 1e-30))
            key = self.keys[item]
            if verdict and (key not in best or (shared, cosine) > (best[key][4], best[key][6])):
                best[key] = (key, verdict, a, min(b, n), shared, len(part), cosine, told)
        return [best[k] for k in sorted(best, key=lambda k: (k is not None, k or ""))]


def _queries(docs: DataFrame, block: list, rank: int, limits: Limits) -> Queries | None:
    keys, parts, answers = [], [], []
    for item, text, answer in block:
        found = words(text)
        for part in passages(found):
            keys.append(item)
            parts.append(part)
            answers.append(words(answer) or found[-ANSWER_WORDS:])
    if not parts:
        return None
    known = {w: i for i, w in enumerate(sorted({w for p in (*parts, *answers) for w in p}))}
    ids = [[known[w] for w in p] for p in parts]
    corpus = _corpus(docs, known)
    idf = np.log((corpus.n_docs + 1) / (corpus.times + 1)) + 0.01
    rows, share = _passage_rows(docs.sparkSession, idf, ids), len(ids) / max(1, corpus.n_windows)
    space = latent(rows, len(known), min(rank, len(known)), more=lambda b: share * corpus.squared(b, idf))
    removed(docs.sparkSession, corpus.path)
    weighted = np.vstack([space * idf[:, None], np.zeros(space.shape[1])]).astype(np.float32)
    vectors = np.array([weighted[p].sum(0) for p in ids])
    lengths = np.sqrt((vectors**2).sum(1))
    keep = lengths > 0
    return Queries(
        known, [k for k, x in zip(keys, keep, strict=True) if x],
        [p for p, x in zip(ids, keep, strict=True) if x],
        [[known[w] for w in a] for a, x in zip(answers, keep, strict=True) if x],
        weighted, vectors[keep], lengths[keep], limits, idf**2,
    )


_MATCH = (
    "item_id string, verdict string, start long, end long, lcs long, item_words long,"
    " cosine double, answer_share double"
)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    rank: int = 64,
    limits: Limits = Limits(),
) -> DataFrame:
    """(key, item, verdict, place in words, lcs, item's words, cosine, answer share) per match."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    shape = f"doc_id string, {_MATCH}"
    items = benchmark.select(
        F.col(item).cast("string").alias("item"),
        F.col(item_text).alias("body"),
        (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"),
    )
    blocks = -(-items.count() // BLOCK)
    numbered = saved(
        items.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(max(1, blocks)))), "benchmark"
    )
    out = []
    for number in range(blocks):
        block = numbered.where(F.col("block") == number).orderBy("item", "body").collect()
        queries = _queries(rows, [(r["item"], r["body"], r["answer"]) for r in block], rank, limits)
        if queries is not None:
            out.append(rows.mapInArrow(_search(spark, queries), shape))
    found = out[0] if out else spark.createDataFrame([], shape)
    for more in out[1:]:
        found = found.union(more)
    named = found.withColumns(
        {
            "doc_id": F.col("doc_id").cast(docs.schema[key].dataType),
            "item_id": F.col("item_id").cast(benchmark.schema[item].dataType),
        }
    )
    return named.withColumnsRenamed({"doc_id": key, "item_id": item})


def _search(spark, queries: Queries):
    sent = spark.sparkContext.broadcast(queries)
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    shape = pa.schema([("doc_id", pa.string()), *((c.split()[0], kinds[c.split()[1]]) for c in _MATCH.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        queries = sent.value
        for batch in slices(batches):
            found = [
                (doc_id.as_py(), *m)
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True)
                for m in queries.matches(words(text.as_py()))
            ]
            if found:
                columns = zip(zip(*found, strict=True), shape.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], schema=shape)

    return run


def flagged(column: Column, spark, queries: list[Queries]) -> Column:
    """True for texts that hold a passage of any block; a text leaves Arrow's buffer for itself alone."""
    sent = [spark.sparkContext.broadcast(q) for q in queries]

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array([any(q.value.matches(words(t.as_py())) for q in sent) for t in texts], pa.bool_())

    return holds(column)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    rank: int = 64,
    limits: Limits = Limits(),
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(
        F.col(item).cast("string").alias("item"),
        F.col(item_text).alias("body"),
        (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"),
    )
    blocks = -(-items.count() // BLOCK)
    number = F.pmod(F.xxhash64("item", "body"), F.lit(max(1, blocks)))
    for at in range(blocks):
        block = items.where(number == at).orderBy("item", "body").collect()
        queries = _queries(rows, [(r["item"], r["body"], r["answer"]) for r in block], rank, limits)
        if queries is not None:
            docs = docs.where(~flagged(F.col(text), spark, [queries]))
    return docs
