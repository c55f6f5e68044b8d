"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Counting is a Spark job that moves packed, sorted blocks: a task counts a few million tokens at a
time and passes on one row per shard. Shards are ranges of equally many tokens, and a frequent
word's followers are spread over several shards, so no word, pair or source makes a large group.
Each shard becomes sorted arrays in the shared folder:

- words: 64-bit hashes and counts; a word's number is its place among all,
- pairs: ``number of the first << 32 | number of the second`` and counts,
- numbers: totals by first word, its singletons, doubletons and others, and how many different
  words precede a word (the Kneser-Ney count).

Workers map the arrays into memory and look up sorted blocks of a document's pairs, so the pages
they touch are shared and a model larger than a worker's memory is fine. The folder must be a
mounted file system (a plain path or file:), which is checked.

Defined results: words are lower-cased (A-Z); each text ends with one end token, also a null or
empty one. Rows count as often as they occur. A row without id is learned from. Unknown words
have the probability of an unseen word; probabilities sum to one over known words, end and
"unknown". With nothing to learn from, every token has probability one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from padron.llm.words import (
    WordMemory,
    as_text,
    hashes,
    pack,
    pack_counts,
    summed,
    unpack,
    unpack_counts,
    with_key,
    word_hash,
    words,
)
from padron.session import saved, scratch_dir

#: Tokens a task counts or scores at a time.
BLOCK = 1_500_000
#: Tokens of a shard, about.
SHARD_TOKENS = 4_000_000
#: The end of a text; no word holds a line feed.
END = np.uint64(word_hash(b"\n"))
_LOW = np.uint64(0xFFFFFFFF)
_WORD = np.uint64(32)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one that Python code can open on every machine."""
    path = scratch_dir(spark, label)
    scheme, colon, rest = path.partition(":")
    if colon and "/" not in scheme:
        if scheme != "file":
            raise ValueError(f"{path} can't be mapped into memory; mount spark.checkpoint.dir")
        path = "/" + rest.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


def _store(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write arrays whole or not at all: a second attempt of a task replaces the first."""
    for kind, array in arrays.items():
        part = f"{folder}/.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            np.save(file, array)
        os.replace(part, f"{folder}/{name}.{kind}.npy")


def _load(folder: str, name: str, kind: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.{kind}.npy", mmap_mode="r")


def _streams(
    batches: Iterator[pd.DataFrame], size: int
) -> Iterator[tuple[np.ndarray, np.ndarray, list[pd.DataFrame]]]:
    """Word hashes of many texts end to end, their lengths, and the rows they come from."""
    memory = WordMemory(word_hash)
    held, lengths, frames, n = [], [], [], 0
    for batch in batches:
        start = 0
        for at, text in enumerate(batch["text"], 1):
            own = hashes(words(text), memory)
            held += [own, END]
            lengths.append(len(own) + 1)
            n += len(own) + 1
            if n >= size:
                frames.append(batch.iloc[start:at])
                yield np.hstack(held).astype(np.uint64), np.array(lengths), frames
                held, lengths, frames, n, start = [], [], [], 0, at
        frames.append(batch.iloc[start:])
    if lengths:
        yield np.hstack(held).astype(np.uint64), np.array(lengths), frames


class Words:
    """The words of all shards, mapped into memory."""

    def __init__(self, folder: str, sizes: tuple[int, ...], tokens: tuple[int, ...]) -> None:
        self.folder, self.bits = folder, (len(sizes) - 1).bit_length()
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([[0], np.cumsum(tokens)])
        self.n, self.tokens = int(self.first[-1]), int(self.before[-1])
        self.bos, self.unknown = self.n, self.n + 1

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, counts and tokens before each of rising hashes."""
        number = np.full(len(wanted), self.unknown, np.int64)
        count, before = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        shard = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        for s, a, b in _segments(shard):
            if self.first[s] == self.first[s + 1]:
                continue
            known = _load(self.folder, f"words-{s}", "hash")
            at = np.searchsorted(known, wanted[a:b])
            at[at == len(known)] = 0
            hit = known[at] == wanted[a:b]
            at = at[hit]
            place = np.arange(a, b)[hit]
            number[place] = self.first[s] + at
            count[place] = _load(self.folder, f"words-{s}", "count")[at]
            before[place] = self.before[s] + _load(self.folder, f"words-{s}", "before")[at]
        return number, count, before


def _segments(rising: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each stretch of equal values."""
    if len(rising):
        cuts = np.flatnonzero(np.diff(rising)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(rising)], strict=True):
            yield int(rising[a]), int(a), int(b)


def _pairs(stream: np.ndarray, vocabulary: Words, docs: int):
    """Distinct pairs of a stream: first, second (places among ``known``), shard weight."""
    known, at = np.unique(stream, return_inverse=True)
    number, count, before = vocabulary.find(known)
    bos = len(known)
    previous = np.empty(len(at), np.int64)
    previous[0] = bos
    previous[1:] = np.where(stream[:-1] == END, bos, at[:-1])
    key = previous.astype(np.uint64) << _WORD | at.astype(np.uint64)
    number, count, before = (
        np.append(x, y)
        for x, y in ((number, vocabulary.bos), (count, docs), (before, vocabulary.tokens))
    )
    return key, number, count, before, at


def _shard_of(first, second, count, before, total: float, tokens: float, shards: int) -> np.ndarray:
    """Shard of pairs: tokens up to the pair, if words followed each other by chance."""
    upto = before[first] + count[first] * (before[second] / max(tokens, 1.0))
    return np.minimum((upto / max(total, 1.0) * shards).astype(np.int64), shards - 1)


def _count_words(docs: DataFrame, folder: str, shards: int) -> Words:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stream, _, _ in _streams(batches, BLOCK):
            key, n = summed(stream)
            shard = (key >> np.uint64(64 - bits)).astype(np.int64)
            rows = [(s, pack(key[a:b]), pack_counts(n[a:b])) for s, a, b in _segments(shard)]
            yield pd.DataFrame(rows, columns=["shard", "keys", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iat[0])
        key, n = summed(
            np.concatenate([unpack(x) for x in rows["keys"]]),
            np.concatenate([unpack_counts(x) for x in rows["counts"]]),
        )
        _store(folder, f"words-{shard}", hash=key, count=n, before=np.cumsum(n) - n)
        return pd.DataFrame({"shard": [shard], "size": [len(key)], "tokens": [int(n.sum())]})

    bits = (shards - 1).bit_length()
    counted = docs.select("text").mapInPandas(count, "shard int, keys binary, counts binary")
    made = counted.groupBy("shard").applyInPandas(add, "shard int, size long, tokens long")
    sizes, tokens = [0] * shards, [0] * shards
    for row in made.collect():  # one row a shard
        sizes[row["shard"]], tokens[row["shard"]] = row["size"], row["tokens"]
    return Words(folder, tuple(sizes), tuple(tokens))


_NUMBERS = "range int, ids binary, total binary, n1 binary, n2 binary, n3 binary, preceding binary"


def _count_pairs(docs: DataFrame, vocabulary: Words, n_docs: int, shards: int, width: int) -> DataFrame:
    """Write the pairs; (a shard's counts of counts, and sums by number in ranges of ``width``).

    A shard's own row has the range -1 - shard.
    """
    folder, total = vocabulary.folder, float(vocabulary.tokens + n_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stream, _, _ in _streams(batches, BLOCK):
            key, number, count, before, _ = _pairs(stream, vocabulary, n_docs)
            key, n = summed(key)
            first, second = (key >> _WORD).astype(np.int64), (key & _LOW).astype(np.int64)
            shard = _shard_of(first, second, count, before, total, vocabulary.tokens, shards)
            key = number[first].astype(np.uint64) << _WORD | number[second].astype(np.uint64)
            order = np.lexsort((key, shard))
            key, n, shard = key[order], n[order], shard[order]
            rows = [(s, pack(key[a:b]), pack_counts(n[a:b])) for s, a, b in _segments(shard)]
            yield pd.DataFrame(rows, columns=["shard", "keys", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iat[0])
        key, n = summed(
            np.concatenate([unpack(x) for x in rows["keys"]]),
            np.concatenate([unpack_counts(x) for x in rows["counts"]]),
        )
        wide = n.max(initial=0) >= 1 << 32
        _store(folder, f"pairs-{shard}", key=key, count=n if wide else n.astype(np.uint32))
        first, at = np.unique(key >> _WORD, return_inverse=True)
        sums = [np.bincount(at, weights=w).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
        second, preceding = summed(key & _LOW)
        ids = np.union1d(first, second)
        full = [np.zeros(len(ids), np.int64) for _ in range(5)]
        for column, values in zip(full, sums, strict=False):
            column[np.searchsorted(ids, first)] = values
        full[4][np.searchsorted(ids, second)] = preceding
        times = np.bincount(np.minimum(n, 5), minlength=5)
        out = [
            (int(r), pack(ids[a:b]), *(pack_counts(x[a:b]) for x in full), 0, 0, 0, 0, 0)
            for r, a, b in _segments((ids // np.uint64(width)).astype(np.int64))
        ]
        out.append((-1 - shard, *[None] * 6, *map(int, times[1:5]), len(key)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

    shape = _NUMBERS + ", m1 long, m2 long, m3 long, m4 long, pairs long"
    counted = docs.select("text").mapInPandas(count, "shard int, keys binary, counts binary")
    return counted.groupBy("shard").applyInPandas(add, shape)


def _sum_numbers(rows: DataFrame, folder: str, width: int) -> list:
    """Write sums by number; per range, how many words have so many predecessors."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        which = int(rows["range"].iat[0])
        sums = [np.zeros(width, np.int64) for _ in range(5)]
        for ids, *values in rows[["ids", "total", "n1", "n2", "n3", "preceding"]].itertuples(index=False):
            at = (unpack(ids) - np.uint64(which * width)).astype(np.int64)
            for column, value in zip(sums, values, strict=True):
                column[at] += unpack_counts(value)
        names = ("total", "n1", "n2", "n3", "preceding")
        _store(folder, f"numbers-{which}", **dict(zip(names, sums, strict=True)))
        times = np.bincount(np.minimum(sums[4], 5), minlength=6)
        more = int((sums[4] > 2).sum())
        return pd.DataFrame([(*map(int, times[1:5]), more)], columns=["m1", "m2", "m3", "m4", "more"])

    return (
        rows.where("range >= 0")
        .groupBy("range")
        .applyInPandas(add, "m1 long, m2 long, m3 long, m4 long, more long")
        .agg(*[F.sum(c).alias(c) for c in ("m1", "m2", "m3", "m4", "more")])
        .first()
    )


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; 0.5, 1, 1.5 where undefined."""
    if not all((n1, n2, n3, n4)):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


class Model:
    """What a worker needs to score: the mapped arrays' places and a few numbers."""

    def __init__(
        self, vocabulary: Words, docs: int, shards: int, width: int, pair_d, word_d, pairs, more, written
    ) -> None:
        """``written``: ranges of numbers, and -1 - shard of pairs, that have arrays."""
        self.written = written
        self.words, self.docs, self.shards, self.width = vocabulary, docs, shards, width
        self.pair_d, self.word_d = np.array([0.0, *pair_d]), np.array([0.0, *word_d])
        self.pairs = pairs
        # Mass left for all words alike.
        self.rest = float(np.dot(word_d, more)) / pairs if pairs else 1.0

    def _numbers(self, ids: np.ndarray, kind: str) -> np.ndarray:
        """Values of rising numbers; unknown ones have none."""
        out = np.zeros(len(ids), np.int64)
        inside = np.flatnonzero(ids <= self.words.bos)
        for r, a, b in _segments(ids[inside] // self.width):
            out[inside[a:b]] = self._array(r, kind)[ids[inside[a:b]] - r * self.width]
        return out

    def _array(self, which: int, kind: str) -> np.ndarray:
        if which not in self.written:  # nothing was learned in this range
            return np.zeros(self.width, np.int64)
        return _load(self.words.folder, f"numbers-{which}", kind)

    def _pair_counts(self, key, number, count, before) -> np.ndarray:
        """Counts of distinct pairs, given by places."""
        first, second = (key >> _WORD).astype(np.int64), (key & _LOW).astype(np.int64)
        out = np.zeros(len(key), np.int64)
        seen = np.flatnonzero((number[first] != self.words.unknown) & (number[second] != self.words.unknown))
        first, second = first[seen], second[seen]
        total = float(self.words.tokens + self.docs)
        shard = _shard_of(first, second, count, before, total, self.words.tokens, self.shards)
        wanted = number[first].astype(np.uint64) << _WORD | number[second].astype(np.uint64)
        order = np.lexsort((wanted, shard))
        for s, a, b in _segments(shard[order]):
            at = order[a:b]
            if -1 - s not in self.written:  # an empty shard
                continue
            known = _load(self.words.folder, f"pairs-{s}", "key")
            place = np.searchsorted(known, wanted[at])
            place[place == len(known)] = 0
            hit = known[place] == wanted[at]
            out[seen[at[hit]]] = _load(self.words.folder, f"pairs-{s}", "count")[place[hit]]
        return out

    def scored(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: count, base and model log10 probability."""
        key, number, count, before, at = _pairs(stream, self.words, self.docs)
        v, n = self.words.n, self.words.tokens
        base = np.log10((count + 1) / (n + v + 1))
        ids = number[:-1]
        order = np.argsort(ids, kind="stable")
        preceding, total, n1, n2, n3 = (np.zeros(len(number), np.int64) for _ in range(5))
        preceding[order] = self._numbers(ids[order], "preceding")
        every = np.argsort(number, kind="stable")
        for column, kind in ((total, "total"), (n1, "n1"), (n2, "n2"), (n3, "n3")):
            column[every] = self._numbers(number[every], kind)
        alone = self.rest / (v + 1) + np.maximum(
            preceding - self.word_d[np.minimum(preceding, 3)], 0
        ) / max(self.pairs, 1)
        d = self.pair_d
        left = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        distinct, place = np.unique(key, return_inverse=True)
        c = self._pair_counts(distinct, number, count, before)
        first, second = (distinct >> _WORD).astype(np.int64), (distinct & _LOW).astype(np.int64)
        held = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[first], 1)
        score = np.log10(held + left[first] * alone[second])
        return count[at], base[at], score[place]


def learned(df: DataFrame, text: str = "text") -> Model:
    """A model of all texts of ``df``."""
    spark = df.sparkSession
    docs = df.select(F.col(text).alias("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = 1 << max(4, ((size["chars"] or 0) // 5 // SHARD_TOKENS).bit_length())
    folder = shared_folder(spark, "lm")
    vocabulary = _count_words(docs, folder, shards)
    if vocabulary.n >= 1 << 32:
        raise ValueError("more than 4 billion distinct words")
    width = max(1 << 16, -(-(vocabulary.n + 1) // shards))
    rows = saved(_count_pairs(docs, vocabulary, size["n"], shards, width), "lm-numbers")
    found = rows.agg(*[F.sum(c).alias(c) for c in ("m1", "m2", "m3", "m4", "pairs")]).first()
    counts = [found[c] or 0 for c in ("m1", "m2", "m3", "m4")]
    by_word = _sum_numbers(rows, folder, width)
    words_by = [by_word[c] or 0 for c in ("m1", "m2", "m3", "m4")]
    # A number per array, so that one that is missing is an error and not an empty one.
    written = frozenset(r["range"] for r in rows.select("range").distinct().collect())
    return Model(
        vocabulary, size["n"], shards, width, discounts(*counts), discounts(*words_by),
        found["pairs"] or 0, (words_by[0], words_by[1], by_word["more"] or 0), written,
    )


def scores(
    df: DataFrame, model: Model, held_out: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: id, held_out, tokens, known tokens, train_tokens, base_score, score, perplexity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stream, lengths, frames in _streams(batches, BLOCK):
            count, base, score = model.scored(stream)
            starts = np.cumsum(lengths) - lengths
            out = pd.concat(frames)[["key", "held_out"]]
            total = np.add.reduceat(score, starts)
            yield out.assign(
                n_tokens=lengths,
                n_known=np.add.reduceat((count > 0).astype(np.int64), starts),
                train_tokens=model.words.tokens,
                base_score=np.add.reduceat(base, starts),
                score=total,
                perplexity=10 ** np.minimum(-total / lengths, 300),
            )

    rows = df.select(as_text(key), held_out.alias("held_out"), F.col(text).alias("text"))
    shape = (
        "key string, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double, perplexity double"
    )
    return with_key(rows.mapInPandas(run, shape), key, df.schema[key].dataType)


def held_out(key: Column, parts: int = 7, which: int = 2) -> Column:
    """True for the documents not to learn from, by checksum of the id's text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts)) == which


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from all rows but those held out; score every row."""
    out = held_out(F.col(key))
    return scores(df, learned(df.where(~out), text), out, key, text)
