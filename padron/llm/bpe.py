"""Byte-pair encoding with a queue of merge ranks, and its decoding.

A word's symbols form a doubly linked list. A heap holds the ranks of neighbouring pairs; an
entry whose pair has changed since is stale and skipped. A word of n symbols takes n log n
steps, so a megabyte without white space is no special case.

Defined results: a null or empty text has no ids; every row gives one row, repeated or not; the
strings of special tokens in a text become those tokens, as the vocabulary file asks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.llm.words import as_text, remembered, slices, with_key

#: Words and pieces of words whose encoding a worker remembers, twice over; some 330 bytes each.
WORDS, PIECES = 100_000, 100_000
_PLACE = (1 << 32) - 1
#: A vocabulary is sent to every worker, so its file has a size limit.
MAX_VOCABULARY_BYTES = 64 << 20

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space of the vocabulary's patterns (Unicode White_Space).
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Control characters that str.split takes for white space and the patterns do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return letters


class Memory(dict):
    """Results by key: when full, only what was used since the last time it was full is kept."""

    def __init__(self, make, size: int) -> None:
        super().__init__()
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, key):
        found = self._old.get(key)
        if found is None:
            found = self._make(key)
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = found
        return found


class Vocabulary:
    """A vocabulary file (lower case, white space dropped, word ends marked) ready to encode."""

    def __init__(self, raw: bytes, words: int = WORDS) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        self.numbers = {i: str(i) for i in self.strings}
        self._left_nothing = False
        self.end = model["end_of_word_suffix"] or ""
        # Pair, packed into one integer, -> rank; rank -> the symbol that the pair becomes.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[left] << 32 | self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        letters = _byte_letters()
        self._first = [self.ids[x] for x in letters]
        self._last = [self.ids[x + self.end] for x in letters]
        split = next(
            p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )["pattern"]["Regex"]
        self._pieces = regex.compile(split.replace(r"\s", _SPACE[1:-1])).findall
        self._marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._words, self._known = Memory(self._encoded_word, words), Memory(self.merge, PIECES)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: lowest rank first, leftmost among equals."""
        data = piece.encode("utf-8", "surrogatepass")
        symbols = [self._first[b] for b in data]
        symbols[-1] = self._last[data[-1]]
        n, rank_of, merged_of = len(symbols), self.ranks.get, self.merged
        # Entries are rank and place; ``current`` is the entry that holds for a place now.
        ranks = [rank_of(a << 32 | b) for a, b in zip(symbols, symbols[1:], strict=False)]
        current = [-1 if r is None else r << 32 | at for at, r in enumerate(ranks)]
        queue = [entry for entry in current if entry >= 0]
        if not queue:
            return symbols
        current.append(-1)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at = entry & _PLACE
            if current[at] != entry:
                continue  # stale: one of the two has been merged meanwhile
            right, merged = after[at], merged_of[entry >> 32]
            symbols[at], symbols[right] = merged, -1
            current[at] = current[right] = -1
            after[at] = beyond = after[right]
            if beyond < n:
                before[beyond] = at
                rank = rank_of(merged << 32 | symbols[beyond])
                if rank is not None:
                    current[at] = entry = rank << 32 | at
                    heappush(queue, entry)
            left = before[at]
            if left >= 0:
                rank = rank_of(symbols[left] << 32 | merged)
                if rank is None:
                    current[left] = -1
                else:
                    current[left] = entry = rank << 32 | left
                    heappush(queue, entry)
        return [s for s in symbols if s >= 0]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word without white space."""
        if word.isascii():
            if word.isalpha():  # one piece
                return self._known[word.lower()]
        else:
            # Letter by letter: the form of a letter does not depend on its neighbours.
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        out: list[int] = []
        for piece in self._pieces(word.lower()):
            out += self._known[piece]
        return out

    def _encoded_word(self, word: str) -> tuple[str, str]:
        """A word's ids and its decoded text."""
        ids = self.word_ids(word)
        if not ids:
            self._left_nothing = True
        return " ".join([self.numbers[i] for i in ids]), " ".join([self.strings[i] for i in ids])

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens (True) and the words between them, in order."""
        for k, part in enumerate(self._marks.split(text) if "<" in text else [text]):
            if k % 2:
                yield True, part
            elif _SEPARATORS.search(part):
                yield from ((False, w) for w in re.split(_SPACE + "+", part) if w)
            else:
                yield from ((False, w) for w in part.split())

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, word in self._parts(text or ""):
            out += [self.special[word]] if special else self.word_ids(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings, one after the other, a space between."""
        return " ".join(self.strings[i] for i in ids)

    def summary(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        known = self._words
        if text and "<" not in text and not _SEPARATORS.search(text):
            found = [known[w] for w in text.split()]
        else:
            found = [
                (self.numbers[self.special[w]], w) if special else known[w]
                for special, w in self._parts(text or "")
            ]
        if self._left_nothing:  # the normaliser may leave nothing of a word
            found = [word for word in found if word[0]]
        if not found:
            return 0, _sha256(""), _sha256("")
        ids, strings = map(" ".join, zip(*found, strict=True))
        return ids.count(" ") + 1, _sha256(ids), _sha256(strings)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _loaded(raw: bytes, words: int = WORDS) -> Vocabulary:
    """One vocabulary per worker process, whose memory of words outlives a task."""
    return remembered(("vocabulary", hashlib.sha256(raw).hexdigest(), words), lambda: Vocabulary(raw, words))


def _broadcast(df: DataFrame, path: str):
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encoded(df: DataFrame, path: str, text: str = "text") -> Column:
    """A column of ids (array<int>) for ``df``."""
    raw = _broadcast(df, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        vocabulary = _loaded(raw.value)
        return pd.Series([vocabulary.encode(t) for t in texts], dtype=object)

    return ids(F.col(text))


def decoded(df: DataFrame, path: str, ids: str) -> Column:
    """A column of texts from a column of ids; null ids give an empty text."""
    raw = _broadcast(df, path)

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        vocabulary = _loaded(raw.value)
        return pd.Series(
            ["" if r is None else vocabulary.decode(r) for r in rows], dtype=object
        )

    return texts(F.col(ids))


def token_digest(
    df: DataFrame, path: str, text: str = "text", key: str = "doc_id", words: int = WORDS
) -> DataFrame:
    """``key`` with the number of ids, their digest and the digest of the decoded text.

    ``words``: how many words a worker remembers, which only changes time and memory. Ids and decoded texts stay in the task that makes them; a row of fixed size leaves it.
    """
    raw = _broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(raw.value, words)
        for batch in slices(batches):
            rows = [vocabulary.summary(t) for t in batch.column("text").to_pylist()]
            counts, ids, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(as_text(key), F.col(text).alias("text"))
    return with_key(rows.mapInArrow(run, f"key string, {SCHEMA}"), key, df.schema[key].dataType)
