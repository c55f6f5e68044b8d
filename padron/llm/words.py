"""Ids, words, word hashes and packed number lists, shared by the operators' Python tasks.

A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage
return; bytes.split and bytes.lower work by exactly these and by A-Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Entries of one worker's word memory.
REMEMBERED = 200_000


def as_text(key: str) -> Column:
    """An id as text: nulls and large numbers pass unchanged through pandas."""
    return F.col(key).cast("string").alias("key")


def with_key(rows: DataFrame, key: str, kind: DataType) -> DataFrame:
    """``rows`` with the column ``key`` under its own name and type again."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c != "key"]
    return rows.select(F.col("key").cast(kind).alias(key), *rest)


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Rows of an Arrow batch that a task turns into Python objects at once.
ROWS_AT_ONCE = 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``ROWS_AT_ONCE`` at most; none is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


class WordMemory(dict):
    """Word -> number; emptied when full, since every entry can be made again."""

    def __init__(self, make: Callable[[bytes], int], size: int = REMEMBERED) -> None:
        super().__init__()
        self._make, self._size = make, size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._size:
            self.clear()
        found = self[word] = self._make(word)
        return found


_REMEMBERED: dict[object, object] = {}


def remembered(name: object, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task: one thing, so that stages after each other don't add up."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    """For tasks that keep nothing: what earlier stages have kept in this worker goes."""
    _REMEMBERED.clear()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def hashes(found: list[bytes], memory: WordMemory) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words; a shorter text is one window, no words are none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(n, k)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for at in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[at : n - size + 1 + at]
        return mixed(out)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, byte by byte of equal weight, which compresses small ones well."""
    planes = numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def pack(numbers: np.ndarray) -> bytes:
    """Rising numbers as compressed differences, byte by byte of equal weight."""
    return _planes(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    return counted(keys, counts)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same of rising keys."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts.astype(np.int64), starts)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` in frames that never cut a run of equal keys."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        tail = np.ones(len(batch), bool)
        for key in keys:
            tail &= (batch[key] == last[key]).to_numpy()
        cut = int(len(batch) - np.argmin(tail[::-1])) if not tail.all() else 0
        if cut:
            yield pd.concat([*rest, batch.iloc[:cut]], ignore_index=True) if rest else batch.iloc[:cut]
            rest = [batch.iloc[cut:]]
        elif rest and not (rest[-1][keys].iloc[-1] == last).all():
            yield pd.concat(rest, ignore_index=True)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pd.concat(rest, ignore_index=True)
