"""Runs of words of plain texts, found by a map of the runs that are asked for.

A plain text has words with one space between, so a run of words is a range of its bytes. A block of
texts is hashed once, by sums that give the hash of any range by a subtraction. The map has a bit for
each slot of hashes; it lets all asked runs through and a few others, whatever the number of runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructType

#: Bits of the map: 8 MB for any list.
SLOT_BITS = 26
#: Bytes of texts that are hashed at once.
BLOCK = 1 << 18
#: Maps that are sent to the driver at once.
MAPS = 8

_SPACE = 32
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Block:
    """Texts that lie one after the other, with the sums of their bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = max(BLOCK, 1 << len(data).bit_length())
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * _powers(_BASE, n)[: len(data)], out=self._sums[1:])
        self._back = _powers(pow(_BASE, -1, 1 << 64), n)

    def slots(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of ranges; equal bytes have equal ones."""
        found = (self._sums[ends] - self._sums[starts]) * self._back[starts]
        found ^= found >> np.uint64(32)
        found *= _MIX
        return (found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _blocks(column: pa.Array, words: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, limits of the texts) of about ``BLOCK`` bytes each; nulls are empty.

    With ``words``, a longer text comes in parts, each with the first ``words - 1`` words of the next.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + BLOCK, "right")) - 1)
        block, own = data[limits[at] : limits[to]], limits[at : to + 1] - limits[at]
        if words and len(block) > BLOCK:
            ends = np.append(np.flatnonzero(block == _SPACE), len(block))
            a = 0
            while a < len(block):
                last = int(np.searchsorted(ends, min(a + BLOCK, len(block))))
                part = block[a : ends[min(last + words - 1, len(ends) - 1)]]
                yield at, part, np.array([0, len(part)])
                a = int(ends[last]) + 1
        else:
            yield at, block, own
        at = to


def asked_map(runs: DataFrame, word: str) -> np.ndarray:
    """The map of the runs in the column ``word``, none of them empty or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SLOT_BITS, bool)
        for batch in batches:
            for _, data, limits in _blocks(batch.column(0)):
                bits[_Block(data).slots(limits[:-1], limits[1:])] = True
        packed = np.packbits(bits, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(packed, 1)], pa.binary())], names=["bits"])

    bits = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for row in runs.select(word).coalesce(MAPS).mapInArrow(run, "bits binary").collect():
        bits |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return bits


def _add_runs(held: list[set[bytes]], data: np.ndarray, limits: np.ndarray, sizes: list[int], bits: np.ndarray) -> None:
    """Add to each text's set its runs of ``sizes`` words that the map lets through."""
    full = limits[:-1] < limits[1:]
    spaces = np.flatnonzero(data == _SPACE)
    starts = np.sort(np.concatenate((limits[:-1][full], spaces + 1)))
    ends = np.sort(np.concatenate((limits[1:][full], spaces)))
    texts = np.searchsorted(limits, starts, "right") - 1
    block, raw = _Block(data), data.tobytes()
    for n in sizes:
        last = max(0, len(starts) - n + 1)
        slots = block.slots(starts[:last], ends[n - 1 :])
        some = np.flatnonzero(bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
        some = some[texts[some] == texts[some + n - 1]]  # not from one text into the next
        for text, a, b in zip(texts[some].tolist(), starts[some].tolist(), ends[some + n - 1].tolist(), strict=True):
            held[text].add(raw[a:b])


def found_runs(column: pa.Array, sizes: list[int], bits: np.ndarray) -> pa.ListArray:
    """Of each plain text, its runs of ``sizes`` words that the map lets through, each once."""
    held: list[set[bytes]] = [set() for _ in range(len(column))]
    for at, data, limits in _blocks(column, max(sizes, default=1)):
        _add_runs(held[at : at + len(limits) - 1], data, limits, sizes, bits)
    ends = pa.array(np.cumsum([0, *map(len, held)], dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array([w for runs in held for w in runs], pa.binary()).cast(pa.string()))


def _search(sent: Broadcast, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = found_runs(batch.column("body"), sizes, sent.value)
            own = batch.drop_columns("body")
            yield pa.RecordBatch.from_arrays([*own.columns, runs], names=[*own.schema.names, "runs"])

    return run


def held_runs(rows: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """``rows`` with ``runs`` instead of their plain ``body``: runs of ``sizes`` words that the map lets through, each once."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    shape = StructType([*rows.drop("body").schema.fields]).add("runs", ArrayType(StringType()))
    return rows.mapInArrow(_search(sent, sizes), shape)
