"""Near copies by an exact Jaccard join over word shingles: grouped prefix join.

1. A counting pass finds the shingles that are frequent in the whole corpus (packed counts, one
   row per task and range of hashes). They come last in the order of shingles. The order only
   decides how much work there is; any order gives the same links.
2. Each document gets the first shingles of its set in that order (its prefix): two sets that
   reach the threshold share one of them. Documents with equal prefixes and sizes form a group,
   which stands for its members until the end.
   A shingle that the counting pass saw once meets nobody and is left out; that is looked up in
   a bitmap of fixed size (where it is too full, more is carried and nothing is lost).
3. Rare shingles: groups that share one are paired if their sizes and the shingle's places allow.
   Less than ``RARE`` groups hold such a shingle, so that is few pairs (where the list of frequent
   shingles is full, those that more groups hold are treated as in 4). Pairs of groups are
   expanded to pairs of members, and most of those refused by parity bitmaps (see 4).
4. A parity bitmap of a set has at most as many bits unlike another's as there are shingles in
   one set alone, so it refuses pairs but never a link. Frequent shingles only meet documents
   whose prefix reaches them, that is, documents made of text that many repeat.
   First, each shingle's documents yield a forest of possible links, which is checked; then all
   pairs that lie in different components by then. Large groups of near copies so need about as
   many rows as they have members. A shingle held by very many is dealt out in blocks.
5. All pairs are verified on whole sets; components are those of the links.

Defined results: without words a document has size 0 and is linked with nothing. Equal sets are
one node (repeated rows, copies). A row without id is linked with its copies only, and has their
component. Rows of one id count as one document. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padron.llm.components import components
from padron.llm.words import (
    WordMemory,
    counted,
    hashes,
    mixed,
    pack,
    pack_counts,
    remembered,
    runs,
    shingle_hashes,
    slices,
    summed,
    unpack,
    unpack_counts,
    word_hash,
    words,
)
from padron.session import saved

#: A shingle counted this often is frequent.
RARE = 16
#: Most frequent shingles to send to all workers; beyond it, "frequent" begins higher.
MAX_FREQUENT = 1_000_000
#: Most ids to broadcast for fetching texts; beyond it, the tables are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Documents of one block of a frequent shingle.
BLOCK = 4096
#: Shingles are counted by so many bits of their hash.
CELL_BITS = 40
#: Shingles that a task counts before it passes them on; shingles of one range of hashes.
FLUSH, RANGE = 4_000_000, 4_000_000
#: A range's counts are added in so many parts (a power of two), of which one is sorted at a time.
ADDED_BITS = 4
MAX_BITMAP_BITS = 1 << 15
#: Bits of the map of shingles counted twice or more: 16 MB for any input.
REPEATED_BITS = 27

_SHIFT = np.uint64(64 - CELL_BITS)


def _ceil(a, b):
    return -(-a // b)


def probe_length(n: int, percent: int) -> int:
    """Shingles of a set that any set of equal or smaller size must meet to be linked."""
    return n - _ceil(percent * n, 100) + 1


def index_length(n: int, percent: int) -> int:
    """The same towards sets of equal or larger size."""
    return n - _ceil(2 * percent * n, 100 + percent) + 1


def most_apart(total, percent: int):
    """The most shingles that two linked sets of ``total`` shingles can differ in."""
    return total - 2 * _ceil(percent * total, 100 + percent)


def _shingled(k: int):
    memory = remembered("hashes", lambda: WordMemory(word_hash))
    return lambda text: shingle_hashes(hashes(words(text), memory), k)


# 1. counts


def _frequent(
    docs: DataFrame, k: int, ranges: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Cells of frequent shingles, rising (MAX_FREQUENT at most), their counts; the map of
    shingles counted twice or more; whether all frequent ones are listed."""
    width = CELL_BITS - (ranges - 1).bit_length()
    slice_bits = (1 << REPEATED_BITS) // ranges

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(parts)
        parts.clear()
        cells >>= _SHIFT
        cells.sort()
        cuts = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(width))
        rows = [
            (i, *(f(x) for f, x in zip((pack, pack_counts), counted(cells[a:b]), strict=True)))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if b > a
        ]
        kinds = (pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["range", "cells", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled, parts, held = _shingled(k), [], 0
        for batch in batches:
            for text in batch.column(0):
                parts.append(shingled(text.as_py()))
                held += len(parts[-1])
                if held >= FLUSH:
                    yield flush(parts)
                    held = 0
        if held:
            yield flush(parts)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        which = int(rows["range"].iat[0])
        cells, counts = [unpack(x) for x in rows["cells"]], [unpack_counts(x) for x in rows["counts"]]
        bits, found, n = np.zeros(slice_bits, np.uint8), [], []
        step = 1 << max(0, width - ADDED_BITS)
        for low in range(which << width, which + 1 << width, step):  # a part of the range at a time
            cuts = [np.searchsorted(c, np.array([low, low + step], np.uint64)) for c in cells]
            own, times = summed(
                np.concatenate([c[a:b] for c, (a, b) in zip(cells, cuts, strict=True)]),
                np.concatenate([c[a:b] for c, (a, b) in zip(counts, cuts, strict=True)]),
            )
            twice = (own[times > 1] >> np.uint64(CELL_BITS - REPEATED_BITS)).astype(np.int64)
            bits[twice - which * slice_bits] = 1
            often = times >= RARE
            found.append(own[often].astype(np.int64))
            n.append(times[often])
        packed = np.packbits(bits, bitorder="little").tobytes()
        found = pd.DataFrame({"cell": np.concatenate(found), "n": np.concatenate(n), "bits": None})
        return pd.concat([found, pd.DataFrame({"cell": [which], "n": [0], "bits": [packed]})])

    counts = docs.select("text").mapInArrow(count, "range int, cells binary, counts binary")
    made = saved(
        counts.groupBy("range").applyInPandas(add, "cell long, n long, bits binary"), "frequent"
    )
    least = RARE
    while made.where(F.col("n") >= least).count() > MAX_FREQUENT:
        least *= 2
    found = made.where(F.col("n") >= least).select("cell", "n").toPandas().sort_values("cell")
    repeated = np.zeros((ranges, slice_bits // 8), np.uint8)
    for row in made.where("n = 0").select("cell", "bits").collect():
        repeated[row["cell"]] = np.frombuffer(row["bits"], np.uint8)
    cells, counts = found["cell"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)
    return cells, counts, repeated.ravel(), least == RARE


# 2. prefixes

_PREFIX = (
    "doc_id string, n int, d1 long, d2 long, p1 long, p2 long, n_frequent int,"
    " tokens binary, places binary, bitmap binary"
)


def bitmap(shingles: np.ndarray, per: int) -> bytes:
    """Parities of the set's shingles by their low bits; ``per`` bits or more a shingle."""
    bits = min(MAX_BITMAP_BITS, max(64, 1 << (per * len(shingles) - 1).bit_length()))
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _digest(numbers: np.ndarray) -> tuple[int, int]:
    value = np.frombuffer(xxhash.xxh3_128_digest(numbers.tobytes()), np.int64)
    return int(value[0]), int(value[1])


def _in(repeated: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    at = shingles >> np.uint64(64 - REPEATED_BITS)
    return (repeated[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _prefixes(docs: DataFrame, k: int, percent: int, sent: Broadcast) -> DataFrame:
    """``sent``: cells, counts and map of ``_frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = _shingled(k)
        cells, counts, repeated = sent.value
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.unique(shingled(text.as_py()))
                n = len(own)
                if not n:
                    rows.append((doc_id, 0, 0, 0, 0, 0, 0, None, None, None))
                    continue
                size = probe_length(n, percent)
                first, n_frequent = own[:size], 0
                if len(cells):
                    at = np.searchsorted(cells, own >> _SHIFT)
                    at[at == len(cells)] = 0
                    common = cells[at] == own >> _SHIFT
                    rare = own[~common]
                    first = rare[:size]
                    if len(first) < size:
                        last = own[common]
                        order = np.lexsort((last, counts[at[common]]))
                        n_frequent = size - len(first)
                        first = np.concatenate([first, last[order[:n_frequent]]])
                places = np.flatnonzero(_in(repeated, first))
                rows.append(
                    (doc_id, n, *_digest(own), *_digest(first), n_frequent)
                    + (first[places].tobytes(), places.astype(np.int32).tobytes())
                    + (bitmap(own, 4 if n_frequent else 1),)
                )
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    shape = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _PREFIX.split(", "))])
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, _PREFIX)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _groups(prefixes: DataFrame) -> DataFrame:
    """Documents of equal prefix and size; those that reach frequent shingles stay single.

    A group holds its distinct sets: less than RARE, since all hold its first, rare shingle.
    """
    alone = F.col("n_frequent") > 0
    return (
        prefixes.where("n > 0 AND doc_id IS NOT NULL")
        .withColumns(
            {
                "s1": F.when(alone, F.col("d1")).otherwise(0),
                "s2": F.when(alone, F.col("d2")).otherwise(0),
            }
        )
        .groupBy("p1", "p2", "n", "s1", "s2")
        .agg(
            F.min("doc_id").alias("g"),
            F.collect_set(F.struct("d1", "d2")).alias("members"),
            F.any_value("n_frequent").alias("n_frequent"),
            F.any_value("tokens").alias("tokens"),
            F.any_value("places").alias("places"),
            F.any_value(F.when(alone, F.col("bitmap"))).alias("bitmap"),
        )
        .drop("p1", "p2", "s1", "s2")
    )


# 3. rare shingles


def _rare_entries(groups: DataFrame, percent: int) -> DataFrame:
    """(token, g, n, place) for the rare part of prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, owners, sizes, places = [], [], [], []
            for g, n, n_frequent, own, at in batch[
                ["g", "n", "n_frequent", "tokens", "places"]
            ].itertuples(index=False):
                at = np.frombuffer(at, np.int32)
                rare = at < probe_length(n, percent) - n_frequent
                tokens.append(np.frombuffer(own, np.int64)[rare])
                places.append(at[rare])
                owners.append(np.full(len(places[-1]), g))
                sizes.append(np.full(len(places[-1]), n))
            if tokens:
                yield pd.DataFrame(
                    {
                        "token": np.concatenate(tokens),
                        "g": np.concatenate(owners),
                        "n": np.concatenate(sizes).astype(np.int32),
                        "place": np.concatenate(places),
                    }
                )

    kind = groups.schema["g"].dataType.simpleString()
    return groups.select("g", "n", "n_frequent", "tokens", "places").mapInPandas(
        run, f"token long, g {kind}, n int, place int"
    )


def _pair_frame(a, b) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def _rare_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that share a rare shingle; sizes rise from a to b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in runs(batches, ["token"]):
            token, g = batch["token"].to_numpy(), batch["g"].to_numpy()
            n, place = batch["n"].to_numpy(np.int64), batch["place"].to_numpy(np.int64)
            left, right, step = [], [], 1
            at = np.arange(len(token))
            while len(at := at[at < len(token) - step]):
                at = at[token[at] == token[at + step]]
                x, y = at, at + step
                # What comes before the first shared shingle is not shared.
                most = np.minimum(n[x] - place[x], n[y] - place[y])
                fits = most >= _ceil(percent * (n[x] + n[y]), 100 + percent)
                left.append(g[x[fits]])
                right.append(g[y[fits]])
                step += 1
            if left:
                yield _pair_frame(np.concatenate(left), np.concatenate(right))

    kind = entries.schema["g"].dataType.simpleString()
    dealt = entries.repartition("token").sortWithinPartitions("token", "n", "g")
    return dealt.mapInPandas(run, f"a {kind}, b {kind}")


def _not_refused(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps are alike enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                apart(x, y) <= most_apart(int(m) + int(n), percent)
                for x, y, m, n in batch[["x", "y", "m", "n"]].itertuples(index=False)
            ]
            yield batch.loc[keep, ["a", "b"]]

    kind = prefixes.schema["doc_id"].dataType.simpleString()
    sets = prefixes.where("n > 0").select("doc_id", "bitmap", "n")
    return (
        pairs.join(sets.toDF("a", "x", "m"), "a")
        .join(sets.toDF("b", "y", "n"), "b")
        .mapInPandas(run, f"a {kind}, b {kind}")
    )


def apart(x: bytes, y: bytes) -> int:
    """Bits that differ, the longer bitmap folded to the shorter one's size."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


# 4. frequent shingles


def _block_pairs(entries: DataFrame) -> DataFrame:
    """Rows of a large shingle copied to each pair of blocks that their block is part of."""
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.explode(
        F.transform(
            others,
            lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")),
        )
    )
    return entries.withColumn("pair", pair).select("*", "pair.i", "pair.j").drop("pair")


def _frequent_entries(groups: DataFrame, percent: int) -> DataFrame:
    """(token, g, n, indexed, bitmap) for the frequent part of prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, n, n_frequent, own, at, bits in batch[
                ["g", "n", "n_frequent", "tokens", "places", "bitmap"]
            ].itertuples(index=False):
                own, at = np.frombuffer(own, np.int64), np.frombuffer(at, np.int32)
                last = np.flatnonzero(at >= probe_length(n, percent) - n_frequent)
                for part in np.array_split(last, 1 + len(last) * len(bits) // (8 << 20)):
                    yield pd.DataFrame(
                        {
                            "token": own[part],
                            "g": g,
                            "n": n,
                            "indexed": at[part] < index_length(n, percent),
                            "bitmap": [bits] * len(part),
                        }
                    )

    kind = groups.schema["g"].dataType.simpleString()
    return (
        groups.where("n_frequent > 0")
        .select("g", "n", "n_frequent", "tokens", "places", "bitmap")
        .mapInPandas(run, f"token long, g {kind}, n int, indexed boolean, bitmap binary")
    )


def folds(bits: list[bytes]) -> tuple[np.ndarray, dict, dict]:
    """Lengths of bitmaps in words; for each length all of it or more, folded to it, and their places."""
    length = np.array([len(b) for b in bits]) // 8
    folded, place = {}, {}
    for size in np.unique(length):
        at = np.flatnonzero(length >= size)
        rows = [np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, size), axis=0) for i in at]
        folded[size], place[size] = np.stack(rows), np.full(len(bits), -1)
        place[size][at] = np.arange(len(at))
    return length, folded, place


def possible_links(
    n: np.ndarray,
    indexed: np.ndarray,
    block: np.ndarray,
    label: np.ndarray,
    bitmaps: list[bytes],
    percent: int,
    forest: bool,
) -> tuple[list[int], list[int]]:
    """Places of pairs that may be linked and have different labels; rows rise by size.

    ``forest``: pairs join their labels, so there are less pairs than rows. Rows of two blocks
    are only paired across, those of one block with each other.
    """
    left, right = [], []
    label = label.copy()
    two = block.min() != block.max()
    length, folded, place = folds(bitmaps)
    for x in range(len(n) - 1):
        if not indexed[x]:
            continue
        stop = int(np.searchsorted(n, 100 * int(n[x]) // percent, "right"))
        y = np.arange(x + 1, stop)
        y = y[(label[y] != label[x]) & (block[y] != block[x] if two else True)]
        if len(y):
            rows, at = folded[length[x]], place[length[x]]
            unlike = np.bitwise_count(rows[at[y]] ^ rows[at[x]]).sum(1)
            y = y[unlike <= most_apart(n[y] + int(n[x]), percent)]
        if len(y):
            if forest:
                kinds, first = np.unique(label[y], return_index=True)
                y = y[first]
                label[np.isin(label, kinds)] = label[x]
            left += [x] * len(y)
            right += y.tolist()
    return left, right


def _frequent_pairs(entries: DataFrame, percent: int, forest: bool) -> DataFrame:
    """entries: token, i, j, g, n, indexed, block, bitmap, component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["token", "i", "j"]
        for batch in runs(batches, keys):
            for _, rows in batch.groupby(keys, sort=False):
                g, component = rows["g"].to_numpy(), rows["component"].to_numpy()
                if len(g) < 2 or (component == component[0]).all():
                    continue
                block = rows["block"].to_numpy()
                if rows["i"].iat[0] != rows["j"].iat[0] and block.min() == block.max():
                    continue
                left, right = possible_links(
                    rows["n"].to_numpy(np.int64),
                    rows["indexed"].to_numpy(bool),
                    block,
                    np.unique(component, return_inverse=True)[1],
                    rows["bitmap"].tolist(),
                    percent,
                    forest,
                )
                if left:
                    yield _pair_frame(g[left], g[right])

    kind = entries.schema["g"].dataType.simpleString()
    dealt = entries.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "g")
    return dealt.mapInPandas(run, f"a {kind}, b {kind}").distinct()


# Where the list of frequent shingles is full, others have many documents, too.


def _without_crowded(entries: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of shingles that ``RARE`` groups hold at most; all others, with those that stand
    for groups of many sets. The latter are dealt with like frequent shingles, by bitmaps and blocks.
    """
    entries = saved(entries, "rare-entries")
    many = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE).select("token")
    many = saved(many, "crowded")
    large = groups.where(F.size("members") > RARE).select(
        F.xxhash64(F.lit("group"), F.col("g")).alias("token"), "g", "n", F.lit(0).alias("place")
    )
    return entries.join(many, "token", "left_anti"), entries.join(many, "token").unionByName(large)


def _crowded_entries(
    crowded: DataFrame, members: DataFrame, prefixes: DataFrame, percent: int
) -> DataFrame:
    """(token, g, n, indexed, bitmap) of each member of the groups of ``crowded``."""
    each = crowded.join(members, "g", "left").withColumn("g", F.coalesce("rep", "g"))
    bitmaps = prefixes.where("n > 0").select(F.col("doc_id").alias("g"), "bitmap")
    n = F.col("n").cast("long")
    indexed = F.col("place") < n - F.ceil(2 * percent * n / (100 + percent)) + 1
    return each.join(bitmaps, "g").select("token", "g", "n", indexed.alias("indexed"), "bitmap")


# 5. verification


def _linked(docs: DataFrame, pairs: DataFrame, k: int, percent: int, repeated_ids: bool) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    pairs = saved(pairs.where("a <> b").distinct(), "pairs")
    ids = saved(pairs.select("a").union(pairs.select("b")).distinct(), "pair-ids")
    few = ids.count() <= MAX_BROADCAST_IDS
    wanted = ids.select(F.col("a").alias("doc_id"))
    rows = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = _shingled(k)
        for batch in slices(batches):
            own = [np.unique(shingled(t.as_py())).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = rows.mapInArrow(sets, f"doc_id {kind}, own binary")
    held = saved(held.dropDuplicates() if repeated_ids else held, "pair-sets")
    with_sets = pairs.join(held.withColumnsRenamed({"doc_id": "a", "own": "x"}), "a").join(
        held.withColumnsRenamed({"doc_id": "b", "own": "y"}), "b"
    )
    return saved(
        with_sets.select("a", "b", "x", "y").mapInArrow(verify, f"a {kind}, b {kind}"), "verified"
    )


def near_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id. Ids must be integers."""
    spark: SparkSession = df.sparkSession
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = 1 << max(4, (chars // 5 // RANGE).bit_length())
    *lists, all_listed = _frequent(docs, words, ranges)
    sent = spark.sparkContext.broadcast(tuple(lists))
    prefixes = saved(_prefixes(docs, words, percent, sent), "prefixes")
    sent.destroy()  # the prefixes are written
    classes = (
        prefixes.where("n > 0")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"))
    )
    groups = saved(_groups(prefixes), "groups")

    rare_entries, crowded = _rare_entries(groups, percent), None
    if not all_listed:
        rare_entries, crowded = _without_crowded(rare_entries, groups)
    rare = _rare_pairs(rare_entries, percent).distinct()
    ids = prefixes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    repeated_ids = not ids.where("c > 1").isEmpty()
    several = groups.where(F.size("members") > 1).select("g", F.explode("members").alias("d"))
    members = saved(
        several.select("g", "d.d1", "d.d2").join(classes, ["d1", "d2"]).select("g", "rep"), "members"
    )
    expanded = (
        rare.join(members.withColumnsRenamed({"g": "a", "rep": "x"}), "a", "left")
        .join(members.withColumnsRenamed({"g": "b", "rep": "y"}), "b", "left")
        .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    )
    small = members
    if crowded is not None:
        large = members.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE).select("g")
        small = members.join(large, "g", "left_anti")
    inside = (
        small.withColumnRenamed("rep", "a")
        .join(small.withColumnRenamed("rep", "b"), "g")
        .where("a < b")
        .select("a", "b")
    )
    pairs = _not_refused(expanded.union(inside).distinct(), prefixes, percent)

    entries = _frequent_entries(groups, percent)
    if crowded is not None:
        entries = entries.unionByName(_crowded_entries(crowded, members, prefixes, percent))
    held = entries.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / F.lit(BLOCK)).cast("int")
    entries = saved(
        _block_pairs(
            entries.join(held.withColumn("blocks", blocks).drop("held"), "token").withColumn(
                "block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
            )
        ).drop("blocks"),
        "frequent-entries",
    )
    forest = _frequent_pairs(entries.withColumn("component", F.col("g")), percent, forest=True)
    links = _linked(docs, pairs.union(forest), words, percent, repeated_ids)
    known = components(links)
    labelled = (
        entries.join(known.withColumnRenamed("node", "g"), "g", "left")
        .withColumn("component", F.coalesce("component", "g"))
    )
    last = saved(_frequent_pairs(labelled, percent, forest=False), "last-pairs")
    if last.count():
        links = links.union(_linked(docs, last, words, percent, repeated_ids))
        known = components(links)

    named = classes.join(known.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return prefixes.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select(
        F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id")
    )


def first_of_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component, all columns.

    Of rows of one id one stays. Rows without id are left as they are.
    """
    found = near_copies(df, key, text, words, percent).where(F.col(key).isNotNull())
    found = saved(found.select(F.col(key).alias("_id"), "component_id"), "copies")
    gone = found.where("component_id < _id").select("_id").distinct()
    several = found.groupBy("_id").count().where("count > 1").select("_id")
    several = several.join(gone, "_id", "left_anti")
    out = _without(df, key, gone.union(several))
    if not several.isEmpty():
        again = df.join(several.withColumnRenamed("_id", key), key, "left_semi")
        out = out.unionByName(again.dropDuplicates([key]).select(*df.columns))
    return out.select(*df.columns)


def _without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids`` (a broadcast where they are few)."""
    ids = saved(ids.select(F.col("_id").alias(key)), "gone")
    few = ids.count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")
