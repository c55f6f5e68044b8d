"""Ranked lexical search over classes of equal bags.

1. The items' terms are numbered: the vocabulary. Each document is reduced to its bag, the
   vocabulary terms it holds with their counts, and to its number of terms. A small vocabulary
   goes to the workers; one beyond ``MAX_TERMS`` or ``MAX_TERM_BYTES`` meets the documents' terms
   in a join.
2. Counts over all documents (with a term, of terms, of documents holding each term) give the
   weights and each document's length factor m.
3. Documents of equal m and equal bag score alike for every item. A hash of the bag brings them
   together, the bags themselves are compared, and each class keeps its ``k`` smallest ids: a
   limit per task before the shuffle, so a hot class is a few rows a task.
4. Each class is scored once for all items by postings over a batch of classes. A task keeps the
   ``k`` best classes an item, ordered by score and smallest id: a document among the ``k`` best
   lies in one of those, since every class before its own holds a document before it.
5. Classes are expanded by rising id and ranked.

Defined results: null or empty texts have no terms and are found by nothing. Documents without id
count and rank behind equal scores with one. Repeated document rows are ranked each. Rows of one
item id are one item with the terms of all; a null id is an item of its own. Ids of documents are
integers. Other columns are left alone. No item, no document or no common term: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padron.llm.words import slices
from padron.session import saved

#: Ranks that are reported.
BEST = 10
#: The largest vocabulary to send to the workers; a larger one is joined.
MAX_TERMS, MAX_TERM_BYTES = 500_000, 32 << 20
#: Terms of the items that are scored in one pass over the classes.
BLOCK = 2_000_000

BAG = "array<struct<id: long, tf: long>>"
_BAG = pa.list_(pa.struct([("id", pa.int64()), ("tf", pa.int64())]))


def _letters() -> bytes:
    """Each byte as a term has it; a space where it is no part of one."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for kept in (range(48, 58), range(65, 91), range(97, 123)):
        table[kept.start : kept.stop] = bytes(kept).lower()
    return bytes(table)


_LETTERS = _letters()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; A-Z lowered."""
    return (text or b"").translate(_LETTERS).split()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


# 1. vocabulary and bags


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [list(set(terms(t))) for t in _texts(batch)]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(at)), pa.array([t for f in found for t in f], pa.binary())],
                ["item", "term"],
            )

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, term binary").distinct()


def _bags_by_broadcast(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, n, bag): the vocabulary is at every worker."""
    sent = docs.sparkSession.sparkContext.broadcast(
        {bytes(r["term"]): r["id"] for r in vocabulary.collect()}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in slices(batches):
            sizes, ends, ids, counts = [], [0], [], []
            for text in _texts(batch):
                found = terms(text)
                sizes.append(len(found))
                own = sorted((known[t], n) for t, n in Counter(found).items() if t in known)
                ids += [i for i, _ in own]
                counts += [n for _, n in own]
                ends.append(len(ids))
            pairs = pa.StructArray.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], fields=list(_BAG.value_type)
            )
            bags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), bags], ["id", "n", "bag"]
            )

    return docs.mapInArrow(run, f"id long, n long, bag {BAG}")


def _bags_by_join(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, n, bag): the documents' distinct terms meet the vocabulary in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [terms(t) for t in _texts(batch)]
            for at, own in enumerate(found):
                counted = Counter(own)
                rows = pa.array(np.full(len(counted) + 1, at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(rows),
                        batch.column("id").take(rows),
                        pa.array([None, *counted], pa.binary()),
                        pa.array([len(own), *counted.values()], pa.int64()),
                    ],
                    ["row", "id", "term", "tf"],
                )

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    # Written, so that the row numbers are the same for both parts below.
    held = saved(numbered.mapInArrow(run, "row long, id long, term binary, tf long"), "terms")
    bags = (
        held.join(vocabulary.withColumnRenamed("id", "number"), "term")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("number").alias("id"), "tf"))).alias("bag"))
    )
    whole = held.where("term IS NULL").select("row", "id", F.col("tf").alias("n"))
    return whole.join(bags, "row", "left").select(
        "id", "n", F.coalesce("bag", F.array().cast(BAG)).alias("bag")
    )


def _bags(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    size = vocabulary.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("bytes")
    ).first()
    small = size["n"] <= MAX_TERMS and size["bytes"] <= MAX_TERM_BYTES
    return (_bags_by_broadcast if small else _bags_by_join)(docs, vocabulary)


# 3. classes


def _classes(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, bag, ids): the smallest ``k`` ids of each class, rising, nulls last."""
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L")
    same = ["digest", "m", "bag"]  # the hash deals and sorts, the bag decides
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last()))
    first = (
        bags.where(F.size("bag") > 0)
        .select(F.xxhash64("bag").alias("digest"), m.alias("m"), "bag", "id")
        .withColumn("place", place)
        .where(F.col("place") <= k)
    )
    ids = F.sort_array(F.collect_list(F.struct("place", "id")))["id"]
    return first.groupBy(*same).agg(ids.alias("ids")).drop("digest")


# 4. scores


class Postings:
    """A block of items, scored against batches of classes; keeps each item's best."""

    def __init__(self, items: list[tuple[str | None, np.ndarray, np.ndarray]], k: int) -> None:
        """``items``: (item, term numbers, weights)."""
        self._items = items
        self._k = k
        self._numbers = np.unique(np.concatenate([t for _, t, _ in items]))
        self._terms = [np.searchsorted(self._numbers, t).tolist() for _, t, _ in items]
        self._weights = [w.tolist() for _, _, w in items]
        # Per item (-score, no id, smallest id, ids), best first.
        self._best: list[list[tuple]] = [[] for _ in items]

    def add(self, batch: pa.RecordBatch) -> None:
        m = batch.column("m").to_numpy().astype(np.int64)
        bags, ids = batch.column("bag"), batch.column("ids")
        sizes = np.diff(bags.offsets.to_numpy())
        entries = bags.flatten()
        number, tf = (entries.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        at = np.searchsorted(self._numbers, number)
        at[at == len(self._numbers)] = 0
        own = self._numbers[at] == number
        owner = np.repeat(np.arange(len(m)), sizes)[own]
        tf, at = tf[own], at[own]
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
        order = np.argsort(at, kind="stable")
        at, owner, part = at[order], owner[order], part[order]
        start = np.searchsorted(at, np.arange(len(self._numbers) + 1)).tolist()
        smallest = ids.flatten().take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()))
        missing = smallest.is_null().to_numpy(zero_copy_only=False)
        first = smallest.fill_null(0).to_numpy()
        for item, (places, weights) in enumerate(zip(self._terms, self._weights, strict=True)):
            score = np.zeros(len(m), np.int64)
            for t, w in zip(places, weights, strict=True):
                a, b = start[t], start[t + 1]
                score[owner[a:b]] += w * part[a:b]
            best = self._best[item]
            least = -best[-1][0] if len(best) == self._k else 1
            found = np.flatnonzero(score >= least)
            if len(found) > self._k:
                border = np.partition(score[found], -self._k)[-self._k]
                found = found[score[found] >= border]
                found = found[np.lexsort((first[found], missing[found], -score[found]))[: self._k]]
            for i in found.tolist():
                best.append((-int(score[i]), bool(missing[i]), int(first[i]), ids[i].as_py()))
            if len(found):
                best.sort(key=lambda row: row[:3])
                del best[self._k :]

    def best(self) -> Iterator[tuple[str | None, int, list]]:
        for (item, _, _), rows in zip(self._items, self._best, strict=True):
            for minus, _, _, ids in rows:
                yield item, -minus, ids


def _block_column(weighted: DataFrame) -> tuple[DataFrame, int]:
    """``weighted`` with the number of its item's block; blocks of ``BLOCK`` rows or one item."""
    blocks = 1
    while True:
        dealt = weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        sizes = dealt.groupBy("block", "item").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.groupBy("block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if large.where((F.col("n") > BLOCK) & (F.col("items") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


def _hits(classes: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """(item, score, ids) of the best classes of each task for one block of items."""
    by_item: dict[str | None, list[tuple[int, int]]] = {}
    for row in weighted.select("item", "id", "w").collect():
        by_item.setdefault(row["item"], []).append((row["id"], row["w"]))
    items = []
    for item, rows in by_item.items():
        numbers, weights = np.array(rows, np.int64).T
        items.append((item, numbers, weights))
    sent = classes.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        postings = Postings(sent.value, k)
        for batch in batches:
            if batch.num_rows:
                postings.add(batch)
        found = list(postings.best())
        for at in range(0, len(found), 10_000):
            item, score, ids = zip(*found[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(score, pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                ["item", "score", "ids"],
            )

    return classes.mapInArrow(run, "item string, score long, ids array<long>")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per item its ``k`` best documents: item_key, rank, key, score."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer column")
    entries = saved(_item_terms(items, item_key, item_text), "item-terms")
    vocabulary = saved(
        entries.select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "vocabulary"
    )
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bags = saved(_bags(rows, vocabulary), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    held = bags.select(F.explode("bag.id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000.0 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighted = entries.join(vocabulary, "term").join(held, "id")
    weighted, blocks = _block_column(
        saved(weighted.select("item", "id", weight.cast("long").alias("w")), "weights")
    )
    classes = saved(_classes(bags, n_docs, n_terms, k), "classes")
    hits = None
    for block in range(blocks):
        found = _hits(classes, weighted.where(F.col("block") == block), k)
        hits = found if hits is None else hits.union(found)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (
        hits.select("item", "score", F.explode("ids").alias("id"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(
            F.col("item").cast(items.schema[item_key].dataType).alias(item_key),
            "rank",
            F.col("id").cast(docs.schema[key].dataType).alias(key),
            "score",
        )
    )
