"""Near copies by an LSH forest: sorted signature orders, common prefixes, confirmed on whole sets.

1. One pass gives each document its number of shingles, a digest of the set, a parity bitmap and
   a signature: 16 bits of each of ``DEPTH`` x trees minhashes. Equal sets are one class from here
   on.
2. A tree sorts the classes by its own order of the signature: its first ``DEPTH`` values, then
   those of the next tree. Classes that agree in the first ``DEPTH`` values are a region. The
   sort is by ranges of the whole order, so a large region is spread over many tasks; the last
   row of one range and the first of the next are compared by a table of a row per range.
3. Neighbours in an order are those of the longest common prefix, however long that is: deep
   where a region is dense, shallow where it is sparse. The neighbours of the first trees are
   confirmed and joined to components; then, over all trees, neighbours that are still apart.
   Large groups of near copies so become one component by about as many pairs as members.
4. What lies in one region but in different components by then is compared in full: regions are
   dealt out in blocks and a task compares two blocks by their bitmaps. Those of two sets have at
   most as many unlike bits as there are shingles in one set alone, so a bitmap refuses pairs but
   never a link. First each task names a forest of possible links, one pair where it can join two
   components, and these are confirmed beside the neighbours of 3; then all pairs that are still
   apart. So no neighbour limit loses a link, and links inside a component are not asked for.
5. A pair is confirmed on both whole sets. Components are those of the confirmed links.

What can be lost: a pair that shares no region in any tree. The number of trees follows the
threshold so that this has a chance below ``MISS`` (1e-7) for a pair just at the threshold, and
less above it.

Defined results: without words a document has size 0 and is linked with nothing. Documents with
equal sets have one component, whatever their ids; a row without id has the component of its
copies (null where there is none) and is kept only without one. Rows of one id are told apart by
their sets and kept alike. Ids are of any type with an order. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from padron.llm.components import components
from padron.llm.jaccard_join import apart, bitmap, folds, most_apart
from padron.llm.words import WordMemory, hashes, mixed, runs, shingle_hashes, slices, word_hash, words
from padron.session import saved

#: Signature values in which the members of a region agree.
DEPTH = 4
#: The chance to miss a pair at the threshold.
MISS = 1e-7
#: Trees whose neighbours are confirmed first.
FIRST_TREES = 2
#: Classes of one block of a region.
BLOCK = 256
#: Bits of a bitmap for each shingle, at least.
BITS = 4
#: Most rows to broadcast for fetching texts; beyond it, the tables are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Hashes times signature values that are worked on at once.
SLAB = 1 << 20


def trees_for(percent: int) -> int:
    """Trees by which a pair at the threshold shares a region but for a chance of ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** DEPTH))


class Minhash:
    """Signatures of sets of 64-bit hashes; the functions follow from their number alone."""

    def __init__(self, values: int) -> None:
        draw = np.random.Generator(np.random.PCG64(12))
        self._flip = draw.integers(0, 1 << 64, values, np.uint64)[:, None]
        self._odd = draw.integers(0, 1 << 64, values, np.uint64)[:, None] | np.uint64(1)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        """The low 16 bits of each function's smallest value over a set that is not empty."""
        step = max(1, SLAB // len(self._odd))
        least = None
        for at in range(0, len(own), step):
            part = ((own[None, at : at + step] ^ self._flip) * self._odd).min(1)
            least = part if least is None else np.minimum(least, part)
        return mixed(least).astype(np.uint16)


def _set_maker(k: int):
    memory = WordMemory(word_hash)
    return lambda text: np.unique(shingle_hashes(hashes(words(text), memory), k))


def _digest(own: np.ndarray) -> tuple[int, int]:
    first, second = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
    return first, second


# 1. signatures and classes


def _signed(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """(id, n, d1, d2, signature, bits) per row; no signature and no bitmap without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of, minhash = _set_maker(k), Minhash(DEPTH * trees)
        for batch in slices(batches):
            n, d1, d2, signatures, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = set_of(text)
                first, second = _digest(own)
                n.append(len(own))
                d1.append(first)
                d2.append(second)
                signatures.append(minhash(own).tobytes() if len(own) else None)
                bits.append(bitmap(own, BITS) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n, pa.int32()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(bits, pa.binary()),
                ],
                ["id", "n", "d1", "d2", "signature", "bits"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n int, d1 long, d2 long, signature binary, bits binary")


def _classes(signed: DataFrame) -> DataFrame:
    """(node, d1, d2, n, id, signature, bits): a row per distinct set, with its smallest id."""
    found = signed.where("n > 0").groupBy("d1", "d2").agg(
        F.any_value("n").alias("n"),
        F.min("id").alias("id"),
        F.any_value("signature").alias("signature"),
        F.any_value("bits").alias("bits"),
    )
    return saved(found.withColumn("node", F.monotonically_increasing_id()), "classes")


# 2. sorted orders


def _orders(classes: DataFrame, trees: int) -> DataFrame:
    """(region, rest, node, tree): a class's place in each tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = b"".join(batch.column("signature").to_pylist())
            values = np.frombuffer(cells, np.uint64).reshape(-1, trees)
            # Equal first values, equal number; the tree is mixed in, so orders don't meet.
            region = mixed(values ^ tree)
            rest = np.roll(values, -1, axis=1)
            node = np.repeat(batch.column("node").to_numpy(), trees)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(region.ravel().view(np.int64)),
                    pa.array(rest.ravel().view(np.int64)),
                    pa.array(node),
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)),
                ],
                ["region", "rest", "node", "tree"],
            )

    return classes.select("node", "signature").mapInArrow(
        run, "region long, rest long, node long, tree int"
    )


def _sorted_forest(orders: DataFrame) -> DataFrame:
    """(region, node, tree, before, part, edge): rows of regions of two or more, in order.

    ``before``: the class before it in the same region. The first (edge 1) and the last (edge 2)
    row of a range are carried in any case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, whose successor is not known yet
        first = True
        names = ["region", "node", "tree", "part"]

        def rows(region, node, tree, part, before, shared, edge):
            keep = shared | (edge > 0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(region[keep]),
                    pa.array(node[keep]),
                    pa.array(tree[keep]),
                    pa.array(before[keep], mask=before[keep] < 0),
                    pa.array(part[keep]),
                    pa.array(edge[keep]),
                ],
                ["region", "node", "tree", "before", "part", "edge"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                new = [np.concatenate([h, v]) for h, v in zip(held, new, strict=True)]
            region, node, tree, part = new
            same = region[1:] == region[:-1]
            # The held row's link to its own predecessor was kept beside it.
            with_before = np.concatenate([[carried if held is not None else False], same])
            before = np.where(with_before, np.concatenate([[before_held if held is not None else -1], node[:-1]]), -1)
            shared = with_before.copy()
            shared[:-1] |= same
            edge = np.zeros(len(region), np.int32)
            edge[0] = first
            if len(region) > 1:
                yield rows(*(v[:-1] for v in (region, node, tree, part, before, shared, edge)))
                first = False
            held = tuple(v[-1:] for v in new)
            carried, before_held = bool(with_before[-1]), int(before[-1])
        if held is not None:
            region, node, tree, part = held
            yield rows(
                region, node, tree, part, np.array([before_held]), np.array([carried]),
                np.array([3 if first else 2], np.int32),
            )

    ranged = orders.repartitionByRange("region", "rest", "node").sortWithinPartitions(
        "region", "rest", "node"
    )
    found = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(
        run, "region long, node long, tree int, before long, part int, edge int"
    )
    return saved(found, "forest")


def _neighbours(forest: DataFrame) -> DataFrame:
    """(a, b, tree): neighbours in an order, each pair once with its first tree."""
    inner = forest.where("before IS NOT NULL").select("before", "node", "tree")
    # A row per range of the sort: its first row, and the last row of the range before.
    edges = forest.where("edge > 0").groupBy("part").agg(
        F.max(F.when(F.col("edge").bitwiseAND(1) > 0, F.struct("region", "node", "tree"))).alias("first"),
        F.max(F.when(F.col("edge") >= 2, F.struct("region", "node", "tree"))).alias("last"),
    )
    last = F.lag("last").over(Window.orderBy("part"))
    across = (
        edges.withColumn("last", last)
        .where("last.region = first.region")
        .select(F.col("last.node").alias("before"), "first.node", "first.tree")
    )
    pairs = inner.union(across).where("before <> node")
    return saved(
        pairs.groupBy(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).agg(
            F.min("tree").alias("tree")
        ),
        "neighbours",
    )


# 3. and 5. confirmed pairs


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "total")), strict=True)
            keep = [apart(x, y) <= most_apart(total, percent) for x, y, total in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = classes.select("node", "n", "bits")
    return (
        pairs.select("a", "b")
        .join(sides.toDF("a", "na", "x"), "a")
        .join(sides.toDF("b", "nb", "y"), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("total"))
        .mapInArrow(run, "a long, b long")
    )


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(node, own): the whole set of every class of ``pairs``, made from its first text again."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = saved(nodes.join(classes.select("node", "id", "d1", "d2"), "node"), "wanted")
    ids = wanted.select(F.col("id").alias("_wanted")).distinct()
    count = wanted.count()
    if count <= MAX_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, docs["id"].eqNullSafe(F.col("_wanted")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = _set_maker(k)
        for batch in slices(batches):
            found = [set_of(t) for t in batch.column("text").to_pylist()]
            found = [own for own in found if len(own)]
            digests = [_digest(own) for own in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in digests], pa.int64()),
                    pa.array([d for _, d in digests], pa.int64()),
                    pa.array([own.tobytes() for own in found], pa.binary()),
                ],
                ["d1", "d2", "own"],
            )

    made = rows.mapInArrow(run, "d1 long, d2 long, own binary")
    made = saved(made.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "own"), "sets")
    if made.count() > count:  # rows of one id and one set
        made = saved(made.groupBy("node").agg(F.any_value("own").alias("own")), "sets")
    return made


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (rising, without repeats) reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def _confirmed(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int
) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""
    pairs = saved(_alike(pairs, classes, percent), "pairs")
    own = _sets(docs, classes, pairs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            keep = [
                linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    return saved(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose classes lie in different components."""
    label = known.select("node", "component")
    return (
        pairs.join(label.toDF("a", "ca"), "a", "left")
        .join(label.toDF("b", "cb"), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
    )


# 4. regions of several components


def possible_links(
    n: np.ndarray, block: np.ndarray, component: np.ndarray, bits: list[bytes], percent: int, forest: bool
) -> tuple[list[int], list[int]]:
    """Places of pairs of different components that may be linked; rows rise by size.

    ``forest``: a pair joins its components, so there are less pairs than rows. Rows of two
    blocks are only paired across, those of one block with each other.
    """
    label = np.unique(component, return_inverse=True)[1]
    two = block.min() != block.max()
    length, folded, place = folds(bits)
    left, right = [], []
    for x in range(len(n) - 1):
        stop = int(np.searchsorted(n, 100 * int(n[x]) // percent, "right"))
        y = np.arange(x + 1, stop)
        y = y[(label[y] != label[x]) & ((block[y] != block[x]) if two else True)]
        if not len(y):
            continue
        rows, at = folded[length[x]], place[length[x]]
        unlike = np.bitwise_count(rows[at[y]] ^ rows[at[x]]).sum(1)
        y = y[unlike <= most_apart(n[y] + int(n[x]), percent)]
        if forest and len(y):
            kinds, first = np.unique(label[y], return_index=True)
            y = y[first]
            label[np.isin(label, kinds)] = label[x]
        left += [x] * len(y)
        right += y.tolist()
    return left, right


def _across(
    forest: DataFrame, classes: DataFrame, known: DataFrame, percent: int, thin: bool
) -> DataFrame:
    """Pairs (a, b) of one region and different components that bitmaps do not refuse.

    ``thin``: for each task a forest of them only.
    """
    labelled = (
        forest.select("region", "node")
        .join(known, "node", "left")
        .select("region", "node", F.coalesce("component", "node").alias("component"))
    )
    # The component that holds most of a region is not compared with itself: its rows go to the
    # blocks of the others only, so a region of one large and some small ones grows by rows.
    held = labelled.groupBy("region", "component").agg(F.count(F.lit(1)).alias("held"))
    blocks = F.ceil(F.col("held") / F.lit(BLOCK)).cast("int")
    mixed_regions = (
        held.groupBy("region")
        .agg(F.max(F.struct("held", "component")).alias("main"), F.sum("held").alias("held"))
        .withColumn("held", F.col("held") - F.col("main.held"))
        .where("held > 0")
        .select(
            "region",
            F.col("main.component").alias("main"),
            blocks.alias("others"),
            F.ceil(F.col("main.held") / F.lit(BLOCK)).cast("int").alias("mains"),
        )
    )
    is_main = F.col("component") == F.col("main")
    place = F.xxhash64("node")
    own = F.when(is_main, F.pmod(place, F.col("mains"))).otherwise(
        F.col("mains") + F.pmod(place, F.col("others"))
    )
    rows = labelled.join(mixed_regions, "region").withColumn("block", own.cast("int"))
    # Blocks 0 to mains - 1 hold the main component, those from there on the others.
    first = F.when(is_main, F.col("mains")).otherwise(F.lit(0))
    other = F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1))
    dealt = (
        rows.withColumn("other", other)
        .select(
            "region", "node", "component", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
        .join(classes.select("node", "n", "bits"), "node")
        .repartition("region", "i", "j")
        .sortWithinPartitions("region", "i", "j", "n", "node")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["region", "i", "j"]
        for batch in runs(batches, keys):
            for _, rows in batch.groupby(keys, sort=False):
                component, block = rows["component"].to_numpy(), rows["block"].to_numpy()
                if len(rows) < 2 or (component == component[0]).all():
                    continue
                if rows["i"].iat[0] != rows["j"].iat[0] and block.min() == block.max():
                    continue
                node, n = rows["node"].to_numpy(), rows["n"].to_numpy(np.int64)
                left, right = possible_links(n, block, component, rows["bits"].tolist(), percent, thin)
                if left:
                    pairs = node[left], node[right]
                    yield pd.DataFrame({"a": np.minimum(*pairs), "b": np.maximum(*pairs)})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80
) -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id, kept (the first of its component)."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    trees = trees_for(percent)
    signed = saved(_signed(docs, words, trees), "signatures")
    classes = _classes(signed)
    forest = _sorted_forest(_orders(classes, trees))
    neighbours = _neighbours(forest)

    first = neighbours.where(F.col("tree") < FIRST_TREES)
    links = _confirmed(docs, classes, first, words, percent)
    known = saved(components(links), "components")
    others = _apart(neighbours.where(F.col("tree") >= FIRST_TREES), known)
    rest = saved(others.union(_across(forest, classes, known, percent, thin=True)).distinct(), "apart")
    # The last round names all that is left apart, so there is none after it.
    for last in (False, True):
        if rest.isEmpty():
            break
        found = _confirmed(docs, classes, rest, words, percent)
        if not found.isEmpty():
            links = links.union(found)
            known = saved(components(links), "components")
        if not last:
            rest = saved(_across(forest, classes, known, percent, thin=False), "across")

    labelled = classes.join(known, "node", "left").select(
        "d1", "d2", "id", F.coalesce("component", "node").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labelled.join(smallest, "component").select("d1", "d2", "component_id")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return (
        signed.select("id", "n", "d1", "d2")
        .join(named, ["d1", "d2"], "left")
        .select(
            F.col("id").alias(key),
            F.col("n").cast("long").alias("n_shingles"),
            own.alias("component_id"),
            F.col("id").eqNullSafe(own).alias("kept"),
        )
    )
