"""Jaccard join and components."""

import random
import tracemalloc
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import ALL_IDS, docs, empty, ids, odd, prose, rows
from pyspark.sql import functions as F

from padron.llm import jaccard_join
from padron.llm.components import components
from padron.session import BATCH_CONF, saved


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_components(texts, k, percent):
    """(size, smallest reachable id) per id, over all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in texts}


def changed(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Copies, chains of near copies, a large group of near copies, shared passages, short texts."""
    rng = random.Random(seed)
    passage, base = prose("p", 60), prose("b", 120)
    out = [prose((seed, i).__hash__(), rng.randrange(3, 150)) for i in range(40)]
    out += [f"{prose((seed, i, 1).__hash__(), 40)} {passage} {prose((seed, i, 2).__hash__(), 30)}" for i in range(30)]
    out += [changed(base, rng, rng.randrange(7)) for _ in range(60)]
    chain = prose("chain", 200)
    for _ in range(12):
        chain = changed(chain, rng, 3)
        out.append(chain)
    out += [out[0], out[0].upper(), out[1] + "\n", "a b c", "a b c", "A  b\tc", "a b", "", "   "]
    out += [passage + f" end{i}" for i in range(25)]
    rng.shuffle(out)
    return dict(enumerate(out, 1))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_equal_to_all_pairs(spark, k, percent):
    texts = corpus(k)
    got = rows(jaccard_join.near_copies(docs(spark, list(texts.values()), list(texts)), words=k, percent=percent))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == plain_components(texts, k, percent)


def test_blocks_of_a_frequent_shingle(spark, monkeypatch):
    """A shingle that more documents hold than fit a block is compared block by block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = corpus(9)
    got = rows(jaccard_join.near_copies(docs(spark, list(texts.values()), list(texts))))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == plain_components(texts, 4, 85)


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps_refuse_no_link(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 5, 60, 500, 3000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for cut in range(0, max(1, len(x) // 12)):
            y = np.concatenate([x[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            apart = jaccard_join.apart(jaccard_join.bitmap(x, 1), jaccard_join.bitmap(np.unique(y), 4))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert apart <= jaccard_join.most_apart(len(x) + len(y), 85)


def test_prefix_lengths_meet():
    """Sets that just reach the threshold share a shingle of their prefixes."""
    for percent in (80, 85):
        for a in range(1, 120):
            for b in range(a, a * 100 // percent + 1):
                least = -(-percent * (a + b) // (100 + percent))
                assert a - least + 1 <= jaccard_join.index_length(a, percent)
                assert b - least + 1 <= jaccard_join.probe_length(b, percent)


@pytest.mark.parametrize("rare", [16, 3])
def test_a_full_list_of_frequent_shingles_loses_nothing(spark, monkeypatch, rare):
    """Shingles that are not listed, and groups of many sets, go through bitmaps and blocks."""
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", 5)
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    texts = corpus(8)
    found = jaccard_join.near_copies(docs(spark, list(texts.values()), list(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == plain_components(texts, 4, 85)


def test_low_thresholds_link_sets_of_very_different_sizes(spark):
    """Bitmaps of sizes that are several powers of two apart are folded to each other."""
    passage = prose("common", 60)
    texts = {i: f"{passage} {prose(i, 5 * i)}" for i in range(1, 41)}
    found = jaccard_join.near_copies(docs(spark, list(texts.values()), list(texts)), percent=25)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == plain_components(texts, 4, 25)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    links += [(5000 + i, 5000 + (i + 1) % 17) for i in range(17)] + [(7, 7), (9001, 9000)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = defaultdict(set)
    for node, component in got.items():
        groups[component].add(node)
    assert groups == {
        0: set(range(201)), 1000: set(range(1000, 1300)), 5000: set(range(5000, 5017)), 9000: {9000, 9001}
    }
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_and_empty(spark):
    df = odd(spark)
    got = jaccard_join.near_copies(df)
    assert ids(got) == ALL_IDS
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[6] == (0, 6)
    assert found[5] == (1, 5) and found[(1 << 60) + 1][1] == (1 << 60) + 1 and found[8][1] == 8
    kept = jaccard_join.first_of_copies(df)
    assert kept.columns == df.columns
    assert ids(kept) == sorted(set(ALL_IDS) - {None}) + [None, None]  # one of the repeated rows
    assert jaccard_join.near_copies(empty(spark)).collect() == []
    assert jaccard_join.first_of_copies(empty(spark)).collect() == []


def test_first_of_copies_keeps_one_of_each_group(spark):
    texts = corpus(3)
    kept = ids(jaccard_join.first_of_copies(docs(spark, list(texts.values()), list(texts)), words=5, percent=80))
    assert kept == sorted({c for _, c in plain_components(texts, 5, 80).values()})


class Counting:
    """Stands for documents; keeps the function that counts shingles in tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.count = function
        raise KeyError

    mapInPandas = mapInArrow


def test_counting_holds_few_copies_of_a_tasks_shingles(monkeypatch):
    n, made = 1_000_000, Counting()
    with pytest.raises(KeyError):
        jaccard_join._frequent(made, 5, 16)
    monkeypatch.setattr(jaccard_join, "FLUSH", n)
    numbers = np.random.default_rng(3).integers(0, 1 << 64, n, np.uint64, endpoint=False)
    monkeypatch.setattr(jaccard_join, "_shingled", lambda k: lambda text: numbers.copy())
    tracemalloc.start()
    rows_ = sum(batch.num_rows for batch in made.count(iter([pa.RecordBatch.from_pydict({"text": ["a"]})])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows_ == 16 and most < 3.5 * numbers.nbytes


def test_texts_reach_python_in_small_batches(spark, tmp_path):
    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [batch.num_rows]}) for batch in batches)

    long = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    before = spark.conf.get(BATCH_CONF, None)
    assert max(r.n for r in saved(long.mapInArrow(sizes, "n long"), "batches").collect()) < 1000
    assert spark.conf.get(BATCH_CONF, None) == before
