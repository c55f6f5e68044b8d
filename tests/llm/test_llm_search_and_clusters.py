"""Lexical search, LSH forest, clustering by ns-bounds."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ALL_IDS, CLASHING, docs, empty, ids, odd, prose, rows
from pyspark.sql import functions as F
from test_llm_copies import changed, corpus, plain_components

from padron.llm import bag_search, lsh_forest, ns_bounds

# lexical search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_ranking(texts, items, k):
    """{item: [(id, score)]}; ``texts`` and ``items``: lists of (id, text)."""
    bags = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in texts]
    n_docs, n_terms = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(plain_terms(text))
    out = {}
    for item, own in wanted.items():
        found = []
        for i, bag, n in bags:
            m = 10 + (90 * n * n_docs) // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in own
                if bag[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item] = [(i, -minus) for minus, _, _, i in sorted(found)[:k]]
    return {item: found for item, found in out.items() if found}


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def ranking(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["rank"])):
        out[r["item_id"]].append((r["doc_id"], r["score"], r["rank"]))
    assert all([rank for _, _, rank in own] == list(range(1, len(own) + 1)) for own in out.values())
    return {item: [(i, s) for i, s, _ in own] for item, own in out.items()}


def search_corpus():
    rng = random.Random(5)
    texts = [prose(("s", i).__hash__(), rng.randrange(1, 90), 60) for i in range(120)]
    texts += [texts[3]] * 25  # a hot class: more members than ranks
    texts += [texts[4].upper(), texts[4] + " zz", " ".join(reversed(texts[4].split())), None, "", "ÑÁ日本 w1x"]
    items = [(i, prose(("q", i).__hash__(), 12, 60)) for i in range(9)]
    items += [(20, texts[3]), (21, None), (22, "nowhereword"), (23, "ñÁ日本 W1X"), (None, "w2x w3x"), (20, "w5x")]
    return list(enumerate(texts, 1)), items


@pytest.mark.parametrize("terms, block", [(500_000, 2_000_000), (0, 30)])
def test_ranking_equals_plain_version(spark, monkeypatch, terms, block):
    """Also with a vocabulary too large to send and items in many blocks."""
    monkeypatch.setattr(bag_search, "MAX_TERMS", terms)
    monkeypatch.setattr(bag_search, "BLOCK", block)
    texts, items = search_corpus()
    table = docs(spark, [t for _, t in texts], [i for i, _ in texts]).repartition(7)
    found = ranking(bag_search.ranked(table, items_table(spark, items), k=4))
    assert found == plain_ranking(texts, items, 4)


def test_ranking_does_not_depend_on_batches(spark):
    texts, items = search_corpus()
    table, wanted = docs(spark, [t for _, t in texts], [i for i, _ in texts]), items_table(spark, items)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = ranking(bag_search.ranked(table, wanted))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == plain_ranking(texts, items, 10)


def test_equal_scores_rise_by_id_without_id_last(spark):
    texts = [(i, "alpha beta") for i in (9, None, 3, 3, 7, 1 << 60)] + [(1, "gamma")]
    found = ranking(bag_search.ranked(docs(spark, *zip(*[(t, i) for i, t in texts])), items_table(spark, [(1, "alpha")])))
    assert [i for i, _ in found[1]] == [3, 3, 7, 9, 1 << 60, None]
    assert found == plain_ranking(texts, [(1, "alpha")], 10)


def test_a_class_holds_documents_of_equal_bag_and_length_factor(spark):
    table = docs(spark, ["a b x", "b a y", "a b x y z z z z z z z z z z", "a a b"])
    known = items_table(spark, [(1, "a b")])
    vocabulary = bag_search._item_terms(known, "item_id", "text").select("term").withColumn(
        "id", F.monotonically_increasing_id()
    )
    bags = bag_search._bags(table.select(F.col("doc_id").alias("id"), "text"), vocabulary)
    classes = bag_search._classes(bags, 4, 23, 10)
    assert sorted(sorted(r["ids"]) for r in classes.collect()) == [[1, 2], [3], [4]]


def test_search_in_odd_tables(spark):
    wanted = items_table(spark, [(1, "one"), (2, prose(1, 60))]).withColumns({c: F.lit(c) for c in CLASHING})
    found = ranking(bag_search.ranked(odd(spark), wanted))
    assert found[1] == [(5, found[1][0][1])]
    assert {8, None} <= {i for i, _ in found[2]}
    assert bag_search.ranked(empty(spark), wanted).count() == 0
    assert bag_search.ranked(odd(spark), items_table(spark, [])).count() == 0
    with pytest.raises(TypeError):
        bag_search.ranked(odd(spark), wanted, key="lang")


# LSH forest


def by_id(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def plain_kept(texts, words, percent):
    return {i: (n, c, i == c) for i, (n, c) in plain_components(texts, words, percent).items()}


@pytest.mark.parametrize("block, first", [(256, 2), (5, 0)])
def test_forest_components_equal_all_pairs(spark, monkeypatch, block, first):
    """Whatever the blocks, and if neighbours find nothing in the first round."""
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    monkeypatch.setattr(lsh_forest, "FIRST_TREES", first)
    texts = corpus(11)
    table = docs(spark, list(texts.values()), list(texts))
    assert by_id(lsh_forest.near_duplicates(table)) == plain_kept(texts, 4, 80)


def test_forest_finds_single_links_between_large_regions(spark, monkeypatch):
    """Two groups of near copies share most of their text; few pairs across reach the threshold."""
    rng = random.Random(3)
    base = prose("two", 300)
    other = changed(base, rng, 12)
    texts = [changed(base, rng, 3) for _ in range(40)] + [changed(other, rng, 3) for _ in range(40)]
    texts += [changed(changed(base, rng, 1), rng, 8) for _ in range(40)]
    known = dict(enumerate(texts, 1))
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)
    assert by_id(lsh_forest.near_duplicates(docs(spark, texts))) == plain_kept(known, 4, 80)


def test_links_at_the_threshold(spark):
    """4 of 5 shingles and 80 of 100 link; 79 of 100 do not."""
    same, other = ([f"{c}{i}" for i in range(103)] for c in "st")
    texts = ["a b c d e f g h", "a b c d e f g", " ".join(same), " ".join(other[:82]), " ".join(same[:83])]
    texts.append(" ".join(other))
    got = by_id(lsh_forest.near_duplicates(docs(spark, texts)))
    assert [got[i][1] for i in range(1, 7)] == [1, 1, 3, 4, 3, 6]
    assert got == plain_kept(dict(enumerate(texts, 1)), 4, 80)


def test_forest_does_not_depend_on_partitions(spark, partitions):
    texts = corpus(12)
    partitions(40)
    table = docs(spark, list(texts.values()), list(texts)).repartition(40)
    assert by_id(lsh_forest.near_duplicates(table)) == plain_kept(texts, 4, 80)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    both, left, right = (rng.integers(0, 1 << 64, n, np.uint64) for n in (800, 100, 100))
    minhash = lsh_forest.Minhash(512)
    x, y = (minhash(np.concatenate([both, own])) for own in (left, right))
    assert abs(float((x == y).mean()) - 0.8) < 0.07
    large = rng.integers(0, 1 << 64, 50_000, np.uint64)
    assert (minhash(large) == minhash(rng.permutation(large))).all()


def test_trees_and_refusals_follow_the_threshold():
    assert lsh_forest.trees_for(80) == 31
    assert (1 - 0.8**lsh_forest.DEPTH) ** lsh_forest.trees_for(80) < lsh_forest.MISS
    assert lsh_forest.trees_for(50) > 200 and lsh_forest.trees_for(95) < 12


def test_forest_of_lower_threshold(spark):
    texts = dict(list(corpus(13).items())[:60])
    table = docs(spark, list(texts.values()), list(texts))
    assert by_id(lsh_forest.near_duplicates(table, percent=60)) == plain_kept(texts, 4, 60)


def test_forest_in_odd_tables(spark):
    found = lsh_forest.near_duplicates(odd(spark))
    assert ids(found) == ALL_IDS
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()]
    sized = {(i, n > 0, c) for i, n, c, _ in got}
    assert {(1, False, 1), (2, False, 2), (6, False, 6), (None, True, None), (8, True, 8)} <= sized
    assert all(kept == (i == c) for i, _, c, kept in got)
    assert lsh_forest.near_duplicates(empty(spark)).count() == 0
    lonely = docs(spark, [None, prose(8, 40)], [None, None])
    assert [r["kept"] for r in lsh_forest.near_duplicates(lonely).collect()] == [True, True]


# clustering


def plain_clusters(vectors, k, rounds, dims=64, scale=1024):
    """[(id, cluster, distance)] and the centroids; ``vectors``: (id, list)."""
    kept = []
    for i, x in vectors:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(scale * v) for v in x]))
    order = sorted(
        kept,
        key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]),
    )
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        centroids = [
            [sum(v) // len(groups[j]) for v in zip(*groups[j])] if groups[j] else c
            for j, c in enumerate(centroids)
        ]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept], centroids


def vectors(seed, n, dims=64, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    made = centres[rng.integers(0, groups, n)] * 0.5 + rng.normal(size=(n, dims)) * 0.4
    return [(i, [float(v) for v in x.astype(np.float32)]) for i, x in enumerate(made)]


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def same_clusters(df, expected):
    plain, centroids = expected
    found = df.collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=order) == sorted(plain, key=order)
    own = Counter()
    for _, c, d in plain:
        own[c] += d
    for r in found:
        assert (r["cluster_inertia"], r["inertia"]) == (own[r["cluster"]], sum(own.values()))
        digest = hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["centroid_sha256"] == digest


@pytest.mark.parametrize("renew", [0.0, 0.2, 2.0])
def test_clusters_equal_plain_version(spark, monkeypatch, renew):
    """With bounds written anew in every round, when needed, and never."""
    monkeypatch.setattr(ns_bounds, "RENEW", renew)
    given = vectors(2, 400)
    found = ns_bounds.clustered(vector_table(spark, given).repartition(5))
    same_clusters(found, plain_clusters(given, 8, 10))


def test_bounds_skip_vectors_and_never_change_a_result():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (8, 16))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-400, 400, (3000, 16))
    then = centres + rng.integers(-60, 60, centres.shape)
    cluster, upper, lower = ns_bounds.evaluated(x, then)
    skipped = 0
    history = [then]
    for _ in range(8):
        history.append(history[-1] + rng.integers(-60, 60, centres.shape))
        got, failed = ns_bounds.reassigned(x, cluster, upper, lower, then, history[-1])
        assert (got == ns_bounds.distances(x, history[-1]).argmin(1)).all()
        skipped += int((~failed).sum())
    assert skipped > 0.5 * 8 * len(x)
    total = ns_bounds.displacement(then, history[-1])
    summed = sum(ns_bounds.displacement(a, b) for a, b in zip(history, history[1:]))
    assert (total < summed).all()  # the point of keeping the history


def test_ties_empty_clusters_and_repeated_vectors(spark):
    line = [0.0] * 63
    given = [(i, [0.25 * (i % 3), *line]) for i in range(30)] + [(100 + i, [0.125, *line]) for i in range(5)]
    given += [(7, given[7][1])] * 20
    same_clusters(ns_bounds.clustered(vector_table(spark, given)), plain_clusters(given, 8, 10))


def test_clustering_odd_tables(spark):
    good = vectors(6, 12)
    nan, inf = float("nan"), float("inf")
    given = good + [(50, None), (51, []), (52, [0.0] * 63), (53, [None] + [0.0] * 63), (54, [nan] * 64)]
    given += [(55, [inf] + [0.0] * 63), (56, [-0.0] * 64), (None, [0.5] * 64), (3, [0.1] * 64)]
    extra = vector_table(spark, given).withColumns({c: F.lit(c) for c in [*CLASHING, "vec", "x", "cluster", "upper"]})
    same_clusters(ns_bounds.clustered(extra), plain_clusters(given, 8, 10))
    few = good[:3]
    same_clusters(ns_bounds.clustered(vector_table(spark, few)), plain_clusters(few, 8, 10))
    none = ns_bounds.clustered(vector_table(spark, []))
    assert none.count() == 0 and none.columns == ns_bounds.clustered(vector_table(spark, few)).columns
    with pytest.raises(Exception, match="beyond"):
        ns_bounds.clustered(vector_table(spark, [*few, (9, [1e9] * 64)])).count()


def test_queries_of_the_round_equal_plain_versions(spark):
    """The registered forest query on the whole small table, against all pairs."""
    from padron.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    assert by_id(queries.QUERIES["op12_minhash_forest"](spark, sf)) == plain_kept(texts, 4, 80)
    assert len(rows(queries.QUERIES["op11_lexical_search"](spark, sf)))
