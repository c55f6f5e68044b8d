"""Long lists: runs of words found in the task that reads a text, and what is moved after that."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from padron.operators import term_index, term_runs

WORDS = ["sol", "mar", "ñandú", "a", "de", "x" * 50, "日本", "ß"]


def made(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_runs(text, sizes):
    words = (text or "").split()
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def map_of(runs):
    bits = np.zeros(1 << term_runs.SLOT_BITS, bool)
    for _, data, limits in term_runs._blocks(pa.array(runs)):
        bits[term_runs._Block(data).slots(limits[:-1], limits[1:])] = True
    return np.packbits(bits, bitorder="little")


@pytest.mark.parametrize("block", [1, 40, 500, 1 << 18])
def test_runs_do_not_depend_on_blocks(monkeypatch, block):
    rng = random.Random(1)
    texts = [made(rng, rng.randrange(40)) for _ in range(200)] + [None, "", "sol", made(rng, 2000)]
    column = pa.array(["left out", *texts])[1:]  # arrays with an offset, as slices of batches have
    monkeypatch.setattr(term_runs, "BLOCK", block)
    every = np.full((1 << term_runs.SLOT_BITS) // 8, 255, np.uint8)
    for sizes in ([1], [2, 3], [1, 2, 3], []):
        found = term_runs.found_runs(column, sizes, every).to_pylist()
        assert [sorted(f) for f in found] == [sorted(plain_runs(t, sizes)) for t in texts]  # each once
    asked = sorted(plain_runs(texts[-1], [3]))[:50] + ["y" * 5000]
    found = term_runs.found_runs(column, [3], map_of(asked)).to_pylist()
    assert [set(f) for f in found] == [plain_runs(t, [3]) & set(asked) for t in texts]
    assert term_runs.found_runs(pa.array([f"sol {'y' * 5000} sol"]), [1], map_of(asked)).to_pylist() == [["y" * 5000]]


def test_map_of_runs_of_many_tasks(spark):
    runs = [f"zona {i} norte" for i in range(3000)]
    table = spark.createDataFrame([(r,) for r in runs], "word string").repartition(13)
    assert (term_runs.asked_map(table, "word") == map_of(runs)).all()
    assert not term_runs.asked_map(table.limit(0), "word").any()


def test_expressions_without_arrays_equal_those_with(spark):
    rng = random.Random(4)
    letters = ["a", "sol", "ñandú", "C", "4", "½", "日本", "ǅ", "𝒜", "x́"]
    gaps = [" ", " ", "  ", ", ", "-", "\n", "\t", "_", "", "́", "\xa0", "\r\n", "🙂"]
    texts = ["".join(rng.choice(letters) + rng.choice(gaps) for _ in range(rng.randrange(14))) for _ in range(500)]
    texts += [f"{rng.choice(gaps)}{t}" for t in texts] + [t.strip() for t in texts]
    texts += [None, "", " ", "a ", " a", "a b", "a b\n", "a b c d e f g h"]
    body = F.array_join(term_index.plain_words(F.col("t")), " ")
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = table.select(
        "t", body.alias("plain"), F.array_join(F.slice(F.split(body, " "), 4, 3), " ").alias("three"),
        term_index.plain_text(F.col("t")).alias("a"), term_index.words_from(F.col("t"), 4, 3).alias("b"),
        term_index.is_plain(F.col("t")).alias("c"),
    ).collect()
    for r in rows:
        assert (r["a"], r["b"]) == (r["plain"], r["three"])
        assert r["c"] == (None if r["t"] is None else r["t"] == r["plain"] != "")
    assert 10 < sum(bool(r["c"]) for r in rows) < len(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def normal(spark):
    rng = random.Random(8)
    bodies = [made(rng, 30) for _ in range(60)]
    terms = sorted({" ".join(b.split()[3:6]) for b in bodies})
    return bodies, terms, spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int")


def test_hits_of_plain_texts_move_no_rows(spark, normal):
    """Neither texts nor hits are dealt out: each hit is known in the task that read the text."""
    bodies, terms, listed = normal
    texts = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    hits = term_index.listed_hits(texts, "id", "body", listed, keep=["place"])
    assert "hashpartitioning" not in plan(hits) and "SortMergeJoin" not in plan(hits)
    expected = {(i, t, terms.index(t)) for i, b in enumerate(bodies) for t in terms if f" {t} " in f" {b} "}
    rows = [tuple(r) for r in hits.collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 60


@pytest.mark.parametrize("sent", [1 << 21, 5])
def test_rows_of_one_key_are_one_text(spark, monkeypatch, normal, sent):
    """Terms of five words, terms and texts that are not plain, keys that come twice or are null, two places of a term."""
    monkeypatch.setattr(term_index, "MAX_SENT_RUNS", sent)
    bodies, _, _ = normal
    odd = [b.replace(" de ", ", de ") for b in bodies]
    texts = [(i % 20 if i % 7 else None, b) for i, b in enumerate([*bodies, *odd, None, "", "++", "sol+mar"])]
    terms = {" ".join(b.split()[a : a + n]) for b in bodies for a, n in ((3, 3), (8, 5), (1, 1))}
    terms |= {" ".join(b.split()[4:9]) for b in odd} | {"sol+mar", "+mar", "nowhere", "mar de nowhere de sol"}
    places = [(t, p) for t in sorted(terms) for p in ((1, 2) if len(t) % 2 else (3,))]

    def stands(term, text):
        at = -1
        while (at := text.find(term, at + 1)) >= 0:
            if not (at and text[at - 1].isalnum()) and not text[at + len(term) : at + len(term) + 1].isalnum():
                return True
        return False

    expected = sorted({(k, t, p) for k, b in texts for t, p in places if b is not None and stands(t, b)}, key=str)
    table = spark.createDataFrame(texts, "id int, body string").repartition(5)
    listed = spark.createDataFrame(places, "term string, place int")
    hits = term_index.listed_hits(table, "id", "body", listed, keep=["place"])
    assert sorted((tuple(r) for r in hits.collect()), key=str) == expected
    once = term_index.listed_hits(table, "id", "body", listed).collect()
    assert sorted((tuple(r) for r in once), key=str) == sorted({e[:2] for e in expected}, key=str)


def test_first_alias_is_found_without_sorting_the_hits(spark, normal):
    bodies, terms, _ = normal
    rng = random.Random(2)
    aliases = [(t, f"Z{i % 5}", rng.choice([None, 1, 2, 3])) for i, t in enumerate([*terms, *terms[:20]])]
    texts = spark.createDataFrame([(i // 2, b) for i, b in enumerate(bodies)], "id long, body string")
    listed = spark.createDataFrame(aliases, "term string, official string, place int")
    found = term_index.first_listed(texts, "id", "body", listed)
    assert "SortAggregate" not in plan(found)
    order = lambda a: (a[2] is not None, a[2] or 0, a[0], a[1])
    expected = {}
    for i, b in enumerate(bodies):
        held = [a for a in aliases if f" {a[0]} " in f" {b} "]
        expected[i // 2] = min([*held, *([expected[i // 2]] if i // 2 in expected else [])], key=order)
    got = {r["id"]: (r["term"], r["official"]) for r in found.collect()}
    assert got == {k: a[:2] for k, a in expected.items()} and len(got) == 30


def test_the_long_list_is_counted_where_texts_are_read(spark, tmp_path):
    """The query's hits meet no second join, and are dealt out as one row of a text at most."""
    from padron.plans import moderation_queries

    rng = random.Random(6)
    texts = [(i, made(rng, 20).title()) for i in range(80)] + [(80, None), (81, ""), (82, "sol mar")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = moderation_queries.long_term_list(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan(found) and plan(found).count("hashpartitioning") == 1
    bodies = {i: (t or "").lower() for i, t in texts}
    places = {}
    for i, b in sorted(bodies.items()):
        if term := " ".join(b.split()[3:6]):
            places.setdefault(term, i)
    expected = {i: [p for t, p in places.items() if f" {t} " in f" {b} "] for i, b in bodies.items()}
    got = {r["doc_id"]: (r["hits"], r["first_place"]) for r in found.collect()}
    assert got == {i: (len(p), min(p)) for i, p in expected.items() if p} and len(got) == 80
