"""Line dedup and quality rules."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ALL_IDS, COLUMNS, docs, empty, ids, lines, odd, prose, rows
from pyspark.sql import functions as F

from padron.llm import line_dedup, quality_rules
from padron.llm.words import WordMemory


def plain_lines(texts, least_chars=40, least_docs=5):
    """(n_lines, n_dropped, kept) per id, line by line."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = {}
    for i, text in texts.items():
        found = (text or "").split("\n")
        kept = [x for x in found if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == i]
        out[i] = (len(found), len(found) - len(kept), "\n".join(kept))
    return out


def test_lines_equal_a_plain_version(spark):
    rng = random.Random(3)
    shared = [f"Shared line number {i} with more than forty characters in it" for i in range(12)]
    texts = {}
    for i in range(1, 60):
        own = lines(i, 6).split("\n")
        for line in rng.sample(shared, rng.randrange(5)):
            form = rng.choice([line, line.upper(), "\t " + line + " \r", line])
            own.insert(rng.randrange(len(own) + 1), form)
        texts[i] = "\n".join(own)
    texts[60], texts[61] = "É" + shared[0][1:], shared[0] + " "
    df = docs(spark, list(texts.values()), list(texts))
    wanted = plain_lines(texts)
    report = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(df).collect()}
    assert report == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in wanted.items()}
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()} == {i: t for i, (_, _, t) in wanted.items()}
    assert sum(d for _, d, _ in wanted.values()) > 20


def test_lines_odd_and_empty(spark):
    df = odd(spark)
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns and ids(out) == ALL_IDS
    got = rows(out)
    assert (got["key"] == "extra key").all() and (got["_id"] == "extra _id").all()
    assert got[got.doc_id == 1].text.isna().all()  # a null text stays null
    report = rows(line_dedup.line_report(df))
    assert sorted(report.columns) == ["doc_id", "kept_sha256", "n_dropped", "n_lines"]
    assert (report[report.doc_id.isin([1, 2])].n_lines == 1).all() and (report.n_dropped == 0).all()
    assert line_dedup.line_report(empty(spark)).collect() == [] and line_dedup.deduplicated(empty(spark)).count() == 0


def test_a_line_everywhere_stays_once(spark):
    line = "a line that every document repeats, word for word"
    out = line_dedup.deduplicated(docs(spark, [f"{line}\n{i}\n{line}" for i in range(300)]))
    holders = [r.doc_id for r in out.collect() if line in r.text]
    assert holders == [300]


def plain_repeats(words):
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for at in range(len(words) - 2):
        if times[tuple(words[at : at + 3])] > 1:
            inside |= {at, at + 1, at + 2}
    return len(inside)


@pytest.mark.parametrize("seed", range(6))
def test_counts_equal_a_plain_version(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "Ab", "c", " ", " ", "\n", "\t", "\x0b", "#", "$%", "é", "😀", " ", "<"]) for _ in range(400))
    text += "\n" + "\n".join(rng.choice(["x y", "x y ", "", " ", "z"]) for _ in range(9))
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    got = quality_rules.counts(text, WordMemory(quality_rules._remembered))
    assert got[:5] == (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, plain_repeats(words)
    )
    assert sum(got[6]) == len(words)


def test_distance_is_zero_for_equal_and_one_for_disjoint():
    a = np.array([0.25, 0.75, 0, 0])
    got = quality_rules.distance(np.array([[1.0, 3, 0, 0], [0, 0, 5, 5]]), a)
    assert got[0] == pytest.approx(0, abs=1e-7) and got[1] == pytest.approx(1)


def test_rules_keep_clean_and_reject_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rows(quality_rules.report(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id"))
    judged = found[~found.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.15


@pytest.mark.parametrize("lang", ["en", "de"])
def test_junk_does_not_drag_the_reference_away(spark, lang):
    """A third of a language's rows is one kind of junk that passes the base rules."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    df = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("lang") == lang)
    clean = [r.text for r in df.join(labels, "doc_id").collect() if len(r.text.split()) >= 100]
    rng = random.Random(lang)
    junk = [" ".join(f"{rng.choice('#*$%')}{rng.randrange(10**6)}" for _ in range(300)) for _ in range(len(clean) // 2)]
    got = rows(quality_rules.report(docs(spark, clean + junk, lang=lang))).sort_values("doc_id")
    assert len(clean) > 30 and not got.base_failed[-len(junk) :].any()
    assert got.kept[: len(clean)].mean() > 0.99 and not got.kept[-len(junk) :].any()


def test_rules_odd_and_empty(spark):
    got = rows(quality_rules.report(odd(spark)))
    assert len(got) == len(ALL_IDS) and set(got.doc_id.dropna()) == {i for i in ALL_IDS if i is not None}
    assert got[got.doc_id == 1][["n_words", "word_chars", "n_dup_lines"]].to_numpy().tolist() == [[0, 0, 0]]
    assert got[got.doc_id.isin([1, 2, 3, 4])].base_failed.all()
    assert (1 << 60) + 1 in set(int(i) for i in got.doc_id.dropna().astype("int64"))
    assert quality_rules.report(empty(spark)).collect() == []
    assert set(COLUMNS) & set(got.columns) == {"doc_id"}
    assert prose(1, 3)
