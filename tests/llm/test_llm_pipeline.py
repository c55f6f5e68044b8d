"""The pipeline, the registered queries and their SQL."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import COLUMNS, docs, empty, ids, odd, prose
from oracle import compare, connect
from test_llm_copies import changed, plain_components
from test_llm_lines_and_rules import plain_lines
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from padron.llm import queries as llm_queries
from padron.session import saved

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = {int(n[2:].split("_")[0]) for n in llm_queries.QUERIES}
    assert names == set(range(1, 14)) and set(llm_queries.QUERIES) <= set(queries())
    assert queries()["pipeline"] is corpus_pipeline.run
    assert set(llm_queries.SQL) <= set(oracle_sql()) and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", sorted(llm_queries.SQL))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_equals_sql(spark, name, sf):
    assert compare(spark, connect(sf), llm_queries.QUERIES[name], llm_queries.SQL[name], sf) is None


def test_native_query_runs_no_python(spark):
    plan = llm_queries.QUERIES["op1_line_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert bad not in plan


def stages(spark, start):
    """What each stage leaves, written and read again."""
    out = [start]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(saved(stage(spark, out[-1], SF), f"test-{number}"))
    return out


def test_stages_against_plain_versions(spark):
    rng = random.Random(4)
    table = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {5000 + i: prose(f"clean{i}", 150) + "." for i in range(30)}
    shared = "a line of boilerplate that is long enough to be counted"
    repeated = {5100 + i: prose(f"line{i}", 60) + f".\n{shared}\n" + prose(f"line2{i}", 60) + "." for i in range(8)}
    base = prose("near", 200)
    near = {5200 + i: changed(base, rng, i) for i in range(6)}
    leaks = {5300 + i: prose(f"leak{i}", 80) + " " + benchmark[i] + " " + prose(f"leak2{i}", 80) for i in range(10)}
    junk = {5400 + i: " ".join(f"{w}%%% ***" for w in prose(f"junk{i}", 100).split()) for i in range(5)}
    made = clean | repeated | near | leaks | junk
    start = saved(table.unionByName(docs(spark, list(made.values()), list(made))), "test-start")
    _, good, lines, single, decontaminated, encoded = stages(spark, start)
    for df in (good, lines, single, decontaminated):
        assert df.columns == COLUMNS
    kept = set(ids(good))
    assert kept & set(made) == set(made) - set(junk)
    texts = {r.doc_id: r.text for r in good.collect()}
    after = {r.doc_id: r.text for r in lines.collect()}
    assert after == {i: t for i, (_, _, t) in plain_lines(texts).items()}
    assert [i for i in repeated if shared in after[i]] == [5107]
    components = plain_components(after, 5, 80)
    assert ids(single) == sorted({c for _, c in components.values()})
    assert set(ids(decontaminated)) & set(leaks) == set()
    assert set(ids(single)) - set(ids(decontaminated)) <= set(leaks) | {i for i in texts if i < 5000}
    assert set(clean) <= set(ids(encoded))
    library = Tokenizer.from_file(llm_queries.WORD_BPE)
    final = {r.doc_id: r.text for r in decontaminated.collect()}
    for r in encoded.collect():
        found = library.encode(final[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(found)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()


def test_lengths_follow_the_text(spark):
    shared = "a line of boilerplate that is long enough to be counted"
    df = docs(spark, [prose(i, 30) + "\n" + shared for i in range(9)])
    out = corpus_pipeline.line_stage(spark, df, SF)
    assert all(r.n_chars == len(r.text) for r in out.collect()) and out.schema == df.schema


def test_pipeline_odd_and_empty(spark):
    out = stages(spark, odd(spark))
    assert all(df.columns == out[0].columns for df in out[1:-1])
    counts = Counter(ids(out[-1]))
    assert counts[8] <= 1
    assert [df.count() for df in stages(spark, empty(spark))] == [0] * 6
