"""Caps above what ranks are limited to, exact splits, long lists of terms, checks while writing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from padron.functions.text import fold_text
from padron.operators import contracts, sampling, term_index
from padron.sources.files import write_partitioned

# caps


def grouped(spark, sizes):
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "g string, id long")


@pytest.mark.parametrize("cap", [1, 7, 40, 1000])
def test_caps_by_counts_equal_ranks(spark, monkeypatch, cap):
    df = grouped(spark, {"a": 2500, "b": 40, "c": 7, None: 900, "": 1})
    ranked = sampling.capped_sample(df, ["g"], ["id"], cap).collect()
    monkeypatch.setattr(sampling, "RANKED_CAP", 0)
    counted = sampling.capped_sample(df, ["g"], ["id"], cap).collect()
    assert sorted(counted, key=str) == sorted(ranked, key=str)


def test_a_large_cap_of_a_hot_group_ranks_no_group(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise("cold").alias("g"), "id")
    kept = sampling.capped_sample(df, ["g"], ["id"], cap=50_000)
    assert {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()} == {"hot": 50_000, "cold": 50_000}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line]
    assert ranks and all("_bucket" in line for line in ranks)  # a rank is inside one bucket of a group


def test_caps_with_repeated_keys_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED_CAP", 0)
    df = spark.createDataFrame([("a", 1)] * 30 + [("b", 2)], "g string, id long")
    assert sampling.capped_sample(df, ["g"], ["id"], 5).count() == 6
    assert sampling.capped_sample(df.limit(0), ["g"], ["id"], 5).count() == 0


def test_a_group_above_a_large_cap_is_not_moved(spark):
    """Only rows of the border bucket change tasks: no join deals rows out by their group."""
    df = spark.range(30_000).select(F.when(F.col("id") % 30 < 29, F.lit("hot")).alias("g"), "id")
    kept = sampling.capped_sample(df, ["g"], ["id"], cap=2000)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(g#" in plan
    assert all("_bucket" in part for part in re.findall(r"hashpartitioning\((.*?)\)", plan))
    assert {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()} == {"hot": 2000, None: 1000}


# splits


@pytest.mark.parametrize("n, share, test", [(1000, 0.1, 100), (1001, 0.1, 101), (30, 0.1, 3), (7, 0.2, 2), (1, 0.9, 1), (0, 0.5, 0)])
def test_exact_sizes(spark, n, share, test):
    rows = sampling.with_exact_split(spark.range(n), ["id"], share).collect()
    assert sum(r["split"] == "test" for r in rows) == test and len(rows) == n


def test_exact_split_takes_the_smallest_hashes(spark):
    found = sampling.with_exact_split(spark.range(5000).repartition(9), ["id"], 0.3)
    again = sampling.with_exact_split(spark.range(5000).repartition(2), ["id"], 0.3)
    assert sorted(found.collect()) == sorted(again.collect())
    near = sampling.with_split(spark.range(5000), ["id"], 0.25).where("split = 'test'").select("id")
    assert near.join(found.where("split = 'train'"), "id").count() == 0
    with pytest.raises(ValueError):
        sampling.with_exact_split(spark.range(5), ["id"], 1.0)


# long lists

WORDS = "sol mar río ñandú C++ luz a b de la casa-grande 24/7 año economía".split()


def plain_hits(texts, terms):
    found = set()
    for i, text in texts:
        for t in terms:
            pattern = rf"(?<![^\W_]){re.escape(t)}(?![^\W_])"
            if text is not None and re.search(pattern, text):
                found.add((i, t))
    return found


def test_long_list_equals_search_of_each_term(spark):
    rng = random.Random(9)
    made = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [(i, fold_text(made(rng.randrange(1, 30)))) for i in range(200)]
    texts += [(500, None), (501, ""), (None, "sol mar"), (502, "sol, mar... LA casa_grande"), (502, "rio")]
    terms = sorted({fold_text(made(rng.randrange(1, 4))) for _ in range(300)} | {"nowhere", "sol nowhere", "so", "sol,"})
    listed = term_index.term_list(spark.createDataFrame([(t,) for t in [*terms, None, " ", "++"]], "t string"), "t")
    table = spark.createDataFrame(texts, "id long, body string")
    got = {(r["id"], r["term"]) for r in term_index.listed_hits(table, "id", "body", listed).collect()}
    assert got == plain_hits(texts, terms) and len(got) > 300


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("zona "), F.col("id").cast("string"), F.lit(" norte")).alias("t"))
    texts = spark.createDataFrame(
        [(i, f"datos de zona {i * 7} norte y zona {i} sur") for i in range(200)], "id long, body string"
    )
    listed = term_index.term_list(terms, "t")
    found = term_index.listed_hits(texts, "id", "body", listed).collect()
    assert {(r["id"], r["term"]) for r in found} == {(i, f"zona {i * 7} norte") for i in range(200)}


def test_terms_are_filed_under_their_rarest_word(spark):
    terms = spark.createDataFrame([("de casa",), ("de de",), ("de nada",)], "term string")
    words = spark.createDataFrame([(1, "de"), (2, "de"), (2, "casa")], "id long, word string")
    got = {(r["word"], r["term"]) for r in term_index.filed(terms, words).collect()}
    assert got == {("casa", "de casa"), ("de", "de de")}


def test_terms_of_common_words_name_no_more_than_the_places_of_the_texts(spark, monkeypatch):
    """A list that grows with the texts, all of words that every text holds."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    bodies = [" ".join(rng.sample(words, 30)) for _ in range(300)]
    terms = sorted({" ".join(b.split()[a : a + n]) for b in bodies for a, n in ((3, 3), (7, 2), (9, 6), (20, 1))})
    texts = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    listed = term_index.term_list(spark.createDataFrame([(t,) for t in terms], "t string"), "t")
    expected = {(i, t) for i, b in enumerate(bodies) for t in terms if f" {t} " in f" {b} "}
    for sent in (1 << 21, 40):  # hashes, and remainders of hashes that several share
        monkeypatch.setattr(term_index, "MAX_SENT_RUNS", sent)
        named = term_index.named_terms(texts, listed)
        assert named.count() < 1.2 * len(expected) < 0.2 * len(bodies) * len(terms)
        assert {(r["id"], r["term"]) for r in term_index.listed_hits(texts, "id", "body", listed).collect()} == expected


def test_first_alias_by_place(spark):
    aliases = spark.createDataFrame([("la mancha", "CLM", 2), ("mancha", "M", 1), ("leon", "CL", 0)], "term string, official string, place int")
    texts = spark.createDataFrame([(1, "datos de la mancha"), (2, "leon y mancha"), (3, "manchas")], "id long, body string")
    found = {r["id"]: (r["term"], r["official"]) for r in term_index.first_listed(texts, "id", "body", aliases).collect()}
    assert found == {1: ("mancha", "M"), 2: ("leon", "CL")}


# checks while writing


def test_contract_is_gathered_while_writing(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit(2023).alias("anio"), (F.col("id") % 10 == 0).alias("held"))
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = rows.mapInArrow(passed, rows.schema)
    report = contracts.written_checked(
        once, lambda df: df.write.parquet(str(tmp_path / "out")), ["id", "anio"], 1000, {"anio": 2023},
        {"held_rows": F.col("held")},
    )
    assert report.first().asDict() == {
        "n_rows": 1000, "has_columns": True, "rows_ok": True, "anio_constant": True, "anio_ok": True, "held_rows": 100,
    }
    assert seen.value == 1000 and spark.read.parquet(str(tmp_path / "out")).count() == 1000
    plain = contracts.contract_checks(rows, ["id", "anio"], 1000, {"anio": 2023}).first().asDict()
    assert plain == {k: v for k, v in report.first().asDict().items() if k != "held_rows"}


def test_contract_of_partitioned_and_empty_writes(spark, tmp_path):
    rows = spark.range(50).select("id", (F.col("id") % 2).alias("part"))
    report = contracts.written_checked(
        rows, lambda df: write_partitioned(df, str(tmp_path / "a"), "part"), ["id", "missing"], 51, {"part": 0}
    ).first()
    assert (report.n_rows, report.has_columns, report.rows_ok, report.part_constant) == (50, False, False, False)
    none = contracts.written_checked(
        rows.limit(0), lambda df: df.write.parquet(str(tmp_path / "b")), ["id"], 0, {"part": 0}
    ).first()
    assert (none.n_rows, none.rows_ok, none.part_ok) == (0, True, False)


def test_models_score_after_an_observed_write(spark, tmp_path):
    """What observes a write stays in the session; a trained model must not carry the session."""
    from padron.operators import model

    contracts.written_checked(spark.range(5), lambda df: df.write.parquet(str(tmp_path / "o")), ["id"], 5, {})
    texts = spark.createDataFrame([("sol mar", 0), ("idiota mar", 1)] * 10, "text string, label int")
    assert model.score(model.train(texts), texts).count() == 20
