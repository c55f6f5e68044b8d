"""Question answering, guards, and the stream."""

import pytest
from pyspark.sql import functions as F

from padron.lookups import BLOCKED_EN, BLOCKED_ES
from padron.operators import qa
from padron.streaming.answers import read_messages, write_answers
from padron.streaming.usage import load_per_minute, load_stream, usage_24h

# Labels, facts and answers of the golden test.
LABELS = {
    "ES": {
        "chat_error_data": "Sin datos.",
        "chat_max_spend": "Max spend: {region} {value}",
        "chat_min_spend": "Min spend: {region} {value}",
        "chat_max_lic": "Top licenses: {region} {value}",
        "chat_single_region": "{region}: gasto {gasto}, licencias {lic}",
        "chat_analyze": "Analizado.",
    }
}


@pytest.fixture
def facts(spark):
    rows = [
        ("Madrid, Comunidad de", 350.0, 80000),
        ("Comunitat Valenciana", 280.0, 65000),
        ("Andalucía", 330.0, 90000),
    ]
    return spark.createDataFrame(
        rows, "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long"
    )


def ask(spark, facts, prompt, **options):
    df = spark.createDataFrame([(prompt,)], "prompt string")
    return qa.answer(df, facts, **{"labels": LABELS, **options}).first().answer


def test_goldens(spark, facts):
    assert ask(spark, facts, "quien gasta mas") == "Max spend: Madrid, Comunidad de 350.0"
    assert ask(spark, facts, "¿Quién gasta MENOS?") == "Min spend: Comunitat Valenciana 280.0"
    assert ask(spark, facts, "más federados") == "Top licenses: Andalucía 90000"
    assert ask(spark, facts, "federados en valencia") == (
        "Comunitat Valenciana: gasto 280.0, licencias 65000"
    )
    assert ask(spark, facts, "cuentame algo", fallback_region="Andalucía") == (
        "Analizado. Andalucía: gasto 330.0, licencias 90000"
    )
    assert ask(spark, facts.limit(0), "quien gasta mas") == "Sin datos."


def test_intent_order_and_alias_fall_through(spark, facts):
    # Spend wins over licences; an alias without facts gives way to the next one.
    assert ask(spark, facts, "mas federados y quien gasta mas").startswith("Max spend")
    assert ask(spark, facts, "galicia o madrid").startswith("Madrid")
    # Alias order, not text order, decides.
    assert ask(spark, facts, "valencia y andalucía").startswith("Andalucía")


def test_accented_alias(spark):
    one = spark.createDataFrame(
        [("Cataluña", 1.5, 2)], "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long"
    )
    assert ask(spark, one, "¿Y Cataluña?") == "Cataluña: gasto 1.5, licencias 2"


def test_ties_nulls_and_copies(spark):
    rows = [("B", 5.0, 1), ("A", 5.0, 1), ("C", None, None), ("D", 9.0, None)]
    df = spark.createDataFrame(rows, "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long")
    digest = qa.facts_digest(df.unionByName(df)).first()
    assert digest.n == 8
    assert digest.min_spend.region == "A" and digest.max_spend.region == "D"
    assert digest.max_licences.region == "A"


def test_languages(spark, facts):
    df = spark.createDataFrame([("quien gasta mas", "EN"), ("quien gasta mas", "XX")], "prompt string, lang string")
    got = {r.lang: r.answer for r in qa.answer(df, facts, F.col("lang")).collect()}
    assert got["EN"] == "🔍 The region with the highest spending is Madrid, Comunidad de with 350.0 €."
    assert got["XX"] == "🔍 La CCAA que más gasta es Madrid, Comunidad de con 350.0 €."
    assert ask(spark, facts, "most licenses", labels=None, lang="EN") == "🏆 Andalucía leads in licenses with 90,000."


def guarded(spark, facts, rows, **options):
    df = spark.createDataFrame(rows, "prompt string, lang string, score double")
    out = qa.guarded_answer(df, facts, F.col("lang"), score="score", **options)
    return [(r.blocked, r.answer) for r in out.collect()]


def test_guard(spark, facts):
    rows = [("eres IDIOTA", "ES", 0.0), ("madrid", "FR", 0.7), ("madrid", "ES", 0.69), ("artículo de madrid", "ES", None)]
    got = guarded(spark, facts, rows)
    assert got[0] == (True, BLOCKED_ES + " ")
    assert got[1] == (True, BLOCKED_EN + " ")
    assert got[2] == (False, "📍 En Madrid, Comunidad de: Gasto de 350.0 € y 80000 licencias. ")
    assert got[3][0] is False
    assert guarded(spark, facts, rows[3:], mode="substring")[0][0] is True


def test_stream_equals_batch(spark, facts, tmp_path):
    rows = [(f"{p} {i}", "ES") for i, p in enumerate(["quien gasta mas", "eres idiota", "valencia", "hola"] * 5)]
    df = spark.createDataFrame(rows, "prompt string, lang string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_messages(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    job = write_answers(stream, facts, str(tmp_path / "out"), str(tmp_path / "cp"), F.col("lang"))
    job.awaitTermination()
    got = sorted(spark.read.parquet(str(tmp_path / "out")).select("prompt", "answer").collect())
    assert got == sorted(qa.guarded_answer(df, facts, F.col("lang")).select("prompt", "answer").collect())


def events(spark):
    rows = [
        ("2024-01-03 12:00:30", 1, "view"), ("2024-01-03 12:00:10", 2, "error"), ("2024-01-03 11:45:00", 1, "click"),
        ("2024-01-02 12:00:31", 3, "error"), ("2024-01-02 12:00:30", 4, "error"), ("2024-01-01 13:00:00", 4, "error"),
        ("2023-12-25 00:00:00", 5, "error"),
    ]
    df = spark.createDataFrame(rows, "ts string, user_id long, event_type string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_usage(spark):
    row = usage_24h(events(spark)).first()
    assert row.asDict() == {
        "active_users_24h": 3, "total_queries": 7, "failed_24h": 2, "failed_prev_24h": 2,
        "failed_change_pct": "0.0",
    }
    load = load_per_minute(events(spark)).orderBy("minute").collect()
    assert [(str(r.minute), r.load, r.failed) for r in load] == [
        ("2024-01-03 11:45:00", 1, 0), ("2024-01-03 12:00:00", 2, 1),
    ]


def test_load_stream(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    job = (
        load_stream(stream).writeStream.outputMode("complete").format("memory")
        .queryName("load_stream_test").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    got = {str(r.minute): (r.load, r.active_users) for r in spark.table("load_stream_test").collect()}
    assert got["2024-01-03 12:00:00"] == (2, 2) and len(got) == 5


def test_region_answers_in_either_spelling(spark):
    for name in ("Castilla-La Mancha", "Castilla - La Mancha"):
        facts = spark.createDataFrame(
            [(name, 1.0, 5), ("Galicia", 2.0, 6)],
            "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long",
        )
        asked = spark.createDataFrame([("datos de la mancha",), ("y castilla-la mancha?",)], "prompt string")
        answers = [r.answer for r in qa.answer(asked, facts, labels=LABELS).collect()]
        assert answers == [f"{name}: gasto 1.0, licencias 5"] * 2


def test_long_lists_of_aliases_and_terms(spark):
    aliases = [(f"zona {i} ", f"Z{i}, Región de") for i in range(1000)]
    facts = spark.createDataFrame(
        [("Z777 (Región de)", 1.0, 5), ("Galicia", 2.0, 6)],
        "CCAA string, Gasto_Promedio_Hogar_Eur double, Licencias_Federadas long",
    )
    asked = spark.createDataFrame([("datos de zona 777 ya",), ("zona 778 ya",)], "prompt string")
    first, second = [
        r.answer for r in qa.answer(asked, facts, labels=LABELS, aliases=aliases, fallback_region="Galicia").collect()
    ]
    assert first.startswith("Z777 (Región de)") and second.startswith("Analizado. Galicia")
    from padron.functions.text import contains_any, matched_terms

    terms = [f"malo{i}" for i in range(900)]
    df = spark.createDataFrame([("es malo7 y malo899",), ("malo9x",), ("bien",)], "t string")
    got = df.select(
        contains_any(F.col("t"), terms, "word").alias("w"), matched_terms(F.col("t"), terms, "word").alias("h"),
        matched_terms(F.col("t"), terms).alias("s"),
    ).collect()
    assert [r.w for r in got] == [True, False, False]
    assert [r.h for r in got] == [["malo7", "malo899"], [], []]
    assert got[0].s == ["malo7", "malo8", "malo89", "malo899"] and got[1].s == ["malo9"]
