"""Samples, shuffles, splits, generators, conversations: brute force and invariance."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from padron.functions.hashing import hex_threshold
from padron.operators import conversations, generators, labels, sampling
from padron.sources import files, lake
from padron.sources.files import split_manifest


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def rows(spark, n=3000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key")
    )


@pytest.mark.parametrize("n", [1, 4, 16])
def test_same_result_on_any_partitioning(spark, partitions, n):
    partitions(n)
    df = rows(spark).repartition(n)
    local = [(r.id, r.key) for r in df.collect()]
    groups = {}
    for i, key in local:
        groups.setdefault(key, []).append((md5(f"42:{i}"), i))
    expected = {i for g in groups.values() for _, i in sorted(g)[:40]}
    got = [r.id for r in sampling.capped_sample(df, ["key"], ["id"]).collect()]
    assert len(got) == len(expected) and set(got) == expected

    order = sorted(range(3000), key=lambda i: md5(f"42:{i}"))
    shuffled = {r.id: r.position for r in sampling.shuffled(df, ["id"]).collect()}
    assert shuffled == {i: p for p, i in enumerate(order)}

    limit = hex_threshold(0.1)
    split = {r.id: r.split for r in sampling.with_split(df, ["id"]).collect()}
    assert split == {i: "test" if md5(f"42:{i}")[:8] < limit else "train" for i in range(3000)}
    assert 200 < sum(v == "test" for v in split.values()) < 400

    shards = {r.id: r.shard for r in sampling.with_shard(df, ["id"], 4).collect()}
    assert shards == {i: int(md5(f"42:{i}")[:8], 16) % 4 for i in range(3000)}
    assert min(Counter(shards.values()).values()) > 650


def test_sample_limits_before_the_shuffle(spark):
    plan = sampling.capped_sample(rows(spark), ["key"], ["id"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("WindowGroupLimit") == 2
    assert "SinglePartition" not in physical


def test_sample_draws_before_it_renders(spark):
    """No sentence or number is made below the sample's shuffle."""
    facts = spark.createDataFrame([("f", "A", "1.234")], "file_path string, Indicador string, Total string")
    plan = generators.qa_pairs(facts, "company")._jdf.queryExecution().executedPlan().toString()
    assert "format_number" in plan and "format_number" not in plan[plan.index("WindowGroupLimit") :]


def test_manifest(spark):
    df = sampling.with_split(rows(spark), ["id"], 0.2)
    row = split_manifest(df, "split", {"epochs": 5}).first()
    assert row.examples == 3000 == row.train_examples + row.test_examples
    assert row.manifest == (
        f'{{"train_examples":{row.train_examples},"test_examples":{row.test_examples},"examples":3000,"epochs":5}}'
    )


FACTS = "file_path string, category string, `Federación` string, Sexo string, `Comunidad autónoma` string, periodo string, Total string"


def pairs(spark, family, schema, values, **options):
    df = spark.createDataFrame(values, schema)
    return sorted((r.question, r.answer) for r in generators.qa_pairs(df, family, **options).collect())


def test_templates(spark):
    assert pairs(spark, "federated", "file_path string, Total string, Sexo string", [("f", "385", "Hombres")]) == [
        ("¿Cuántos deportistas federados (hombres) en N/D?", "El número de deportistas en el periodo N/D fue de 385.")
    ]
    assert pairs(spark, "spend", "file_path string, Indicador string, `Tipo de bienes y servicios` string, `Comunidad autónoma` string, periodo string, Total string",
                 [("f", "Gasto Medio", "Ropa", "Galicia", "2020", "1.234,5")]) == [
        ("¿Cuál fue el gasto medio en Galicia para 'Ropa' en 2020?", "El gasto medio en Galicia para 'Ropa' en 2020 fue de 1.234,50.")
    ]
    assert pairs(spark, "employment", "file_path string, `Sexo, grupo de edad y nivel de estudios` string, Periodo string, Total string",
                 [("f", "Mujeres", "2025", "270,2")]) == [
        ("¿Cuál fue el valor de 'empleo deportivo' para Mujeres en 2025?",
         "El indicador 'empleo deportivo' para el perfil Mujeres en 2025 registró un valor de 270,20.")
    ]
    assert pairs(spark, "company", "file_path string, Indicador string, periodo string, Total string", [("f", "N", "2024", "x")]) == [
        ("¿Qué valor tuvo 'N' en 2024?", "El indicador 'N' en 2024 fue de x.")
    ]
    assert pairs(spark, "habits", "file_path string, Total string", [("f", "9,9")]) == [
        ("¿Cuál fue el porcentaje de 'hábito deportivo' en España (encuesta N/D)?",
         "Según la encuesta de hábitos deportivos de N/D, el indicador 'hábito deportivo' en España fue del 9,90%.")
    ]
    assert pairs(spark, "affiliation", "file_path string, Periodo string, Total string", [("f", "2026. Mes 03", "1.737")]) == [
        ("¿Cuál fue el indicador de 'afiliación' para actividad '' en 2026. Mes 03?", "El indicador 'afiliación' en 2026. Mes 03 fue de 1.737.")
    ]
    assert pairs(spark, "eu", "file_path string, `País` string, `Sexo y nivel de estudios` string, periodo string, Total string",
                 [("f", " Francia ", "Total", "2019", "45,0")]) == [
        ("¿Cuál fue el valor de 'indicador EU' en Francia, Total (2019)?",
         "El indicador armonizado 'indicador EU' en Francia para Total en 2019 fue de 45.")
    ]


def test_missing_totals_bring_no_pair_and_small_files_stay_whole(spark):
    values = [("a", "..", "x"), ("a", None, "x"), ("a", "1", "x")] + [("b", str(i), "x") for i in range(60)]
    df = spark.createDataFrame(values, "file_path string, Total string, Indicador string")
    counts = Counter(r.file_path for r in generators.qa_pairs(df, "company").collect())
    assert counts == {"a": 1, "b": 40}


def test_training_set_is_whole_and_stable(spark, partitions):
    general = spark.createDataFrame([(f"g{i}", "q", "a") for i in range(35)], "origin string, question string, answer string")
    made = spark.createDataFrame([(f"f{i}", f"q{i}", "a") for i in range(65)], "origin string, question string, answer string")
    results = []
    for n in (1, 7):
        partitions(n)
        out = generators.training_set(generators.union_pairs(general, made).repartition(n))
        results.append([(r.position, r.messages[1].content) for r in out.orderBy("position").collect()])
    assert results[0] == results[1]
    assert [p for p, _ in results[0]] == list(range(100))
    assert Counter(q for _, q in results[0])["q"] == 35


def test_long_session_is_one_sequence(spark):
    df = spark.range(600).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.concat(F.lit("t"), "id").alias("text"),
    )
    whole = conversations.assemble(df.repartition(8)).collect()
    assert [[m.turn for m in r.messages] for r in whole] == [list(range(600))]
    rows = conversations.ordered_messages(df.repartition(8)).collect()
    assert [(r.conv_id, r.position, r.text) for r in rows] == [(7, i, f"t{i}") for i in range(600)]
    blocks = conversations.assemble(df.repartition(8), block=256).orderBy("block").collect()
    assert [len(b.messages) for b in blocks] == [256, 256, 88]
    assert conversations.exchanges(df).count() == 300


def test_cap_is_per_source(spark, tmp_path):
    """Equal names in two folders are two sources; part files of one folder are one."""
    header = "Indicador;Actividad económica;periodo;Total\n"
    for folder in ("2022/A", "2022/B"):
        path = tmp_path / "raw" / "Empresa_Deporte" / folder / "x.csv"
        path.parent.mkdir(parents=True)
        path.write_text(header + "".join(f"{folder} {i};Y;2024;{i}\n" for i in range(60)), encoding="utf-8")
    facts = lake.good_files(lake.load_lake(spark, str(tmp_path / "raw")))
    assert generators.lake_pairs(facts).count() == 80
    written = spark.range(90).select(
        F.concat(F.lit("I"), "id").alias("Indicador"), F.lit("Y").alias("Actividad económica"),
        F.lit("2024").alias("periodo"), F.col("id").cast("string").alias("Total"),
    )
    files.write_semicolon(written.repartition(3), str(tmp_path / "w" / "raw" / "Empresa_Deporte" / "y.csv"))
    facts = lake.load_lake(spark, str(tmp_path / "w" / "raw"))
    assert facts.select("file_path").distinct().count() == 3
    assert generators.lake_pairs(facts).count() == 40


def test_cap_over_the_limit_of_the_plan(spark):
    df = spark.range(5000).select(F.lit(1).alias("key"), "id")
    assert sampling.capped_sample(df, ["key"], ["id"], cap=1500).count() == 1500


def test_labelled_union_and_balance(spark):
    clean = spark.createDataFrame([(" a ",), ("b",)], "text string")
    toxic = spark.createDataFrame([("c",)], "text string")
    edge = spark.createDataFrame([("d", 0)], "text string, label int")
    df = labels.labelled_union((clean, 0), (toxic, 1), (edge, None))
    assert sorted((r.text, r.label) for r in df.collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 0)]
    balance = {r.label: (r.n, r.total, r.pct) for r in labels.class_balance(df).collect()}
    assert balance == {0: (3, 4, "75.0"), 1: (1, 4, "25.0")}
