"""Metrics, moderation and the trained score."""

import random

import pytest
from pyspark.sql import functions as F

from padron.operators import metrics, model, moderation


def frame(spark, cells):
    values = [(p, y) for (p, y), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(values, "pred int, label int").repartition(4)


def test_binary(spark):
    df = frame(spark, {(1, 1): 3, (1, 0): 1, (0, 1): 2, (0, 0): 26})
    row = metrics.binary_metrics(metrics.confusion_matrix(df)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (3, 1, 2, 26)
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.9062, 0.75, 0.6, 0.6667)


def test_zero_denominators(spark):
    row = metrics.binary_metrics(metrics.confusion_matrix(frame(spark, {(0, 0): 2}))).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "pred int, label int")
    row = metrics.binary_metrics(metrics.confusion_matrix(empty)).first()
    assert (row.tp, row.accuracy, row.f1) == (0, 0.0, 0.0)


def test_report(spark):
    df = frame(spark, {(0, 0): 50, (1, 0): 10, (1, 1): 30, (0, 1): 10})
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_report(df).collect()}
    assert got == {
        "0": (0.8333, 0.8333, 0.8333, 60), "1": (0.75, 0.75, 0.75, 40),
        "accuracy": (0.8, 0.8, 0.8, 100), "macro avg": (0.7917, 0.7917, 0.7917, 100),
        "weighted avg": (0.8, 0.8, 0.8, 100),
    }


def test_moderated(spark):
    df = spark.createDataFrame(
        [("Vete a la MIERDA, imbécil", 0.1), ("el artículo económico", 0.7), ("hola", None)], "text string, score double"
    )
    rows = moderation.moderated(df, score="score").collect()
    assert [(r.blocked_by, r.hits) for r in rows] == [
        ("lexical", ["imbecil", "mierda"]), ("score", []), (None, []),
    ]
    rows = moderation.moderated(df, mode="substring").collect()
    assert [r.blocked_by for r in rows] == ["lexical", "lexical", None]
    assert rows[1].hits == ["culo", "cono"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    clean, bad = "datos deporte liga club gasto año".split(), "idiota inútil basura".split()
    values = []
    for i in range(300):
        toxic = i % 4 == 0
        body = rng.choices(clean, k=6) + (rng.choices(bad, k=2) if toxic else [])
        rng.shuffle(body)
        values.append((i, " ".join(body), int(toxic)))
    return spark.createDataFrame(values, "id int, text string, label int")


def test_model_learns(spark, texts):
    train, held_out = texts.filter("id < 240"), texts.filter("id >= 240")
    fitted = model.train(train)
    scored = model.score(fitted, held_out)
    assert scored.columns == [*held_out.columns, "score"] and scored.count() == 60
    assert model.evaluate(scored).first().f1 == 1.0
    probe = spark.createDataFrame([("¡IDIOTA!",), ("datos de liga",)], "text string")
    high, low = [r.score for r in model.score(fitted, probe).collect()]
    assert high > low
