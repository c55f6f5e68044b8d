"""Training over passes with one solver: results of a plain one, costs of one fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from padron.operators import epochs, model
from padron.operators.labels import only_labelled

SF = "/root/testdata/sf0.001"


def made(spark, n=300, noise=0.0):
    rng = random.Random(5)
    clean, bad = "datos deporte liga club gasto año".split(), "idiota inútil basura".split()
    values = []
    for i in range(n):
        toxic = i % 4 == 0
        body = rng.choices(clean, k=6) + (rng.choices(bad, k=2) if toxic != (rng.random() < noise) else [])
        rng.shuffle(body)
        values.append((i, " ".join(body), int(toxic)))
    return spark.createDataFrame(values, "id int, text string, label int")


def plain_matrix(rows):
    """Presence of terms of MIN_DOCS rows or more, balanced weights."""
    sets = [set(r["tokens"]) for r in rows]
    df = {}
    for own in sets:
        for t in own:
            df[t] = df.get(t, 0) + 1
    names = sorted((t for t in df if df[t] >= model.MIN_DOCS), key=lambda t: (-df[t], t))
    x = np.array([[t in own for t in names] for own in sets], float)
    y = np.array([r["label"] for r in rows], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    return names, x, y, weight


def objective(x, y, weight, w, b, reg):
    margin = x @ w + b
    loss = np.logaddexp(0, margin) - y * margin
    share = x.mean(0)
    return (weight * loss).sum() / weight.sum() + reg * (np.sqrt(share * (1 - share)) * np.abs(w)).sum()


def plain_fit(x, y, weight, reg, steps=4000):
    """Proximal gradient with one small step size, to convergence."""
    share = x.mean(0)
    penalty = reg * np.sqrt(share * (1 - share))
    w, b = np.zeros(x.shape[1]), 0.0
    size = 4 / (1 + x.sum(1).max())
    for _ in range(steps):
        r = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / weight.sum()
        w = w - size * (x.T @ r)
        w = np.sign(w) * np.maximum(np.abs(w) - size * penalty, 0)
        b -= size * r.sum()
    return w, b


def solver_of(spark, tokens, reg):
    tokens = tokens.withColumn("row", F.monotonically_increasing_id())
    index = epochs.term_index(tokens)
    counted = index.orderBy("id").collect()
    rows = epochs.numbered(model.balanced(tokens, "label"), index, "label", "weight")
    return epochs.Solver(rows.cache(), np.array([r["df"] for r in counted], float), reg), [r["term"] for r in counted]


@pytest.mark.parametrize("few", [64, 0])
def test_solver_reaches_the_plain_optimum(spark, monkeypatch, few):
    """On the small table's labelled texts; gradients added up by the driver and by tasks."""
    monkeypatch.setattr(epochs, "FEW_TASKS", few)
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    docs = docs.where("length(text) < 3000").select("text", F.col("toxic").alias("label"))
    tokens = model.tokens_of(docs, "text").select("tokens", "label").repartition(3).cache()
    names, x, y, weight = plain_matrix(tokens.collect())
    solver, found = solver_of(spark, tokens, 0.01)
    assert found == names
    solver.run(60 if few else 10)
    own = objective(x, y, weight, solver.weights[:-1], solver.weights[-1], 0.01)
    start = objective(x, y, weight, np.zeros(len(names)), 0.0, 0.01)
    assert own < start
    if few:
        best = objective(x, y, weight, *plain_fit(x, y, weight, 0.01), 0.01)
        assert own - best < 0.02 * (start - best)


def test_passes_go_on_where_they_stopped(spark):
    tokens = model.tokens_of(made(spark), "text").select("tokens", "label").cache()
    one, _ = solver_of(spark, tokens, 0.002)
    two, _ = solver_of(spark, tokens, 0.002)
    one.run(12)
    for at in (1, 5, 12):
        two.run(at)
    assert np.allclose(one.weights, two.weights, atol=1e-12) and two.passes == 12


def test_passes_cost_one_fit(spark, monkeypatch):
    calls = []
    evaluated = epochs.Solver._evaluated
    monkeypatch.setattr(epochs.Solver, "_evaluated", lambda self, at: calls.append(1) or evaluated(self, at))
    texts = made(spark, noise=0.1)
    epochs.select_best(texts.filter("id < 240"), texts.filter("id >= 240"), passes=(2, 4, 8))
    assert 1 + 8 <= len(calls) <= 1 + 8 + 4  # the start, each pass once, and some trials of a size


def test_select_best_returns_the_best_pass(spark):
    texts = made(spark, noise=0.05)
    held_out = texts.filter("id >= 240")
    best, report = epochs.select_best(texts.filter("id < 240"), held_out, passes=(20, 1, 5))
    rows = report.collect()
    assert [r.passes for r in rows] == [1, 5, 20]
    assert max(r.f1 for r in rows) == [r.f1 for r in rows if r.best][0] > 0.8
    scored = best.score(held_out)
    assert scored.columns == [*held_out.columns, "score"] and scored.count() == held_out.count()
    assert model.evaluate(scored).first().f1 == max(r.f1 for r in rows)


def test_odd_training_tables(spark):
    texts = made(spark, 40)
    odd = texts.unionByName(
        spark.createDataFrame([(900, None, 1), (901, "", 0), (902, "x " * 5000, 0), (903, "idiota", None)], texts.schema)
    ).withColumns({c: F.lit(c) for c in ("tokens", "row", "ids", "weight", "term", "df")})
    best, report = epochs.select_best(odd, odd, passes=(3,))
    assert report.count() == 1 and best.terms
    assert best.score(odd).where("score IS NULL").count() == 0
    best, report = epochs.select_best(texts.limit(0), texts, passes=(2,))
    assert best.terms == [] and {r.score for r in best.score(texts).collect()} == {0.5}


def test_labels_that_are_too_many_to_send_move_no_text(spark, monkeypatch):
    texts = made(spark, 20)
    wanted = texts.where("id < 5").select("id")
    assert only_labelled(texts, wanted, "id").count() == 5
    monkeypatch.setattr("padron.operators.labels.MAX_SENT_IDS", 3)
    assert only_labelled(texts, wanted, "id").count() == 20


def test_the_driver_gets_one_gradient_a_pass(spark, monkeypatch):
    """However many tasks there are, wide gradients are added up by tasks."""
    monkeypatch.setattr(epochs, "CHUNK", 8)
    rows = spark.createDataFrame([([i % 200, 200], i % 2, 1.0) for i in range(600)], "ids array<int>, label int, weight double")
    got = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: got.append(collect(self)) or got[-1])
    solver = epochs.Solver(rows.repartition(12).cache(), np.full(201, 3.0), 0.01)
    solver.run(1)
    sums = [r for r in got if r and "chunk" in r[0].asDict()]
    assert sums and all(len(r) == -(-203 // 8) for r in sums)
