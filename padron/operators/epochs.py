"""A trained score over many passes: one solver whose state goes on, evaluated in between.

Terms are counted once and numbered; those of few documents are left out, so weights are as wide
as the kept terms. A pass is one job over an even table of term numbers: every task adds up its
part of the gradient, and the driver holds the weights (``MAX_TERMS`` at most), the last few steps
and nothing else. So 80 passes with five evaluations cost 80 passes, not the sum of five fits.

The model is that of ``model.regression``: logistic regression on the presence of terms with a
penalty on absolute weights in units of each term's spread. The solver is a quasi-Newton method
for such penalties: steps follow the curvature that the last ones have met and stop at zero.
"""

from __future__ import annotations

import warnings
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.operators.model import MIN_DOCS, REG, balanced, evaluate, tokens_of
from padron.session import saved

#: Most terms with a weight; beyond it the most frequent ones have one.
MAX_TERMS = 1 << 18
#: Numbers of a gradient that travel in one row.
CHUNK = 1 << 14
#: Up to so many chunks of all tasks the driver adds up gradients itself; beyond it, tasks do.
FEW_TASKS = 16
#: Steps whose curvature is remembered; trials of a step's size, a job each.
HISTORY, TRIALS = 10, 10


def term_index(tokens: DataFrame, min_docs: int = MIN_DOCS, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, id, df) of the terms of ``min_docs`` rows or more, numbered by falling df.

    ``tokens``: an array column of that name. ``max_terms`` bounds what the driver numbers.
    """
    counted = (
        tokens.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= min_docs)
    )
    kept = counted.orderBy(F.col("df").desc(), "term").limit(max_terms).collect()
    rows = [(r["term"], i, r["df"]) for i, r in enumerate(kept)]
    return tokens.sparkSession.createDataFrame(rows, "term string, id int, df long")


def numbered(tokens: DataFrame, index: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``tokens`` as the numbers of their indexed terms: ``ids`` and the columns ``keep``.

    ``row`` must identify a row.
    """
    held = (
        tokens.select("row", F.explode(F.array_distinct("tokens")).alias("term"))
        .join(index.select("term", "id"), "term")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    found = tokens.select("row", *keep).join(held, "row", "left")
    return found.select(F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), *keep)


@dataclass
class TermScorer:
    """Weights of terms and an intercept: all that scoring needs."""

    terms: list[str]
    weights: list[float]
    intercept: float

    def margin(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with the column ``_margin``."""
        if not self.terms:
            return tokens.withColumn("_margin", F.lit(float(self.intercept)))
        presence = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="tokens", outputCol="_present", minTF=1.0
        ).setBinary(True)
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        both = F.zip_with(vector_to_array("_present"), weights, lambda x, w: x * w)
        total = F.aggregate(both, F.lit(float(self.intercept)), lambda a, x: a + x)
        return presence.transform(tokens).withColumn("_margin", total).drop("_present")

    def score(self, df: DataFrame, text: str = "text", terms: Iterable[str] = ()) -> DataFrame:
        """Add ``score``, the probability of the toxic class; give the blocklist of training."""
        found = self.margin(tokens_of(df, text, terms))
        return found.select(*df.columns, _probability(F.col("_margin")).alias("score"))


def _probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


class Solver:
    """Weights after any number of passes over ``rows`` (ids, label, weight)."""

    def __init__(self, rows: DataFrame, df: np.ndarray, reg: float) -> None:
        """``df``: documents that hold each term."""
        self._rows, self._width = rows, len(df)
        self._tasks = rows.rdd.getNumPartitions()
        total = rows.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
        self._total = total["w"] or 1.0
        share = df / max(total["n"], 1)
        # Terms in units of their spread; one that all rows hold tells nothing and stays out.
        spread = np.sqrt(share * (1 - share))
        self._unit = np.append(np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0), 1.0)
        self._penalty = np.append(np.full(self._width, reg), 0.0)
        self._at = np.zeros(self._width + 1)  # the last one is the intercept
        self._loss, self._slope = self._evaluated(self._at)
        self._history: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=HISTORY)
        self._stuck, self.passes = False, 0

    @property
    def weights(self) -> np.ndarray:
        return self._at * self._unit

    def _evaluated(self, at: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its slope in units of spread, by one job over the rows."""
        sent = self._rows.sparkSession.sparkContext.broadcast(at * self._unit)
        width = self._width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, weights = np.zeros(width + 2), sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("ids")
                size = np.diff(ids.offsets.to_numpy())
                term = ids.flatten().to_numpy()
                owner = np.repeat(np.arange(len(size)), size)
                label, weight = (batch.column(c).to_numpy().astype(float) for c in ("label", "weight"))
                margin = np.bincount(owner, weights[term], len(size)) + weights[-1]
                value = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label)
                out[:width] += np.bincount(term, value[owner], width)
                out[width] += value.sum()
                out[-1] += (weight * (np.logaddexp(0, margin) - label * margin)).sum()
            parts = [out[i : i + CHUNK].tobytes() for i in range(0, len(out), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())],
                ["chunk", "part"],
            )

        def add(key: tuple, table: pa.Table) -> pa.Table:
            rows = [np.frombuffer(p, float) for p in table.column("part").to_pylist()]
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": [np.sum(rows, 0).tobytes()]})

        parts = self._rows.mapInArrow(run, "chunk int, part binary")
        if self._tasks * -(-(width + 2) // CHUNK) > FEW_TASKS:  # else the driver adds up a few rows
            parts = parts.groupBy("chunk").applyInArrow(add, "chunk int, part binary")
        out = np.zeros(width + 2)
        for row in parts.collect():
            own = np.frombuffer(row["part"], float)
            out[row["chunk"] * CHUNK :][: len(own)] += own
        sent.destroy()
        return out[-1] / self._total, out[:-1] * self._unit / self._total

    def _direction(self, steepest: np.ndarray) -> np.ndarray:
        """Against the steepest slope, bent by the curvature that the last steps have met."""
        out, seen = -steepest, []
        for step, turn in reversed(self._history):
            rho = 1 / np.dot(step, turn)
            alpha = rho * np.dot(step, out)
            out = out - alpha * turn
            seen.append((rho, alpha, step, turn))
        if self._history:
            step, turn = self._history[-1]
            out = out * (np.dot(step, turn) / np.dot(turn, turn))
        for rho, alpha, step, turn in reversed(seen):
            out = out + (alpha - rho * np.dot(turn, out)) * step
        return np.where(out * steepest < 0, out, 0.0)

    def _step(self) -> None:
        at, slope, penalty = self._at, self._slope, self._penalty
        edge = np.where(slope < -penalty, slope + penalty, np.where(slope > penalty, slope - penalty, 0.0))
        steepest = np.where(at != 0, slope + penalty * np.sign(at), edge)
        if not np.any(steepest):
            self._stuck = True
            return
        direction = self._direction(steepest)
        side = np.where(at != 0, np.sign(at), -np.sign(steepest))
        before = self._loss + np.dot(penalty, np.abs(at))
        size = 1.0 if self._history else min(1.0, 1 / np.linalg.norm(steepest))
        for _ in range(TRIALS):
            new = at + size * direction
            new[new * side < 0] = 0.0  # a weight does not change its sign in one step
            loss, new_slope = self._evaluated(new)
            if loss + np.dot(penalty, np.abs(new)) <= before + 1e-4 * np.dot(steepest, new - at):
                break
            size /= 2
        else:
            self._stuck = True
            return
        step, turn = new - at, new_slope - slope
        if np.dot(step, turn) > 1e-12:
            self._history.append((step, turn))
        self._at, self._loss, self._slope = new, loss, new_slope

    def run(self, passes: int) -> None:
        """Go on until ``passes`` in all; where no step lowers the loss, weights stay."""
        while self.passes < passes:
            if not self._stuck:
                self._step()
            self.passes += 1

    def scorer(self, names: list[str]) -> TermScorer:
        weights = self.weights
        used = np.flatnonzero(weights[:-1])
        return TermScorer([names[i] for i in used], weights[used].tolist(), float(weights[-1]))


def select_best(
    training: DataFrame,
    held_out: DataFrame,
    passes: Iterable[int] = (5, 10, 20, 40, 80),
    text: str = "text",
    label: str = "label",
    reg: float = REG,
    terms: Iterable[str] = (),
) -> tuple[TermScorer, DataFrame]:
    """The model with the best held-out F1 after some of the passes, and the results of all.

    The earliest of equal ones wins. A winner that finds nothing is reported as a warning. Rows
    of no label are left out; an empty training table gives a model without terms.
    """
    spark = training.sparkSession
    known = F.col("label").isNotNull()
    tokens = tokens_of(training, text, terms).select("tokens", F.col(label).alias("label")).where(known)
    tokens = saved(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    index = term_index(tokens)
    counted = index.orderBy("id").collect()
    names, df = [r["term"] for r in counted], np.array([r["df"] for r in counted], float)
    rows = numbered(balanced(tokens, "label"), index, "label", "weight")
    solver = Solver(saved(rows.hint("rebalance"), "numbers"), df, reg)
    other = tokens_of(held_out, text, terms).select("tokens", F.col(label).alias("label")).where(known)
    other = saved(other.hint("rebalance"), "held-out")
    results, best, best_f1, best_at = [], solver.scorer(names), -1.0, None
    for at in sorted(set(passes)):
        solver.run(at)
        model = solver.scorer(names)
        scored = model.margin(other).select("label", _probability(F.col("_margin")).alias("score"))
        row = evaluate(scored, "label").first()
        results.append((at, *row))
        if row["f1"] > best_f1:
            best, best_f1, best_at = model, row["f1"], at
    if best_f1 <= 0:
        warnings.warn("no model finds a positive held-out row", stacklevel=2)
    schema = (
        "passes int, tp long, fp long, fn long, tn long,"
        " accuracy double, precision double, recall double, f1 double"
    )
    report = spark.createDataFrame(results, schema)
    return best, report.withColumn("best", F.col("passes") == F.lit(best_at))
