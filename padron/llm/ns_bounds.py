"""Exact k-means rounds that skip vectors by ns-bounds.

Components are integers (floor of the scaled value), so distances and means are exact and equal
on any number of tasks. A table holds each vector with its centroid, an upper bound on the
distance to it, and a lower bound to every other one, all as evaluated in one round. The driver
keeps every round's centroids. In a later round a bound is loosened by the norm of the *total*
displacement of its centroid since that round, not by the sum of the rounds' drifts, which is
never less. Where the upper bound stays below all lower ones, the vector keeps its centroid
without a distance; the others are rescanned, all distances, in integers.

The bounds are written anew when a round had to rescan more than ``RENEW`` of the vectors; else
the next round starts from the same table, loosened further. A round is one pass without a
shuffle of vectors: each task returns a sum and a count per centroid. Centroids (k rows) are all
that reaches the driver or is sent to workers.

Defined results: null vectors, those of another length and those with a null or non-finite
component are left out. Repeated rows count each; repeated ids are told apart by their vectors.
Null ids come last in the order of starting centroids. Fewer vectors than centroids: as many
centroids as vectors; none: no rows. Ties go to the smaller centroid. Components are limited to
2^28 in size after scaling (an error names the column), so that a squared distance fits a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.llm.words import slices
from padron.session import saved

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: The share of vectors rescanned in a round from which bounds are written anew.
RENEW = 0.2
#: Components beyond this size are refused.
LARGEST = 1 << 28
#: What rounding can add to or take from a bound.
SLACK = 1e-9

_STATE = "vec string, vector binary, cluster int, upper double, lower binary"


def kept(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec, x): the ids as text and integer components of the vectors that count."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))
    fits = F.forall(x, lambda v: F.abs(v) * F.lit(float(scale)) < F.lit(float(LARGEST)))
    checked = F.when(fits, whole).otherwise(
        F.raise_error(F.lit(f"a component of {vector} is beyond {LARGEST} after scaling"))
    )
    sound = F.coalesce((F.size(x) == dims) & finite, F.lit(False))
    return df.where(sound).select(F.col(key).cast("string").alias("vec"), checked.alias("x"))


def starting(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``salt:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec")), 256)
    first = rows.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in first.collect()], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row per vector."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def evaluated(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper bound to it, lower bounds to all (without limit for its own)."""
    apart = distances(x, centroids)
    nearest = apart.argmin(1)
    bounds = np.sqrt(apart.astype(np.float64))
    rows = np.arange(len(x))
    upper = bounds[rows, nearest] * (1 + SLACK)
    lower = bounds * (1 - SLACK)
    lower[rows, nearest] = np.inf
    return nearest, upper, lower


def displacement(then: np.ndarray, now: np.ndarray) -> np.ndarray:
    """How far each centroid is from where it was, a little more rather than less."""
    return np.sqrt(((now - then) ** 2).sum(1).astype(np.float64)) * (1 + SLACK) + SLACK


def reassigned(
    x: np.ndarray,
    cluster: np.ndarray,
    upper: np.ndarray,
    lower: np.ndarray,
    then: np.ndarray,
    now: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids now, and which vectors had to be rescanned for it."""
    moved = displacement(then, now)
    failed = upper + moved[cluster] >= (lower - moved).min(1)
    out = cluster.copy()
    if failed.any():
        out[failed] = distances(x[failed], now).argmin(1)
    return out, failed


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary cells of equal length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _vectors(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Vectors as integers of four bytes, evaluated against the first centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield _state_batch(batch.column("vec"), x, evaluated(x, centroids))

    return rows.mapInArrow(run, _STATE)


def _state_batch(vec: pa.Array, x: np.ndarray, found: tuple) -> pa.RecordBatch:
    nearest, upper, lower = found
    return pa.RecordBatch.from_arrays(
        [
            vec,
            pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()),
            pa.array(nearest.astype(np.int32)),
            pa.array(upper),
            pa.array([v.tobytes() for v in lower], pa.binary()),
        ],
        ["vec", "vector", "cluster", "upper", "lower"],
    )


def _read(batch: pa.RecordBatch, dims: int, k: int) -> tuple:
    return (
        _matrix(batch.column("vector"), np.int32, dims).astype(np.int64),
        batch.column("cluster").to_numpy().astype(np.int64),
        batch.column("upper").to_numpy(),
        _matrix(batch.column("lower"), np.float64, k),
    )


def _renewed(state: DataFrame, then: np.ndarray, now: np.ndarray) -> DataFrame:
    """The table with bounds as of now: rescanned vectors evaluated, the others loosened."""
    k, dims = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = displacement(then, now)
        for batch in slices(batches):
            x, cluster, upper, lower = _read(batch, dims, k)
            failed = upper + moved[cluster] >= (lower - moved).min(1)
            # What is not rescanned gets its own distance anew, which tightens most.
            near = np.sqrt(((x - now[cluster]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
            cluster, lower = cluster.copy(), lower - moved
            if failed.any():
                cluster[failed], near[failed], lower[failed] = evaluated(x[failed], now)
            yield _state_batch(batch.column("vec"), x, (cluster, near, lower))

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, then: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, list, int, int]:
    """Counts and component sums per centroid, vectors rescanned, vectors in all."""
    k, dims = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, rescanned = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for batch in slices(batches):
            x, cluster, upper, lower = _read(batch, dims, k)
            nearest, failed = reassigned(x, cluster, upper, lower, then, now)
            rescanned += int(failed.sum())
            for j in range(k):
                own = nearest == j
                count[j] += int(own.sum())
                total[j] += x[own].sum(0)
        which = np.repeat(np.arange(k + 1), [dims + 1] * k + [1])
        place = np.append(np.tile(np.arange(-1, dims), k), -1)
        value = np.append(np.column_stack([count, total]).ravel(), rescanned)
        some = value != 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(which[some]), pa.array(place[some]), pa.array(value[some])],
            ["which", "place", "value"],
        )

    # Sums of longs of many tasks, as numbers of 38 digits.
    parts = state.mapInArrow(run, "which long, place long, value long")
    added = parts.groupBy("which", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    found = {(r["which"], r["place"]): int(r["value"]) for r in added.collect()}
    counts = [found.get((j, -1), 0) for j in range(k)]
    totals = [[found.get((j, d), 0) for d in range(dims)] for j in range(k)]
    return counts, totals, found.get((k, -1), 0), sum(counts)


def means(counts: list, totals: list, before: np.ndarray) -> np.ndarray:
    """Floors of the means; a centroid without vectors stays."""
    rows = [
        [total // n for total in own] if n else old
        for n, own, old in zip(counts, totals, before.tolist(), strict=True)
    ]
    return np.array(rows, np.int64)


def _final(state: DataFrame, then: np.ndarray, now: np.ndarray) -> DataFrame:
    """(vec, cluster, distance) by the last centroids."""
    k, dims = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, cluster, upper, lower = _read(batch, dims, k)
            nearest, _ = reassigned(x, cluster, upper, lower, then, now)
            apart = ((x - now[nearest]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), pa.array(nearest.astype(np.int32)), pa.array(apart)],
                ["vec", "cluster", "distance"],
            )

    return state.mapInArrow(run, "vec string, cluster int, distance long")


def clustered(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    salt: str = "3",
) -> DataFrame:
    """Per vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    kind = df.schema[key].dataType
    rows = kept(df, key, vector, dims, scale)
    now = starting(rows, k, salt)
    shape = f"{kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long"
    if not len(now):
        return spark.createDataFrame([], f"`{key}` {shape}, centroid_sha256 string")
    history = [now]
    state, since = saved(_vectors(rows, now), "bounds-0"), 0
    for at in range(rounds):
        counts, totals, rescanned, n = _sums(state, history[since], history[at])
        if rescanned > RENEW * n and at:
            state = saved(_renewed(state, history[since], history[at]), f"bounds-{at}")
            since = at
        history.append(means(counts, totals, history[at]))
    last = history[-1]
    found = saved(_final(state, history[since], last), "assigned")
    inertia = {
        r["cluster"]: int(r["s"])
        for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    }
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]

    def of_cluster(values: list):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    return found.select(
        F.col("vec").cast(kind).alias(key),
        "cluster",
        "distance",
        of_cluster([inertia.get(j, 0) for j in range(len(last))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
