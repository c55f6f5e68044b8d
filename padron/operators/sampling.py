"""Samples, order, splits and shards that repeat on any cluster."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padron.functions.hashing import below_share, hash_number, seeded_hash
from padron.lookups import SAMPLE_CAP, SEED
from padron.session import saved

# Hash prefix length of the shuffle buckets: 16**4 of them, whatever the data.
BUCKET_DIGITS = 4
# Spark limits ranks before a shuffle up to this cap
# (spark.sql.optimizer.windowGroupLimitThreshold, unless it is raised).
RANKED_CAP = 1000
# Most groups above a larger cap to send to all rows; more of them have a billion rows at least.
MAX_SENT_GROUPS = 1_000_000


def capped_sample(
    df: DataFrame, by: list[str], keys: list[str], cap: int = SAMPLE_CAP, seed: int = SEED
) -> DataFrame:
    """At most ``cap`` rows per group: those with the smallest hash of ``keys``.

    Up to ``RANKED_CAP`` a rank filter is planned as a per-task limit before the
    shuffle, so a group of any size sends at most ``cap`` rows per task. A larger
    cap goes by counts (``_capped_by_counts``).
    """
    hashed = df.withColumn("_order", seeded_hash(seed, *[F.col(k) for k in keys]))
    if cap > RANKED_CAP:
        return _capped_by_counts(hashed, by, keys, cap).drop("_order")
    window = W.partitionBy(*by).orderBy("_order", *keys)
    return (
        hashed.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= cap)
        .drop("_order", "_rank")
    )


def _capped_by_counts(hashed: DataFrame, by: list[str], keys: list[str], cap: int) -> DataFrame:
    """The ``cap`` smallest hashes of each group without ranking a group.

    Groups above the cap are counted per hash bucket. Running counts name the bucket in which
    the cap falls: rows of lower buckets stay, those of that one bucket are ranked (a
    65,536th of the group), the others go. Other groups stay as they are. Groups above the cap
    are sent to the rows, so that only the ranked rows move and no task gets a group.
    """
    match = reduce(operator.and_, [F.col(b).eqNullSafe(F.col(f"_by_{i}")) for i, b in enumerate(by)])
    named = [F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)]
    counts = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    large = saved(counts.where(F.col("_rows") > cap).select(*named), "large-groups")
    few = large.count() <= MAX_SENT_GROUPS
    rows = hashed.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    upto = W.partitionBy(*by).orderBy("_bucket")
    per_bucket = (
        rows.join(F.broadcast(large) if few else large, match, "left_semi")
        .groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    border = (
        per_bucket.withColumn("_upto", F.sum("_rows").over(upto))
        .where((F.col("_upto") >= cap) & (F.col("_upto") - F.col("_rows") < cap))
        .select(
            *named,
            F.col("_bucket").alias("_border"),
            (cap - F.col("_upto") + F.col("_rows")).alias("_left"),
        )
    )
    border = saved(border, "borders")  # a row per large group
    placed = rows.join(F.broadcast(border) if few else border, match, "left").drop(*[f"_by_{i}" for i in range(len(by))])
    whole = placed.where(F.col("_border").isNull() | (F.col("_bucket") < F.col("_border")))
    ranked = placed.where(F.col("_bucket") == F.col("_border")).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_order", *keys))
    )
    at_border = ranked.where(F.col("_rank") <= F.col("_left"))
    return whole.select(*hashed.columns).unionByName(at_border.select(*hashed.columns))


def shuffled(df: DataFrame, keys: list[str], seed: int = SEED) -> DataFrame:
    """All rows with their ``position`` (0-based) in a seeded global order.

    ``keys`` must identify a row. Rows are ranked inside 65,536 even hash
    buckets and moved by the number of rows in earlier buckets: no task sees
    all rows, and the offsets are at most 65,536 numbers.
    """
    hashed = df.withColumn("_order", seeded_hash(seed, *[F.col(k) for k in keys])).withColumn(
        "_bucket", F.substring("_order", 1, BUCKET_DIGITS)
    )
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_order", *keys))
    return (
        hashed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("position", F.col("_offset") + F.col("_inside") - 1)
        .drop("_order", "_bucket", "_inside", "_offset")
    )


def with_split(
    df: DataFrame, keys: list[str], test_share: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add ``split``. A row keeps its side when data is added; sizes are approximate."""
    hashed = seeded_hash(seed, *[F.col(k) for k in keys])
    side = F.when(below_share(hashed, test_share), F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("split", side)


def with_exact_split(
    df: DataFrame, keys: list[str], test_share: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add ``split``; the test side has exactly ``ceil(test_share * rows)`` rows.

    The test side is the smallest hashes up to the k-th. Its hash is found by counts per hash
    bucket and then inside the one bucket that holds it, both as scalar subqueries, so no task
    sorts more than a 65,536th of the rows. ``keys`` must identify a row: copies of one key
    share a side, which may then have more rows.
    """
    if not 0.0 < test_share < 1.0:
        raise ValueError("share must lie between 0 and 1")
    hashed = df.withColumn("_order", seeded_hash(seed, *[F.col(k) for k in keys]))
    bucket = F.substring("_order", 1, BUCKET_DIGITS)
    counts = hashed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 rows from here on. Shares are decimals, so that 0.1 of 30 rows is 3.
    share = F.lit(str(test_share)).cast("decimal(20,18)")
    upto, whole = W.orderBy("bucket"), W.partitionBy()
    running = counts.withColumns(
        {
            "upto": F.sum("n").over(upto),
            "k": F.ceil(F.sum("n").over(whole).cast("decimal(18,0)") * share).cast("long"),
        }
    )
    border = running.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select(
        F.struct("bucket", (F.col("k") - F.col("upto") + F.col("n")).alias("place")).alias("b")
    )
    inside = hashed.where(bucket == border.scalar().getField("bucket")).select("_order")
    ranked = inside.withColumn("place", F.row_number().over(W.orderBy("_order")))
    last = ranked.where(F.col("place") == border.scalar().getField("place")).select("_order").scalar()
    side = F.when(F.col("_order") <= last, F.lit("test")).otherwise(F.lit("train"))
    return hashed.withColumn("split", side).drop("_order")


def with_shard(df: DataFrame, keys: list[str], workers: int, seed: int = SEED) -> DataFrame:
    """Add ``shard``, 0 to ``workers - 1``."""
    hashed = seeded_hash(seed, *[F.col(k) for k in keys])
    return df.withColumn("shard", F.pmod(hash_number(hashed), F.lit(workers)).cast("int"))
