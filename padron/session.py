"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of an Arrow batch.
BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def build_session(app: str = "padron", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites are looked up per column call, which doubles planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder that the cluster names.

    The folders of a process are removed when it ends, or earlier by ``discard``.
    Every executor must see the folder, so a machine-local one is made up only
    for a local master without the setting (tests, laptops).
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "padron-scratch")
    path = f"{root.rstrip('/')}/padron/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this process has made by ``scratch_dir`` and reads no more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.remove(folder)


def discard(spark: SparkSession) -> None:
    """Remove every folder that this process has made by ``scratch_dir``."""
    while _MADE:
        removed(spark, _MADE[-1])


@atexit.register
def _discard_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        discard(spark)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run here pass long texts to Python a few megabytes at a time, not ten thousand rows.

    Rows of a batch are held by the executor and by its Python worker, twice over while they are written.
    """
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, BATCH)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: made once, safe when executors go."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
