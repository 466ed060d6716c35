"""Session helpers: local session for tests and benches, shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession, functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "panelcast") -> SparkSession:
    """A local session as used by tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="panelcast-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for a written table, below the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


BROADCAST_ROWS = 500_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 6_000_000


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends Python batches of about BATCH_BYTES at most, unless it was given a limit of its own.

    A batch stands in full in the JVM, outside its heap and more than once, and in the Python worker;
    10,000 rows of long texts are tens of MB in each.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def counted_side(small, purpose: str):
    """The small side of a join, stored and counted: marked for broadcast if its narrow rows are few enough.

    Left to the optimizer, the other side may have been shuffled before this one's size is known.
    """
    stored = write_and_read(small, purpose)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def write_and_read(df, purpose: str):
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
