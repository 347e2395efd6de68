"""Shared helpers: Arrow batch bounds, worker caches, text folding."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.shared import dropped, fresh, new_path, stored

__all__ = ["documents", "dropped", "fresh", "lower_ascii", "new_path", "partitions", "released", "row_struct", "small_arrow_batches", "stored", "worker_cache"]

#: Rows and bytes of one Arrow batch; texts can be long, so a batch holds few of them.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker.

    The settings are read when a plan runs, so they stay set; bounds that are
    smaller already are kept."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def released(*kept: str) -> None:
    """Give freed memory of this Python worker back to the system, at a task's end.

    What other tasks left in the worker's cache goes, but for the names in ``kept``."""
    import ctypes

    import pyarrow as pa

    cache = worker_cache()
    for name in [k for k in cache if not k.startswith("__") and k not in kept]:
        del cache[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def row_struct(docs: DataFrame, name: str = "row"):
    """All columns as one struct, so that helper columns beside it clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that outlives the task in its Python worker process.

    Functions are pickled by value, so their module globals live for a task."""
    name = "_ledgerspark_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(col):
    """A-Z to a-z only; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
