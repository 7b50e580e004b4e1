"""What the operators share: the given tables, one row per id, and a per-process cache."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_MODULE = "_scholion_worker_cache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_cache(key: str, version: str, make):
    """make()'s value, kept by the reused Python worker between tasks until the version changes.

    Task functions travel by value, so their own module's globals would start empty in each task.
    """
    module = sys.modules.setdefault(CACHE_MODULE, types.ModuleType(CACHE_MODULE))
    held = getattr(module, key, None)
    if held is None or held[0] != version:
        # Only the operator at work keeps one: what another has kept before is let go first.
        for other in [k for k in vars(module) if not k.startswith("__")]:
            delattr(module, other)
        held = (version, make())
        setattr(module, key, held)
    return held[1]


def forget() -> None:
    """Drop what operators before have kept in this worker; for tasks that keep nothing themselves."""
    module = sys.modules.get(CACHE_MODULE)
    for key in [k for k in vars(module) if not k.startswith("__")] if module else []:
        delattr(module, key)


def give_back() -> None:
    """Hand free memory back to the system, at the end of a task.

    Reused workers stay alive between tasks, and what they keep counts towards their executor's limit.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bucket(column: str, modulus: int, salt: str = ""):
    """crc32 of the id as text, modulo a number: the fold of a row."""
    text = F.col(f"`{column}`").cast("string")
    return F.crc32(F.concat(F.lit(salt), text) if salt else text) % modulus


def even(df: DataFrame, per_task: int = 2) -> DataFrame:
    """Deal a CPU-heavy small input over the cores; leave an input with many splits alone.

    The number of files, not of rows, is looked at, so nothing is computed for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_task) if len(df.inputFiles()) < 2 else df
