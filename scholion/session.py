"""Session defaults, the shared folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A broadcast is only ever built from a relation proven to stay below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Texts whose words are put together at a time.
PART_BYTES = 8 * 1024 * 1024


def build_session(app: str = "scholion", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are tuned for; any of them may be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only where the session names none and runs on one machine a fresh local folder is used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if configured is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="scholion-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody used before, below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def release_scratch(spark: SparkSession) -> int:
    """Delete what this application has put below the shared folder; how many paths that were.

    To be called when no DataFrame that reads them is used any more.
    """
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def stored_result(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Store what build() returns in the shared folder and delete what it stored on the way."""
    path = scratch_path(spark, label)
    paths = _SCRATCH[spark.sparkContext.applicationId]
    before = len(paths)
    df = build()
    df.write.parquet(path)
    _delete(spark, paths[before:])
    del paths[before:]
    return spark.read.schema(df.schema).parquet(path)


def persist_shared(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, splits: int | None = None) -> DataFrame:
    """Give CPU-heavy work on a small input all cores.

    An input with fewer splits than cores (one small file) is repartitioned by its key; a large
    input has more splits than cores and is left as it is. splits is their number, if known.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions() if splits is None else splits
    return df if n >= cores else df.repartition(cores, *keys)


def dealt_by(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by a hash of a key, _part, in parts of about PART_BYTES of text, two to a task.

    What is exploded from a text can then be grouped by _part and other columns where it stands: the texts
    are shuffled once in place of all their words, and the number of parts follows their measured size.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return dealt.repartition(-(-parts // 2), "_part")


def _row_bytes(df: DataFrame):
    """A per-row upper estimate of the in-memory size."""
    total = F.lit(16)
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size = F.octet_length(col)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.NumericType
        ):
            size = F.size(col) * 8
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            size = F.octet_length(F.to_json(col))
        else:
            size = F.lit(8)
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 8
    return total


def is_bounded(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """True when the relation has at most max_rows rows and max_bytes bytes.

    Reads at most max_rows + 1 rows, so the check itself stays cheap on a huge relation.
    """
    seen = (
        df.limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("b"))
        .first()
    )
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES):
    """Hint a broadcast when the relation is proven small, else leave the join to Spark."""
    return F.broadcast(df) if is_bounded(df, max_rows, max_bytes) else df
