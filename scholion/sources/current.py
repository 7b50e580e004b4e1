"""Tables kept up to date batch by batch: a read scans one version of each bucket, never the history.

Rows are dealt over buckets by the hash of their key. A batch rewrites only the buckets that hold one of
its keys, each as a directory of its own, and then writes a pointer: the version of every bucket. Readers
look at the newest whole pointer first, so they see all of a batch or nothing of it, and a batch that is
repeated after a failure either finds its pointer and changes nothing or writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEPT_POINTERS = 3
META = ("batch_id", "processing_attempts", "created_at")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """Batches whose pointer was written as a whole, in order."""
    fs, folder = _fs(spark, f"{path}/pointer")
    if not fs.exists(folder):
        return []
    done = fs.globStatus(_fs(spark, f"{path}/pointer/batch_id=*/_SUCCESS")[1]) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)


def _versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    """bucket -> version of a pointer: at most as many rows as there are buckets."""
    rows = spark.read.parquet(f"{path}/pointer/batch_id={batch_id}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _read(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/data/bucket={b}/version={v}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge_batch(rows: DataFrame, path: str, key: str, batch_id: int, buckets: int = BUCKETS) -> bool:
    """Take the rows of a batch in: each replaces the row of its key. False if the batch was taken in before.

    Batches are numbered upwards. The stored rows carry batch_id (of the last change), processing_attempts (in how many
    batches the key came) and created_at (the first of them); columns of rows with these names are replaced. Rows
    without a key are left out; of several rows with one key the greatest by the hash of its columns stays. An empty
    batch only moves the pointer.
    """
    spark = rows.sparkSession
    known = _pointers(spark, path)
    if known and batch_id <= known[-1]:
        return False
    versions = _versions(spark, path, known[-1]) if known else {}
    fields = [c for c in rows.columns if c not in META]
    new = rows.where(F.col(key).isNotNull()).select(
        *fields, F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.lit(1).alias("processing_attempts"), F.lit(batch_id).cast("bigint").alias("created_at"),
    )
    touched = sorted(r[0] for r in new.select(bucket_of(key, buckets)).distinct().collect())
    if touched:
        held = _read(spark, path, {b: versions[b] for b in touched if b in versions})
        both = new if held is None else new.unionByName(held.select(*new.columns))
        rest = [c for c in fields if c != key]
        newest = F.struct("batch_id", F.xxhash64(F.to_json(F.struct(F.lit(0), *rest))))
        by_batch = both.groupBy(key, "batch_id").agg(
            F.max_by(F.struct(*rest, "processing_attempts", "created_at"), newest).alias("r")
        )
        merged = by_batch.groupBy(key).agg(
            F.max_by("r", "batch_id").alias("r"), F.max("batch_id").alias("batch_id"),
            F.sum("r.processing_attempts").cast("int").alias("processing_attempts"),
            F.min("r.created_at").alias("created_at"),
        )
        (
            merged.select(key, *[F.col("r").getField(c).alias(c) for c in rest], *META)
            .withColumn("bucket", bucket_of(key, buckets))
            .withColumn("version", F.lit(batch_id))
            .repartition("bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "version")
            .parquet(f"{path}/data")
        )
    versions |= dict.fromkeys(touched, batch_id)
    table = spark.range(1).select(F.explode(F.map_from_entries(F.array(*[
        F.struct(F.lit(b), F.lit(v).cast("bigint")) for b, v in sorted(versions.items())
    ]))).alias("bucket", "version")) if versions else spark.createDataFrame([], "bucket int, version bigint")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/batch_id={batch_id}")
    _forget(spark, path, known + [batch_id])
    return True


def _forget(spark: SparkSession, path: str, known: list[int]) -> None:
    """Delete old pointers and the versions that none of the kept ones names."""
    old, kept = known[:-KEPT_POINTERS], known[-KEPT_POINTERS:]
    if not old:
        return
    named = {(b, v) for k in kept for b, v in _versions(spark, path, k).items()}
    for k in old:
        for b, v in _versions(spark, path, k).items():
            if (b, v) not in named:
                fs, target = _fs(spark, f"{path}/data/bucket={b}/version={v}")
                fs.delete(target, True)
        fs, target = _fs(spark, f"{path}/pointer/batch_id={k}")
        fs.delete(target, True)


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows as of the last whole batch, or None before the first row."""
    known = _pointers(spark, path)
    return _read(spark, path, _versions(spark, path, known[-1])) if known else None
