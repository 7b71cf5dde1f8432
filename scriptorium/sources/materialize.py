"""Saved tables, read-through caches and per-shard checkpoints.

Paths are on the cluster's shared file system (the same one that holds
``spark.checkpoint.dir``); existence is checked through Hadoop's FileSystem
so it works for HDFS/object stores as well as local folders.  A directory
counts as complete only when its ``_SUCCESS`` marker exists.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    return _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def save(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """``save_to_disk`` (K1)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


_CODE_VERSION: list[str] = []


def code_version() -> str:
    """Fingerprint of this package's source: a cached table built by other code
    is never reused (the checkpoint folder outlives sessions)."""
    if not _CODE_VERSION:
        import pathlib
        root = pathlib.Path(__file__).resolve().parents[1]
        h = hashlib.md5()
        for f in sorted(root.rglob("*.py")):
            h.update(str(f.relative_to(root)).encode())
            h.update(f.read_bytes())
        _CODE_VERSION.append(h.hexdigest()[:12])
    return _CODE_VERSION[0]


def cache_key(**params) -> str:
    """Directory-name key over *all* parameters (the reference omits some) and
    the code version."""
    params = dict(params, _code=code_version())
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def source_fingerprint(spark: SparkSession, *paths: str) -> str:
    """Sizes and modification times of the source files: a changed input
    gives a new cache key, so a derived table is never stale."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            parts.append(f"{path}:missing")
            continue
        it = fs.listFiles(p, True)
        while it.hasNext():
            st = it.next()
            parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(parts)).encode()).hexdigest()[:16]


def frame_fingerprint(*frames: DataFrame) -> str:
    """Fingerprint of the files that the frames read."""
    return source_fingerprint(frames[0].sparkSession, *sorted({f for d in frames for f in d.inputFiles()}))


def derived_table(spark: SparkSession, name: str, sources: list[str], builder: Callable[[], DataFrame],
                  partition_by: list[str] | None = None, **params) -> DataFrame:
    """A table derived from ``sources``, written once into the cluster's
    checkpoint folder and read back by every later job (lineage cut)."""
    from scriptorium.session import checkpoint_dir
    key = cache_key(fp=source_fingerprint(spark, *sources), **params)
    return materialize(spark, f"{checkpoint_dir(spark)}/derived/{name}/{key}", builder, partition_by)


_READS: dict[tuple[str, str], DataFrame] = {}


def materialize(spark: SparkSession, path: str, builder: Callable[[], DataFrame],
                partition_by: list[str] | None = None) -> DataFrame:
    """Read-through cache (K7): read ``path`` if complete, else build, write, read.

    A complete directory never changes (its key covers the inputs and all
    parameters), so the session reuses the DataFrame it read - no repeated
    listing or schema inference."""
    key = (spark.sparkContext.applicationId, path)
    if key in _READS:
        return _READS[key]
    if not is_complete(spark, path):
        save(builder(), path, partition_by=partition_by)
    df = _READS[key] = spark.read.parquet(path)
    return df


def _done_shards(spark: SparkSession, out: str) -> set[int]:
    """Shards with a committed file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/shard=*/part-*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return {int(st.getPath().getParent().getName().split("=")[1]) for st in found}


def run_sharded(rows: DataFrame, job: Callable[[DataFrame], DataFrame], base: str, rows_per_shard: int,
                key: list[str] | None = None) -> DataFrame:
    """Per-shard checkpointing of a long map in one job.

    The input is written once, ``partitionBy('shard')`` with shard = ``pmod(xxhash64(key), shards)`` and as many shards
    as its rows need.  One job then maps all shards that have no output yet, side by side: each is dealt whole to one
    task, which stages its file and moves it to ``out/shard=i`` when it is whole (the committer's second algorithm, which
    moves a task's output at the end of the task).  A run that dies has the shards of its finished tasks; the next
    one maps the others.  ``job`` maps rows to rows and keeps their ``shard``.  ``base`` must name the input (by
    fingerprint), the model and all parameters.  The result is the union of all shard outputs."""
    spark = rows.sparkSession
    base = base.rstrip("/")
    inp, out = f"{base}/in", f"{base}/out"
    if not is_complete(spark, inp):
        cols = [F.col(c) for c in (key or rows.columns)]
        shards = max(1, -(-rows.count() // rows_per_shard))
        number = F.pmod(F.xxhash64(*cols), F.lit(shards)).cast("int")
        save(rows.withColumn("shard", number).repartition(shards, "shard"), inp, partition_by=["shard"])
    part = spark.read.schema(rows.withColumn("shard", F.lit(0)).schema).parquet(inp)
    mapped = job(part)
    if "shard" not in mapped.columns:
        raise ValueError("the job must keep the column shard")
    if not is_complete(spark, out):
        done = _done_shards(spark, out)
        every = [r["shard"] for r in part.select("shard").distinct().collect()]       # folder names
        missing = sorted(set(every) - done)
        todo = part.where(F.col("shard").isin(missing)).repartition(max(1, len(missing)), "shard")
        (job(todo).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("shard").parquet(out))
    return spark.read.schema(mapped.schema).parquet(out).drop("shard")
