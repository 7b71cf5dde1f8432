"""The keyed vector table on disk (K2): versioned, bucketed by id, safe for several writers.

Records live in cells (namespace, bucket = hash of id).  An upsert merges and writes only the cells its batch
touches, into a data folder of its own with a unique name, and then commits a manifest that names the folder of
every cell.  A commit creates the manifest of the next version and fails if another writer has created it
(optimistic concurrency): the loser reads the newer manifest, merges again those of its cells that the other
writer replaced, and tries the next version.  No file of a committed version is ever written twice.  Readers take
the newest manifest, so a batch that fails, or a writer that dies, changes nothing.  ``vacuum`` removes folders
that no kept version names, once they are older than a writer may run.

Manifests hold one entry per cell (namespaces x buckets).  A namespace is named by its md5 in folders, so any
string will do.
"""

from __future__ import annotations

import json
import random
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.corpus import upsert

BUCKETS = 64


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions that are still kept, in order."""
    names = [st.getPath().getName() for st in _children(spark, f"{path.rstrip('/')}/_manifest")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, {"buckets", "cells": cell -> data folder}) of a version, the newest by default; (0, {}) for a new table."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return 0, {}
    return version, json.loads(spark.read.text(f"{path}/_manifest/{version:08d}.json", wholetext=True).head()[0])


def _commit(spark: SparkSession, path: str, version: int, state: dict) -> None:
    """Create the manifest of ``version``, or raise ``CommitConflict`` if there is one.

    The manifest is written aside and renamed without the right to overwrite, which the file system does as one step."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{version:08d}.json")
    fs, part = _fs(spark, f"{path}/_manifest/.{version:08d}-{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(part, target, no_options)
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(target):
            raise CommitConflict(f"version {version} of {path} was committed by another writer") from e
        raise


def _read(spark: SparkSession, path: str, cells: dict[str, str], schema=None) -> DataFrame | None:
    files = [f"{path}/data/{folder}/{cell}" for cell, folder in sorted(cells.items())]
    if not files:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*files)


def read_records(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All records of a committed version, the newest by default."""
    path = path.rstrip("/")
    found, state = _manifest(spark, path, version)
    if not found:
        raise FileNotFoundError(f"no committed version in {path}")
    return _read(spark, path, state["cells"])


def _cell(buckets: int) -> tuple[Column, Column]:
    return F.md5(F.coalesce("namespace", F.lit(""))).alias("ns"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")


def _merge(spark: SparkSession, path: str, state: dict, incoming: DataFrame, cells: list[str], dim: int | None) -> str:
    """Write ``cells`` merged with ``incoming`` to a new data folder; its name."""
    buckets = state["buckets"]
    ns, bucket = _cell(buckets)
    name = F.concat(F.lit("ns="), ns, F.lit("/bucket="), bucket.cast("string"))
    mine = incoming.where(name.isin(cells)) if len(cells) < state["touched"] else incoming
    existing = _read(spark, path, {c: state["cells"][c] for c in cells if c in state["cells"]}, incoming.schema)
    merged = upsert(existing if existing is not None else incoming.limit(0), mine, dim=dim)
    folder = f"w-{uuid.uuid4().hex}"
    merged.withColumns({"ns": ns, "bucket": bucket}).write.partitionBy("ns", "bucket").parquet(f"{path}/data/{folder}")
    return folder


def upsert_records(spark: SparkSession, path: str, incoming: DataFrame, dim: int | None = None, buckets: int = BUCKETS,
                   attempts: int = 20) -> int:
    """Merge ``incoming`` (id, values, metadata, namespace, batch_seq) into the table; returns the new version.

    The row with the highest ``batch_seq`` wins per key, so the order in which writers commit does not matter.  Only
    the touched cells are read and written.  ``buckets`` is that of the table once there is one.  ``incoming`` is read
    more than once: it must give the same rows each time.  After ``attempts`` lost commits ``CommitConflict`` is raised."""
    path = path.rstrip("/")
    version, state = _manifest(spark, path)
    state = state or {"buckets": buckets, "cells": {}}
    ns, bucket = _cell(state["buckets"])
    touched = [f"ns={r.ns}/bucket={r.bucket}" for r in incoming.select(ns, bucket).distinct().collect()]   # at most one a cell
    written: dict[str, str] = {}          # cell -> folder this writer has merged it into
    seen: dict[str, str | None] = {}      # cell -> folder it was merged from
    for attempt in range(attempts):
        stale = sorted(c for c in touched if c not in written or seen[c] != state["cells"].get(c))
        if stale:
            folder = _merge(spark, path, state | {"touched": len(touched)}, incoming, stale, dim)
            written |= dict.fromkeys(stale, folder)
            seen |= {c: state["cells"].get(c) for c in stale}
        try:
            _commit(spark, path, version + 1, {"buckets": state["buckets"], "cells": state["cells"] | written})
            return version + 1
        except CommitConflict:
            time.sleep(random.uniform(0, min(2.0, 0.05 * 2 ** attempt)))
            before = state["buckets"]
            version, state = _manifest(spark, path)
            if state["buckets"] != before:   # the first writers of a new table disagreed: start over with its buckets
                return upsert_records(spark, path, incoming, dim, buckets, attempts)
    raise CommitConflict(f"{attempts} commits to {path} were lost to other writers")


def vacuum(spark: SparkSession, path: str, older_than_hours: float, keep: int = 1) -> list[str]:
    """Remove all but the ``keep`` newest manifests and the data folders that none of these names; returns their names.

    Only what is older than ``older_than_hours`` goes: it must be longer than any writer or reader runs, as a writer's
    folder is named by no manifest until its commit."""
    path = path.rstrip("/")
    latest = time.time() - older_than_hours * 3600
    old = lambda st: st.getModificationTime() <= latest * 1000
    all_versions = versions(spark, path)
    kept = set(all_versions[-max(1, keep):])
    gone = []
    for st in _children(spark, f"{path}/_manifest"):
        name = st.getPath().getName()
        if old(st) and (name.endswith(".tmp") or name.endswith(".json") and int(name.removesuffix(".json")) not in kept):
            st.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).delete(st.getPath(), False)
            gone.append(name)
    named = {f for v in versions(spark, path) for f in _manifest(spark, path, v)[1]["cells"].values()}
    for st in _children(spark, f"{path}/data"):
        if st.getPath().getName() not in named and old(st):
            st.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).delete(st.getPath(), True)
            gone.append(st.getPath().getName())
    return gone
