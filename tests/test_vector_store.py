"""The vector table with several writers, odd namespaces, old versions and clean-up."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import vector_store as vs

SCHEMA = "id string, values array<float>, metadata string, namespace string, batch_seq long"


def rec(spark, ids, seq, ns="ns"):
    return spark.createDataFrame([(f"p{i}", [float(seq)], "{}", ns, seq) for i in ids], SCHEMA)


def state(spark, path, version=None):
    return {(r.namespace, r.id): r.batch_seq for r in vs.read_records(spark, path, version).collect()}


def test_interleaved_writers_lose_nothing(spark, scratch, monkeypatch):
    """A writer that read the old manifest, and commits after another has, merges again and keeps both batches."""
    path = f"{scratch}/index"
    vs.upsert_records(spark, path, rec(spark, range(40), 1), dim=1, buckets=8)
    plain, once = vs._commit, []

    def late(spark_, path_, version, state_):
        if not once:
            once.append(version)
            assert vs.upsert_records(spark, path, rec(spark, [3, 50], 3), dim=1) == version   # the other writer is first
        plain(spark_, path_, version, state_)
    monkeypatch.setattr(vs, "_commit", late)
    assert vs.upsert_records(spark, path, rec(spark, [3, 4, 60], 2), dim=1) == 3
    want = {("ns", f"p{i}"): 1 for i in range(40)} | {("ns", "p3"): 3, ("ns", "p50"): 3, ("ns", "p4"): 2, ("ns", "p60"): 2}
    assert state(spark, path) == want
    # the versions before are still whole
    assert state(spark, path, 1) == {("ns", f"p{i}"): 1 for i in range(40)} and ("ns", "p60") not in state(spark, path, 2)


def test_untouched_cells_are_not_merged_again(spark, scratch, monkeypatch):
    """Writers of different cells: the loser commits again without writing data again."""
    path = f"{scratch}/index"
    vs.upsert_records(spark, path, rec(spark, range(40), 1), buckets=8)
    cell = {r.id: r.b for r in rec(spark, range(200), 1).select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    a, b = [[i for i in range(200) if cell[f"p{i}"] == k][:3] for k in (0, 1)]
    plain, merges, once = vs._merge, [], []

    def merge(*args):
        merges.append(args[4])
        out = plain(*args)
        if not once:
            once.append(1)
            vs.upsert_records(spark, path, rec(spark, b, 2))
        return out
    monkeypatch.setattr(vs, "_merge", merge)
    assert vs.upsert_records(spark, path, rec(spark, a, 3)) == 3
    assert len(merges) == 2
    got = state(spark, path)
    assert all(got["ns", f"p{i}"] == 3 for i in a) and all(got["ns", f"p{i}"] == 2 for i in b)


def test_concurrent_writers(spark, scratch):
    """Four threads write batches that share keys; the newest batch of every key is there in the end."""
    path, errors = f"{scratch}/index", []

    def write(k):
        try:
            for n in range(3):
                vs.upsert_records(spark, path, rec(spark, [0, 1, 10 * k + n], 10 * n + k), buckets=4)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    want: dict = {}
    for k in range(4):
        for n in range(3):
            for i in (0, 1, 10 * k + n):
                want["ns", f"p{i}"] = max(10 * n + k, want.get(("ns", f"p{i}"), -1))
    assert state(spark, path) == want and vs.versions(spark, path) == list(range(1, 13))


def test_commit_never_overwrites(spark, scratch):
    path = f"{scratch}/index"
    vs._commit(spark, path, 1, {"buckets": 1, "cells": {}})
    with pytest.raises(vs.CommitConflict):
        vs._commit(spark, path, 1, {"buckets": 2, "cells": {}})
    assert vs._manifest(spark, path) == (1, {"buckets": 1, "cells": {}})
    assert [f for f in os.listdir(f"{path}/_manifest") if "tmp" in f and not f.endswith(".crc")] == []


@pytest.mark.parametrize("ns", ["a:b", "a/b=c", "", " %41\\ é日", "x" * 300, None])
def test_any_namespace(spark, scratch, ns):
    path = f"{scratch}/index"
    vs.upsert_records(spark, path, rec(spark, range(5), 1, ns), buckets=2)
    vs.upsert_records(spark, path, rec(spark, [2], 2, ns), buckets=2)
    assert state(spark, path) == {(ns, f"p{i}"): 2 if i == 2 else 1 for i in range(5)}


def test_failed_batch_changes_nothing_and_vacuum(spark, scratch):
    path = f"{scratch}/index"
    vs.upsert_records(spark, path, rec(spark, range(20), 1), dim=1, buckets=4)
    bad = rec(spark, [4], 9).withColumn("values", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    with pytest.raises(Exception, match="vector width"):
        vs.upsert_records(spark, path, bad, dim=1)
    for seq in (2, 3):
        vs.upsert_records(spark, path, rec(spark, range(20), seq), dim=1, buckets=99)   # the table keeps its buckets
    assert vs._manifest(spark, path)[1]["buckets"] == 4
    assert vs.vacuum(spark, path, older_than_hours=1) == [] and state(spark, path, 1)["ns", "p4"] == 1
    time.sleep(0.01)
    gone = vs.vacuum(spark, path, older_than_hours=0, keep=2)
    assert "00000001.json" in gone and vs.versions(spark, path) == [2, 3]
    assert state(spark, path)["ns", "p4"] == 3 and state(spark, path, 2)["ns", "p4"] == 2
    with pytest.raises(FileNotFoundError):
        vs.read_records(spark, f"{scratch}/nothing")
