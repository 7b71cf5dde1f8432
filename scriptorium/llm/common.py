"""Helpers shared by the operators: shared scratch tables and connected components.

Every operator works on internal column names (leading underscore) taken from
the caller's columns by ``select``, so extra columns of any name cannot clash.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Words of a text: runs of anything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; own one only where the setting is absent (tests)."""
    from scriptorium.session import checkpoint_dir
    return checkpoint_dir(spark).rstrip("/")


#: Scratch folders are removed by a later run when they are older.
MAX_AGE_DAYS = 7


class Scratch:
    """Intermediate tables in the shared folder: written once, read by every later job.

    A lost executor re-reads finished tables instead of recomputing their lineage.  Results are read from these tables
    when the caller runs them, so they stay until ``close`` (or the end of ``scratch_closed``); folders that nobody
    closed go when a later run finds them older than ``MAX_AGE_DAYS``."""

    open_now: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        top = f"{shared_dir(spark)}/llm"
        self.base = f"{top}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[str, str] = {}
        for held in Scratch.open_now:
            held.append(self)
        self._sweep(top)

    def _sweep(self, top: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(top)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            for f in fs.listStatus(p):
                if f.getModificationTime() < (time.time() - MAX_AGE_DAYS * 86400) * 1000:
                    fs.delete(f.getPath(), True)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back.  A name given again takes the place of the table before, which goes."""
        self.n += 1
        old = self.paths.get(name)
        path = self.paths[name] = f"{self.base}/{self.n:03d}-{name}"
        schema = df.schema
        df.write.parquet(path)
        if old:
            self._delete(old)
        return self.spark.read.schema(schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def close(self) -> None:
        """Remove everything: after the last read."""
        self.paths.clear()
        self._delete(self.base)


@contextmanager
def scratch_closed() -> Iterator[None]:
    """Removes at its end the scratch tables opened inside: for results written to a table of the caller's."""
    held: list[Scratch] = []
    Scratch.open_now.append(held)
    try:
        yield
    finally:
        Scratch.open_now.remove(held)
        for s in held:
            s.close()


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require_new(df: DataFrame, *names: str) -> None:
    """Refuse names of new columns that are in use."""
    if taken := [n for n in names if n.lower() in {c.lower() for c in df.columns}]:
        raise ValueError(f"columns {taken} exist: give other names")


def map_rows(df: DataFrame, task, schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots included: the task sees and gives c0, c1, ... in order."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    inner = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])
    return plain.mapInArrow(task, inner).toDF(*schema.names)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: one row (node, root) per node
    with an edge, root = the smallest node reachable.

    Alternating large-star / small-star: every round links each node's larger neighbours
    to its smallest one, then all its smaller ones, until the edge set is a star forest.
    Only whether that is so reaches the driver.  A hub's neighbours are never
    gathered: the minimum per node is a partially aggregated min, joined back.
    """
    cur = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), "cc")
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        nxt = small.select("u", F.col("m").alias("v")).union(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = scratch.cut(nxt, "cc")
        # stars: every node has one parent, and no parent has one
        ends = nxt.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            nxt.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        cur = nxt
    roots = nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
