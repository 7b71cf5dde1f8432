"""Gold CSV logs: append sink (K3 K4) and the header-checked union source.

Spark binds CSV columns by position inside one read, so files whose
headers differ in order would be mis-bound silently.  The source finds the
header lines of all files in one job, groups files by identical header, reads each group with its own schema and
``unionByName``s the groups.  Files lacking a required column are skipped
whole, empty files are skipped, and empty fields read as ``''`` like a
Python ``csv`` reader.
"""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOLD_QUERY_COLUMNS = ["paperId", "title", "query", "excerpt", "reason"]
GOLD_SELECTION_COLUMNS = ["paperId", "title", "excerpt", "reason", "action", "ref_action", "ref_status", "seq"]


def append_log(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows to a CSV log folder (header in every part file).

    With ``batch`` the rows go to a folder of that name inside the log, replaced as a whole: a
    batch that is written again after a failure is there once."""
    if batch is not None:
        path = f"{path}/{batch}"
    (df.write.mode("append" if batch is None else "overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def _hadoop(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, conf


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    jvm, conf = _hadoop(spark)
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(conf)
    stats = fs.globStatus(p) or []
    out = []
    for st in stats:
        if st.isDirectory():
            it = fs.listFiles(st.getPath(), True)
            while it.hasNext():
                f = it.next().getPath()
                name = f.getName()
                if name.endswith(".csv") and not name.startswith(("_", ".")):
                    out.append(f.toString())
        else:
            out.append(st.getPath().toString())
    return sorted(out)


def file_headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """First line -> files that start with it; empty files and empty first lines are left out.

    One job, whose tasks read the files as text: of every file's first block the line read first.  Only distinct first
    lines with their files' names, a listing, come to the driver."""
    if not files:
        return {}
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                                          F.monotonically_increasing_id().alias("n"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("head")).where("head <> ''")
    known = {_plain(f): f for f in files}
    return {r["head"]: sorted(known[_plain(unquote(p))] for p in r["paths"])
            for r in first.groupBy("head").agg(F.collect_list("path").alias("paths")).collect()}


def _plain(path: str) -> str:
    """A local path without its scheme, another one as it is."""
    return re.sub(r"^file:/+", "/", path)


def read_logs(spark: SparkSession, pattern: str, required: list[str] = GOLD_QUERY_COLUMNS) -> DataFrame:
    """Union of every CSV file under ``pattern`` whose header has ``required``."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, files in file_headers(spark, list_files(spark, pattern)).items():
        header = next(csv.reader(io.StringIO(line)))
        if set(required) <= set(header):
            groups.setdefault(tuple(header), []).extend(files)
    schema_out = T.StructType([T.StructField(c, T.StringType()) for c in required])
    out = spark.createDataFrame([], schema_out)
    for header, files in sorted(groups.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        part = (spark.read.schema(schema).option("header", True).option("multiLine", True)
                .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
                .option("ignoreTrailingWhiteSpace", False).csv(files))
        out = out.unionByName(part.select(*required))
    return out.fillna("", subset=required)


def write_empty(spark: SparkSession, path: str) -> None:
    jvm, conf = _hadoop(spark)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).create(p, True).close()
