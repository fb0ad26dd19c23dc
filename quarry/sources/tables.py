"""Driver tables and the derived relations the jobs start from.

Every read goes through ``spark.read.parquet`` followed by an explicit
``select`` so the scan's ReadSchema only carries the needed columns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Root of the text-file layout the page and document paths are built under.
DATA_ROOT = "/data"


# Tables whose rows carry heavy per-row work (text, HTML, vectors).
HEAVY = {"documents", "pages", "conversations", "embeddings"}


SPREAD_SCANS = "quarry.spreadScans"


def balanced(df: DataFrame) -> DataFrame:
    """With the session setting ``quarry.spreadScans = true``, spreads a scan
    that yields fewer splits than the cluster has cores.

    Off by default, as it shuffles the whole rows.  Meant for small tables of
    one row group, which one task would read and then parse, chunk and embed
    alone.
    """
    if df.sparkSession.conf.get(SPREAD_SCANS, "false") != "true":
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return balanced(df) if name in HEAVY else df


def derived_path(spark: SparkSession, sf_dir: str, tables: list[str], name: str) -> str:
    """A place under the shared folder for what is derived from these tables,
    named by the place, size and time of each of their files: a changed table
    gives another place."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for t in sorted(tables):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return scratch_path(spark, f"{name}-{hashlib.sha256('\n'.join(sorted(seen)).encode()).hexdigest()[:24]}")


def doc_path(source: Column, doc_id: Column, root: str = DATA_ROOT) -> Column:
    """Text-file path of a driver document: ``<root>/<source>/<doc_id>.txt``."""
    return F.concat(F.lit(root + "/"), source, F.lit("/"), doc_id.cast("string"), F.lit(".txt"))


def chunk_file(chunk_id: Column, root: str = DATA_ROOT) -> Column:
    """Path of a chunk's text file in the data folder: ``<root>/doc_<id>.txt``."""
    return F.concat(F.lit(root + "/doc_"), chunk_id, F.lit(".txt"))


def documents(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Documents as the text-file corpus ``docs(doc_id, path, source, lang, text)``."""
    cols = ["doc_id", "source", "lang"] + (["text"] if with_text else [])
    df = read_table(spark, sf_dir, "documents", cols)
    return df.withColumn("path", doc_path(F.col("source"), F.col("doc_id")))


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations table as the question batch.

    ``question_id`` is ``<conv_id>:<turn>`` so it stays unique and stable.
    """
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return (conv.filter(F.col("role") == "user")
            .select(F.concat_ws(":", F.col("conv_id").cast("string"),
                                F.col("turn").cast("string")).alias("question_id"),
                    F.col("text")))
