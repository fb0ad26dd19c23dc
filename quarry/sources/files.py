"""File sources (S1, S3–S5, K1, K2) as batch scans.

All of them are ``spark.read`` file sources – splits, pruning and retries are
Spark's; the file path comes from the hidden ``_metadata`` column.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def file_path(c=None):
    """Absolute path of a scanned file: a local ``file:`` URI becomes a plain
    path (the id the text jobs use); other schemes stay URIs.

    The hidden ``_metadata.file_path`` is percent-encoded and decoded here
    (``+`` stands for itself in it); a ``path`` column as the binary-file
    source gives it is not encoded.
    """
    if c is None:
        c = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "^file:(//)?", "")


def text_corpus(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """S3 (recursive, ``**/*.txt``) / S5 (flat): one row per whole file,
    ``(path, text)``; the absolute path is the document id."""
    r = (spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt")
         .option("recursiveFileLookup", recursive))
    return r.load(root).select(file_path().alias("path"), F.col("value").alias("text"))


def staged_text_batch(spark: SparkSession, staged_dir: str) -> DataFrame:
    """Flat ``*.txt`` scan of the staged folder; fails when the folder is
    missing or holds no text file, like the reference job."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(staged_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"staged folder {staged_dir} does not exist")
    df = text_corpus(spark, staged_dir, recursive=False)
    if df.isEmpty():
        raise FileNotFoundError(f"no .txt files in {staged_dir}")
    return df


PDF_TEXT = StructType([StructField("path", StringType()), StructField("text", StringType()),
                       StructField("error", StringType())])


def pdf_batch(spark: SparkSession, staged_dir: str, extractor: Callable[[bytes], str]) -> DataFrame:
    """``binaryFile`` scan of ``*.pdf`` (exact, case-sensitive suffix) with a
    plug-in extractor; per-file failures become ``error`` rows (X5)."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
           .load(staged_dir).select(file_path("path").alias("path"), "content"))

    def run(batches):
        for pdf in batches:
            texts, errs = [], []
            for c in pdf["content"]:
                try:
                    texts.append(extractor(bytes(c)))
                    errs.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errs})

    return raw.mapInPandas(run, PDF_TEXT)


def write_overwrite(df: DataFrame, out: str) -> None:
    """K1: replace a text set."""
    df.write.mode("overwrite").parquet(out)


def write_append(df: DataFrame, out: str) -> None:
    """K2: add to a chunk set, older rows kept."""
    df.write.mode("append").parquet(out)
