"""Staged-text job (Q4): documents as staged text → cleaned words → chunks.

Two entry routes exist: ``txt`` (text dropped straight into the staged
folder: C4 only, so words on both sides of a line break are glued) and
``pdf`` (extracted text: each line ends with a space first, C5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..sources import tables as TB


def staged_chunks(spark: SparkSession, sf_dir: str, route: str = "txt",
                  step: int = C.CHUNK_STEP) -> DataFrame:
    docs = TB.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return C.chunk(docs, "doc_id", "text", route=route, step=step)


def staged_chunks_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_chunks(spark, sf_dir, route="pdf")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 per document, over the whole table."""
    return C.chunk_counts(staged_chunks(spark, sf_dir))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, N1, C4–C6 per document: raw length, ASCII-only length, cleaned
    length and word counts by both routes."""
    d = TB.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.length(T.remove_non_ascii("text")).cast("bigint").alias("ascii_chars"),
        F.length(T.clean_for_chunking("text")).cast("bigint").alias("clean_chars"),
        F.size(T.split_words(T.clean_for_chunking("text"))).cast("bigint").alias("words_txt"),
        F.size(T.split_words(T.clean_for_chunking(T.normalise_lines("text")))).cast("bigint").alias("words_pdf"))


def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 summary: min / avg / max text length by language."""
    d = TB.read_table(spark, sf_dir, "documents", ["lang", "text"])
    return d.groupBy("lang").agg(F.min(F.length("text")).cast("bigint").alias("min_chars"),
                                 F.round(F.avg(F.length("text")), 4).alias("avg_chars"),
                                 F.max(F.length("text")).cast("bigint").alias("max_chars"),
                                 F.count(F.lit(1)).alias("n_docs"))
