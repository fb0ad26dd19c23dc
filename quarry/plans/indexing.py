"""Index loads (Q2 first store, Q3 second store) over the document corpus.

Documents arrive in batches by crawl ``source`` (``src<N>`` → batch ``N``),
as repeated runs of the original load jobs would bring them.  Chunk files
of the staged-text job land in the same folder and are keyed by their path;
only texts without a file (questions of a chat, say) are keyed by their
first 50 characters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import embed as E
from ..operators import index as IX
from ..operators import store as ST
from ..session import scratch_path
from ..sources import tables as TB

DIM = E.DEFAULT_DIM
MODEL = f"hash-{DIM}"


def _batch_no(source: str = "source"):
    return F.substring(F.col(source), 4, 10).cast("int")


def first_store_batch(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    docs = TB.documents(spark, sf_dir)
    rows = E.hash_embed(docs, "text", dim).select(
        IX.first_store_key(F.col("text")).alias("id"),
        F.col("path").alias("file_path"),
        F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"),
        "embedding", F.lit(f"hash-{dim}").alias("embedding_model"),
        _batch_no().alias("batch_no"))
    return IX.check_dimension(rows, dim)


def first_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2/K4: every batch upserted; one row per 512-character prefix."""
    return IX.upsert(None, first_store_batch(spark, sf_dir))


def _summary(index: DataFrame, *cols: str | Column) -> DataFrame:
    return index.select(*cols, "embedding_model", F.size("embedding").cast("int").alias("n_dims"),
                        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("emb_sum"))


def first_store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(first_store(spark, sf_dir), "id", "file_path", "batch_no")


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document classification metadata: ``restricted`` when labelled
    toxic, otherwise the store default ``public``."""
    lab = TB.read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return lab.filter(F.col("toxic") == 1).select("doc_id", F.lit("restricted").alias("label_class")).distinct()


def second_store_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (batch 0) and their chunk files (batch 1), each keyed by its
    path, not yet embedded."""
    base = TB.read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    cls = classification(spark, sf_dir)
    d = base.select("doc_id", F.lit(-1).alias("chunk_ix"), TB.doc_path(F.col("source"), F.col("doc_id")).alias("path"),
                    "text", F.lit(0).alias("batch_no"))
    ch = C.chunk(base).select(
        "doc_id", "chunk_ix", TB.chunk_file(F.col("chunk_id")).alias("path"), "text", F.lit(1).alias("batch_no"))
    rows = d.unionByName(ch).join(cls, "doc_id", "left")
    klass = F.coalesce(F.col("label_class"), F.lit(IX.DEFAULT_CLASSIFICATION))
    return rows.select(
        IX.second_store_key(F.col("path"), F.col("text")).alias("id"),
        F.col("text").alias("document"), klass.alias("classification"),
        F.create_map(F.lit("classification"), klass).alias("metadata"),
        F.lit(f"hash-{DIM}").alias("embedding_model"), "batch_no", "doc_id", "chunk_ix")


def _embed_documents(dim: int):
    def run(df: DataFrame) -> DataFrame:
        return IX.check_dimension(E.hash_embed(df, "document", dim), dim)
    return run


def second_store(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """Q3/K5/K6: insert-if-absent; the first writer of an id keeps it.  Only
    surviving records are embedded (duplicates are dropped first)."""
    return IX.insert_if_absent(None, second_store_batch(spark, sf_dir),
                               order=("batch_no", "doc_id", "chunk_ix"), enrich=_embed_documents(dim))


def pathless_store(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """K6: conversation turns as texts without a file, keyed by their first
    50 characters; the first turn of a key keeps it."""
    c = TB.read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    rows = c.select(IX.second_store_key(F.lit(None).cast("string"), F.col("text")).alias("id"), F.col("text").alias("document"),
                    F.lit(IX.DEFAULT_CLASSIFICATION).alias("classification"), F.lit(f"hash-{dim}").alias("embedding_model"), "conv_id", "turn")
    s = IX.insert_if_absent(None, rows, order=("conv_id", "turn", "document"), enrich=_embed_documents(dim))
    return _summary(s, "id", "classification", "conv_id", "turn")


def _loads(rows: DataFrame, changed) -> list[DataFrame]:
    """A base load and two later ones: documents of even sources, those of odd
    ones, and a changed version of every tenth document of the first."""
    even = F.col("batch_no") % 2 == 0
    return [rows.filter(even), rows.filter(~even), changed(rows.filter(even & (F.col("doc_id") % 10 == 0)))]


def first_store_reload(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """A base, two delta loads and a compaction of the stored index.

    A later load wins for every key it brings, though its batch number is
    lower here (-1) and its path may sort before the stored one.
    """
    docs = TB.documents(spark, sf_dir).withColumn("batch_no", _batch_no())
    first, *later = _loads(docs, lambda d: d.withColumn("path", F.concat(F.lit("/a"), "path")).withColumn(
        "text", F.concat(F.substring("text", 1, IX.FIRST_STORE_KEY_CHARS), F.lit(" changed"))))

    def rows(d: DataFrame) -> DataFrame:
        return E.hash_embed(d, "text", dim).select(
            IX.first_store_key(F.col("text")).alias("id"), F.col("path").alias("file_path"),
            F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"), "embedding",
            F.lit(f"hash-{dim}").alias("embedding_model"), "batch_no")

    base = ST.open_first(spark, scratch_path(spark, f"first-store-{uuid.uuid4().hex}"), dim)
    for load in (first, *[d.withColumn("batch_no", F.lit(-1)) for d in later]):
        ST.load(spark, base, rows(load))
    ST.compact(spark, base)
    return _summary(ST.read(spark, base), "id", F.element_at("metadata", "file_path").alias("file_path"), "batch_no")


def second_store_reload(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """The same loads and compaction in the second store, where a path
    that is there keeps its first text; only new rows are embedded."""
    docs = TB.documents(spark, sf_dir).withColumn("batch_no", _batch_no())

    def rows(d: DataFrame) -> DataFrame:
        return d.select(IX.second_store_key(F.col("path"), F.col("text")).alias("id"), F.col("text").alias("document"),
                        F.lit(IX.DEFAULT_CLASSIFICATION).alias("classification"),
                        F.create_map(F.lit("classification"), F.lit(IX.DEFAULT_CLASSIFICATION)).alias("metadata"),
                        F.lit(f"hash-{dim}").alias("embedding_model"), "batch_no")

    base = ST.open_second(spark, scratch_path(spark, f"second-store-{uuid.uuid4().hex}"), dim)
    for load in _loads(docs, lambda d: d.withColumn("text", F.concat("text", F.lit(" changed")))):
        ST.load(spark, base, rows(load), enrich=lambda df: E.hash_embed(df, "document", dim))
    ST.compact(spark, base)
    return _summary(ST.read(spark, base), "id", F.element_at("metadata", "classification").alias("classification"),
                    F.md5("document").alias("document_md5"), "batch_no")


def second_store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(second_store(spark, sf_dir), "id", "classification", "batch_no", "doc_id", "chunk_ix")


def first_store_subwords(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """Q2 by its own recipe (M5, M6, A1, M1): the first 256 subword tokens of a
    text, padded, masked and pooled from real-valued token vectors, loaded into
    a stored first store; only the winners of a key are embedded."""
    model = f"subword-{dim}"
    base = ST.open_first(spark, scratch_path(spark, f"first-store-{uuid.uuid4().hex}"), dim, model)
    rows = TB.documents(spark, sf_dir).select(
        IX.first_store_key(F.col("text")).alias("id"), F.col("path").alias("file_path"),
        F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"), F.lit(model).alias("embedding_model"),
        _batch_no().alias("batch_no"), "text")
    ST.load(spark, base, rows, enrich=lambda df: E.embed_as(df, "text", model))
    index = ST.read(spark, base)
    return _summary(index, "id", "file_path", "batch_no", F.round(F.col("embedding")[0], 6).alias("emb_first"),
                    F.round(F.col("embedding")[dim - 1], 6).alias("emb_last"))


def stored_first(spark: SparkSession, sf_dir: str, dim: int = DIM) -> str:
    """Q2 as a job: the first store of these documents, loaded once for a state of the table."""
    base = TB.derived_path(spark, sf_dir, ["documents"], f"first-store-{dim}")
    ST.open_first(spark, base, dim)
    ST.load(spark, base, first_store_batch(spark, sf_dir, dim), name="documents")
    return base


def stored_second(spark: SparkSession, sf_dir: str, dim: int = DIM) -> str:
    """Q3 as a job: the second store of these documents and their chunks, loaded once for a state of the tables."""
    base = TB.derived_path(spark, sf_dir, ["documents", "labels"], f"second-store-{dim}")
    ST.create(spark, base, IX.SECOND_STORE_SCHEMA, dim, "l2", f"hash-{dim}", "insert", order=("batch_no", "doc_id", "chunk_ix"))
    ST.load(spark, base, second_store_batch(spark, sf_dir), enrich=lambda df: E.hash_embed(df, "document", dim), name="documents")
    return base


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8/S9/A4 over both stored indexes, from their manifests: no row is read
    or counted, and every load has checked the dimension."""
    facts = ST.describe(spark, {"first": stored_first(spark, sf_dir), "second": stored_second(spark, sf_dir)})
    return facts.select("embedding_model", "total_vector_count", F.col("dimension").alias("min_dim"), F.col("dimension").alias("max_dim"),
                        F.col("name").alias("store"))


def pages_first_store(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """E1 end to end: page table → text files (Q1, native tag-strip form) →
    first store (Q2): one record per 512-character prefix of a page text,
    last writer (greatest path) wins."""
    from .pages import page_text_native
    texts = page_text_native(spark, sf_dir)
    rows = E.hash_embed(texts, "text", dim).select(
        IX.first_store_key(F.col("text")).alias("id"), F.col("path").alias("file_path"),
        F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"), "embedding",
        F.lit(f"hash-{dim}").alias("embedding_model"), F.lit(0).alias("batch_no"))
    return _summary(IX.upsert(None, IX.check_dimension(rows, dim)), "id", "file_path", "batch_no")
