"""Incremental ingest of staged files with Structured Streaming.

* ``staged_text`` – file stream over ``*.txt`` (one row per whole file, path
  from the ``_metadata`` column).  Each file is read once across runs: the
  checkpoint remembers what was consumed.  ``clean_source`` archives or
  deletes consumed files (K8); the file source does so one batch late, so
  the files of a job's last batch go with the next run.
* ``staged_pdfs`` – ``binaryFile`` stream over ``*.pdf`` with a plug-in
  extractor; a file that fails to extract becomes a reject row (X5).
* ``start_chunk_ingest`` – X1/K2: chunks appended to a Parquet folder.
* ``start_index_ingest`` – X2/X3/U3: each micro-batch is chunked once,
  embedded once, and loaded into both stored indexes (first store by upsert,
  second by insert-if-absent) as a delta.  A store's manifest keeps each
  stream's last batch, so a restarted batch does not apply twice; another
  stream's batches of equal number do.  An exception stops the
  query (the chain stops on failure).

Run with ``trigger(availableNow=True)`` for job-style runs: everything new is
processed, then the query stops.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import chunk as C
from ..operators import embed as E
from ..operators import index as IX
from ..operators import store as ST
from ..sources import files
from ..sources.tables import chunk_file


def staged_text(spark: SparkSession, staged_dir: str, clean_source: str | None = None,
                archive_dir: str | None = None, max_files: int | None = None) -> DataFrame:
    """``(path, text)`` for every new ``*.txt`` in the staged folder (flat)."""
    r = (spark.readStream.format("text").option("wholetext", True)
         .option("pathGlobFilter", "*.txt"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if clean_source:
        r = r.option("cleanSource", clean_source)
        if clean_source == "archive":
            r = r.option("sourceArchiveDir", archive_dir)
    df = r.load(staged_dir)
    return df.select(files.file_path().alias("path"), F.col("value").alias("text"))


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
PDF_OUT = StructType([StructField("path", StringType()), StructField("text", StringType()),
                      StructField("error", StringType())])


def utf8_extractor(content: bytes) -> str:
    """Default extractor: the file's bytes as UTF-8 text (no PDF codec ships;
    a real one plugs in through ``extractor``)."""
    return content.decode("utf-8")


def staged_pdfs(spark: SparkSession, staged_dir: str,
                extractor: Callable[[bytes], str] = utf8_extractor,
                clean_source: str | None = None, archive_dir: str | None = None) -> DataFrame:
    """``(path, text, error)`` for every new ``*.pdf`` (name ends exactly so)."""
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
         .option("pathGlobFilter", "*.pdf"))
    if clean_source:
        r = r.option("cleanSource", clean_source)
        if clean_source == "archive":
            r = r.option("sourceArchiveDir", archive_dir)
    raw = r.load(staged_dir).select(files.file_path("path").alias("path"), "content")

    def run(batches):
        for pdf in batches:
            texts, errs = [], []
            for c in pdf["content"]:
                try:
                    texts.append(extractor(bytes(c)))
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - a bad file is a reject row
                    texts.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errs})

    return raw.mapInPandas(run, PDF_OUT)


def chunk_files(files: DataFrame, route: str = "txt") -> DataFrame:
    """Chunks of staged files keyed by their path (works on streams)."""
    ok = files.filter(F.col("text").isNotNull()) if "error" not in files.columns \
        else files.filter(F.col("error").isNull())
    return C.chunk(ok.select(F.col("path").alias("doc_id"), "text"), "doc_id", "text", route=route)


def start_chunk_ingest(files: DataFrame, out_dir: str, checkpoint: str, route: str = "txt",
                       reject_dir: str | None = None, available_now: bool = True) -> StreamingQuery:
    """X1 + K2 (+ X5 rejects): append chunks of new files to ``out_dir``.

    With ``reject_dir`` both outputs come from one query: every micro-batch is
    extracted once and written to folders of its stream and batch, so a
    replayed batch replaces its own output.
    """
    if reject_dir and "error" in files.columns:
        stream = stream_id(files.sparkSession, checkpoint)

        def both(batch: DataFrame, batch_id: int) -> None:
            part = f"batch_id={stream}-{int(batch_id)}"
            batch = batch.persist()
            try:
                batch.filter(F.col("error").isNotNull()).write.mode("overwrite").parquet(os.path.join(reject_dir, part))
                chunk_files(batch, route).write.mode("overwrite").parquet(os.path.join(out_dir, part))
            finally:
                batch.unpersist()

        w = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both)
    else:
        w = chunk_files(files, route).writeStream.format("parquet").option("path", out_dir) \
            .option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own name, kept beside its checkpoint: batch numbers begin
    at 0 in every checkpoint, so they say nothing without it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(checkpoint.rstrip("/") + "-stream-id")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out = fs.create(p, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(p.toString()).first()[0]


def index_batch(batch: DataFrame, batch_id: int, first_base: str, second_base: str,
                dim: int = E.DEFAULT_DIM, route: str = "txt", chunk_out: str | None = None,
                reject_out: str | None = None, stream: str = "stream") -> None:
    """One micro-batch into both stores (X2, X3, U3); optionally also append
    its chunks (K2) and its failed files (X5).  ``stream`` names the stream:
    a batch is skipped only if the same stream has written it already."""
    spark = batch.sparkSession
    name = f"{stream}-{int(batch_id)}"
    ST.open_first(spark, first_base, dim)
    ST.open_second(spark, second_base, dim)
    if ST.manifest(spark, second_base)["loads"].get(stream, -1) >= int(batch_id):
        return
    if reject_out and "error" in batch.columns:
        # per batch id and overwritten, so a replayed batch does not add twice
        batch.filter(F.col("error").isNotNull()).write.mode("overwrite") \
            .parquet(os.path.join(reject_out, f"batch_id={name}"))
    chunks = chunk_files(batch, route)
    if chunk_out:
        # one cut of lineage: the chunk set is written once and both stores
        # read it back (the same chunks in both stores, U3)
        out = os.path.join(chunk_out, f"batch_id={name}")
        chunks.write.mode("overwrite").parquet(out)
        chunks = spark.read.parquet(out)
    vec = E.hash_embed(chunks, "text", dim).select("doc_id", "chunk_ix", "chunk_id", "text", "embedding")
    vec = vec.persist()   # one embedding pass feeds both stores
    try:
        model = f"hash-{dim}"
        a = vec.select(IX.first_store_key(F.col("text")).alias("id"),
                       chunk_file(F.col("chunk_id")).alias("file_path"),
                       F.create_map(F.lit("file_path"), chunk_file(F.col("chunk_id"))).alias("metadata"),
                       "embedding", F.lit(model).alias("embedding_model"),
                       F.lit(int(batch_id)).cast("int").alias("batch_no"))
        ST.load(spark, first_base, a, name=stream, number=int(batch_id))
        b = vec.select(IX.second_store_key(chunk_file(F.col("chunk_id")), F.col("text")).alias("id"),
                       F.col("text").alias("document"), F.lit(IX.DEFAULT_CLASSIFICATION).alias("classification"),
                       F.create_map(F.lit("classification"), F.lit(IX.DEFAULT_CLASSIFICATION)).alias("metadata"),
                       "embedding", F.lit(model).alias("embedding_model"),
                       F.lit(int(batch_id)).cast("int").alias("batch_no"))
        ST.load(spark, second_base, b, name=stream, number=int(batch_id))
    finally:
        vec.unpersist()


def index_batch_tables(batch: DataFrame, batch_id: int, first_table: str, second_table: str,
                       buckets: int = 1024, dim: int = E.DEFAULT_DIM, route: str = "txt") -> None:
    """One micro-batch into both stores kept as bucket-partitioned catalog
    tables: each batch rewrites only the buckets its ids fall in, so its cost
    follows the batch, not the index.  Both rules are idempotent, so a
    replayed batch changes nothing."""
    chunks = chunk_files(batch, route)
    vec = E.hash_embed(chunks, "text", dim).select("chunk_id", "text", "embedding").persist()
    try:
        model = f"hash-{dim}"
        a = vec.select(IX.first_store_key(F.col("text")).alias("id"), chunk_file(F.col("chunk_id")).alias("file_path"),
                       F.create_map(F.lit("file_path"), chunk_file(F.col("chunk_id"))).alias("metadata"), "embedding",
                       F.lit(model).alias("embedding_model"), F.lit(int(batch_id)).cast("int").alias("batch_no"))
        IX.merge_partitioned(batch.sparkSession, first_table, a, buckets, rule="upsert")
        b = vec.select(IX.second_store_key(chunk_file(F.col("chunk_id")), F.col("text")).alias("id"),
                       F.col("text").alias("document"), F.lit(IX.DEFAULT_CLASSIFICATION).alias("classification"),
                       F.create_map(F.lit("classification"), F.lit(IX.DEFAULT_CLASSIFICATION)).alias("metadata"),
                       "embedding", F.lit(model).alias("embedding_model"),
                       F.lit(int(batch_id)).cast("int").alias("batch_no"))
        IX.merge_partitioned(batch.sparkSession, second_table, b, buckets, rule="insert",
                             order=("batch_no", "document"))
    finally:
        vec.unpersist()


def start_index_ingest_tables(files: DataFrame, first_table: str, second_table: str, checkpoint: str,
                              buckets: int = 1024, dim: int = E.DEFAULT_DIM,
                              available_now: bool = True) -> StreamingQuery:
    """X2 with partition-local merges (the form to use for large indexes)."""
    w = files.writeStream.option("checkpointLocation", checkpoint) \
        .foreachBatch(lambda df, bid: index_batch_tables(df, bid, first_table, second_table, buckets, dim))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def start_index_ingest(files: DataFrame, first_base: str, second_base: str, checkpoint: str,
                       dim: int = E.DEFAULT_DIM, available_now: bool = True) -> StreamingQuery:
    stream = stream_id(files.sparkSession, checkpoint)
    w = files.writeStream.option("checkpointLocation", checkpoint) \
        .foreachBatch(lambda df, bid: index_batch(df, bid, first_base, second_base, dim, stream=stream))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def start_upload_chain(spark: SparkSession, staged_dir: str, archive_dir: str, chunk_out: str,
                       reject_out: str, first_base: str, second_base: str, checkpoint: str,
                       extractor: Callable[[bytes], str] = utf8_extractor, dim: int = E.DEFAULT_DIM,
                       available_now: bool = True) -> StreamingQuery:
    """Q10 as one query: new PDFs → text (X5 rejects) → chunks appended (K2)
    → both stores (X2, U3); consumed PDFs are archived (K8).  An exception in
    any step stops the query (X3) and the batch is retried on restart; a
    batch already written is skipped."""
    files = staged_pdfs(spark, staged_dir, extractor, "archive", archive_dir)
    stream = stream_id(spark, checkpoint)
    w = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: index_batch(df, bid, first_base, second_base, dim, route="pdf",
                                    chunk_out=chunk_out, reject_out=reject_out, stream=stream))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def new_links(links: DataFrame, seen: DataFrame | None) -> DataFrame:
    """X4 in batch form: URLs not visited in earlier runs (anti join) – keeps
    no unbounded streaming state."""
    fresh = links.select("url").distinct()
    return fresh if seen is None else fresh.join(seen.select("url"), "url", "left_anti")
