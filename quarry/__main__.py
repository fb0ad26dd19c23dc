"""Command line for the jobs a user of the original scripts runs.

    python -m quarry pages   --pages pages.parquet --out text/           (Q1)
    python -m quarry chunk   --staged staged/ --out chunks/ --checkpoint ck/ [--pdf] [--archive done/]  (Q4)
    python -m quarry index   --docs data/ --store first|second --index idx/ [--embedder hash|subword]  (Q2 / Q3)
    python -m quarry ask     --index idx/ --questions q.txt --out hits/ [--k 5]        (Q5; metric and model from the index)
    python -m quarry compact --index idx/ [--vacuum-days 7]                            (deltas into a new base)
    python -m quarry describe --root indexes/                                          (S9)
    python -m quarry ingest  --staged staged/ --checkpoint ck/ --first-table t1 --second-table t2 [--buckets 1024]  (X2)

Every command runs on the session ``spark-submit`` provides (or a local one
when started directly); inputs and outputs are ordinary Parquet / text paths.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import urls as U
from .functions import text as T
from .operators import embed as E
from .operators import html as H
from .operators import index as IX
from .operators import store as ST
from .session import get_spark
from .sources import files
from .streaming import ingest


def _pages(spark, a):
    p = spark.read.parquet(a.pages).select("url", "html")
    p = p.withColumn("url", U.link_line("url")).filter((F.col("url") != "") & U.is_valid_url("url"))
    p = p.withColumn("_row", F.monotonically_increasing_id())
    first = p.groupBy("url").agg(F.min("_row").alias("_row"))
    first = first.withColumn("path", U.path_from_url(U.strip_html_suffix("url"), a.base))
    win = first.groupBy("path").agg(F.max("_row").alias("_row"))
    docs = H.extract_text(p.join(win, "_row").select("path", "url", "html"), "html", "raw")
    out = docs.select("path", "url", T.remove_non_ascii(T.newline_to_space("raw")).alias("text"))
    files.write_overwrite(out, a.out)


def _chunk(spark, a):
    src = ingest.staged_pdfs(spark, a.staged, clean_source="archive" if a.archive else None,
                             archive_dir=a.archive) if a.pdf else \
        ingest.staged_text(spark, a.staged, "archive" if a.archive else None, a.archive)
    # a file that can't be extracted leaves a row beside the chunks, if no place is named
    rejects = a.rejects or (a.out.rstrip("/") + "-rejects" if a.pdf else None)
    q = ingest.start_chunk_ingest(src, a.out, a.checkpoint, route="pdf" if a.pdf else "txt", reject_dir=rejects)
    q.awaitTermination()


def _index(spark, a):
    docs = files.text_corpus(spark, a.docs)
    name = f"{a.embedder}-{a.dim}"
    model = F.lit(name)
    batch_no = F.lit(a.batch).cast("int")
    if a.store == "first":
        rows = docs.select(
            IX.first_store_key(F.col("text")).alias("id"), F.col("path").alias("file_path"),
            F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"),
            model.alias("embedding_model"), batch_no.alias("batch_no"), "text")
        ST.load(spark, ST.open_first(spark, a.index, a.dim, name), rows, enrich=lambda df: E.embed_as(df, "text", name))
    else:
        rows = docs.select(
            IX.second_store_key(F.col("path"), F.col("text")).alias("id"), F.col("text").alias("document"),
            F.lit(IX.DEFAULT_CLASSIFICATION).alias("classification"),
            F.create_map(F.lit("classification"), F.lit(IX.DEFAULT_CLASSIFICATION)).alias("metadata"),
            model.alias("embedding_model"), batch_no.alias("batch_no"))
        ST.load(spark, ST.open_second(spark, a.index, a.dim, name), rows, enrich=lambda df: E.embed_as(df, "document", name))


def _ask(spark, a):
    """A question's number is a hash of its text: equal lines are one question.  The index names its embedding model (F8)."""
    model = ST.manifest(spark, a.index)["model"]
    q = spark.read.text(a.questions).select(F.col("value").alias("text")).filter(F.trim("text") != "").distinct()
    q = q.select(F.md5("text").alias("question_id"), "text")
    qv = E.embed_as(q, "text", model).select("question_id", "embedding", F.lit(model).alias("embedding_model"))
    hits = ST.search(spark, a.index, qv, k=a.k)
    hits.join(q.select("question_id", F.col("text").alias("question")), "question_id") \
        .write.mode("overwrite").parquet(a.out)


def _compact(spark, a):
    ST.compact(spark, a.index)
    if a.vacuum_days is not None:
        ST.vacuum(spark, a.index, older_than=a.vacuum_days * 86400)


def _describe(spark, a):
    ST.list_stores(spark, a.root).orderBy("name").show(truncate=False)


def _ingest(spark, a):
    src = ingest.staged_text(spark, a.staged)
    q = ingest.start_index_ingest_tables(src, a.first_table, a.second_table, a.checkpoint,
                                         buckets=a.buckets, dim=a.dim)
    q.awaitTermination()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("pages")
    p.add_argument("--pages", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--base", default="/data")
    c = sub.add_parser("chunk")
    c.add_argument("--staged", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--checkpoint", required=True)
    c.add_argument("--pdf", action="store_true")
    c.add_argument("--archive")
    c.add_argument("--rejects")
    i = sub.add_parser("index")
    i.add_argument("--docs", required=True)
    i.add_argument("--store", choices=["first", "second"], required=True)
    i.add_argument("--index", required=True)
    i.add_argument("--batch", type=int, default=0)
    i.add_argument("--dim", type=int, default=E.DEFAULT_DIM)
    i.add_argument("--embedder", choices=sorted(E.EMBEDDERS), default="hash")
    k = sub.add_parser("ask")
    k.add_argument("--index", required=True)
    k.add_argument("--questions", required=True)
    k.add_argument("--out", required=True)
    k.add_argument("--k", type=int, default=5)
    k.add_argument("--dim", type=int, help="not needed: the index knows its embedding model")
    k.add_argument("--store", choices=["first", "second"], help="not needed: the index knows its metric")
    o = sub.add_parser("compact")
    o.add_argument("--index", required=True)
    o.add_argument("--vacuum-days", type=float)
    e = sub.add_parser("describe")
    e.add_argument("--root", required=True)
    g = sub.add_parser("ingest")
    g.add_argument("--staged", required=True)
    g.add_argument("--checkpoint", required=True)
    g.add_argument("--first-table", required=True)
    g.add_argument("--second-table", required=True)
    g.add_argument("--buckets", type=int, default=1024)
    g.add_argument("--dim", type=int, default=E.DEFAULT_DIM)
    a = ap.parse_args(argv)
    spark = get_spark(app=f"quarry-{a.cmd}")
    {"pages": _pages, "chunk": _chunk, "index": _index, "ask": _ask, "compact": _compact, "describe": _describe, "ingest": _ingest}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
