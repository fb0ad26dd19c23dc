"""Page job (Q1): link list → first visit → page text files.

Rules: a link line is stripped and blank lines dropped (S1, F1); a URL must
open with its own ``scheme://netloc`` (F3); each URL is visited once, at its
first occurrence (F2); the text is the whole page's text with newlines as
spaces and non-ASCII removed (N3, N2, N1); the file path comes from the URL
without a final ``.html`` (N5, N6).  When several URLs map to one path the
last one written wins (K1); "last" is the latest first visit.

Plan: the de-duplication runs on a slim ``(page_id, url)`` projection with
two partially aggregated group-bys (skew-safe: a hot URL or path is
pre-reduced map-side); only the winning pages are joined back to their HTML
and parsed, so each page body crosses one shuffle and is parsed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import html as H
from ..sources import tables as TB


def link_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 over a text file of links: one URL per line, stripped, no blanks."""
    return (spark.read.text(path).select(U.link_line("value").alias("url"))
            .filter(F.col("url") != ""))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct valid URLs of the page table."""
    p = TB.read_table(spark, sf_dir, "pages", ["url"])
    u = p.select(U.link_line("url").alias("url")).filter(F.col("url") != "")
    return u.filter(U.is_valid_url("url")).distinct()


def page_files(spark: SparkSession, sf_dir: str, base: str = TB.DATA_ROOT) -> DataFrame:
    """Which page ends up in which text file: ``(path, url, page_id, tld)``."""
    p = TB.read_table(spark, sf_dir, "pages", ["page_id", "url"])
    u = (p.select("page_id", U.link_line("url").alias("url"))
         .filter((F.col("url") != "") & U.is_valid_url("url")))
    first = u.groupBy("url").agg(F.min("page_id").alias("first_id"))
    first = first.withColumn("path", U.path_from_url(U.strip_html_suffix("url"), base))
    win = first.groupBy("path").agg(F.max_by("url", "first_id").alias("url"),
                                    F.max("first_id").alias("page_id"))
    return win.select("path", "url", "page_id", U.tld("url").alias("tld"))


def page_text(spark: SparkSession, sf_dir: str, base: str = TB.DATA_ROOT) -> DataFrame:
    """Q1: ``docs(page_id, path, url, text)`` – one text per output file."""
    files = page_files(spark, sf_dir, base).select("page_id", "path", "url")
    html = TB.read_table(spark, sf_dir, "pages", ["page_id", "html"])
    docs = H.extract_text(files.join(html, "page_id"), "html", "raw")
    return docs.select("page_id", "path", "url",
                       T.remove_non_ascii(T.newline_to_space("raw")).alias("text"))


def page_text_native(spark: SparkSession, sf_dir: str, base: str = TB.DATA_ROOT) -> DataFrame:
    """Q1 with the native tag-strip rule instead of the HTML parser: same
    files, text fully inside the JVM (checkable by SQL)."""
    files = page_files(spark, sf_dir, base).select("page_id", "path", "url")
    html = TB.read_table(spark, sf_dir, "pages", ["page_id", "html"])
    raw = T.strip_tags(F.col("html"))
    return files.join(html, "page_id").select(
        "page_id", "path", "url", T.remove_non_ascii(T.newline_to_space(raw)).alias("text"))


def page_references(spark: SparkSession, sf_dir: str, base: str = TB.DATA_ROOT) -> DataFrame:
    """N4–N7 on every valid page URL: tld, file path, and the link rebuilt
    from that path for answers."""
    p = TB.read_table(spark, sf_dir, "pages", ["page_id", "url"])
    u = p.filter(U.is_valid_url("url"))
    path = U.path_from_url(U.strip_html_suffix("url"), base)
    return u.select("page_id", "url", U.tld("url").alias("tld"), path.alias("path"),
                    U.url_from_source(path, base).alias("reference"))
