"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again.  All stages but the
last return the columns of ``documents``.

Null texts count as empty.  Rows without an id pass the filters that decide
by id (near duplicates, benchmark); the classifier judges them like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, packing, pii, simhash, toxicity
from quarry.llm.common import exact, scratch, stored, table
from quarry.llm.queries import tokenizer_path
from quarry.session import checkpoint_dir, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(spark: SparkSession) -> None:
    checkpoint_dir(spark)
    ship_package(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels of training rows."""
    _ready(spark)
    docs = exact(docs, *COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id.

    Of rows equal in id and text the greatest stays; different texts under
    one id, and rows without an id, stay.
    """
    _ready(spark)
    docs = exact(docs, *COLUMNS)
    groups = simhash.near_duplicates(docs)
    keep = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id", F.md5("text").alias("_text")) \
        .agg(F.max(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*").select(COLUMNS)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _ready(spark)
    docs = exact(docs, *COLUMNS)
    bad = stored(decontam.contaminated_pairs(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "pipeline-leaks")
    return docs.join(bad, "doc_id", "left_anti").select(COLUMNS)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses as pseudonyms."""
    _ready(spark)
    done = pii.pseudonymise(exact(docs, *COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, with their ids as little-endian unsigned 32-bit numbers."""
    _ready(spark)
    return packing.pack(exact(docs, *COLUMNS), tokenizer_path(), added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", replace_personal),
    ("packing", pack_tokens),
]

#: SQL can express neither the trained filter nor the tokenizer; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}", scratch(spark, f"pipeline-{name}"))
    return docs
