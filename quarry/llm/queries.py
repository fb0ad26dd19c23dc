"""The registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, collocate, convrepair, decontam, packing, pii, quality, sharding, simhash, tagpath, tokencount, toxicity, warc
from quarry.llm.common import table
from quarry.session import checkpoint_dir, ship_package


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file's place: ``QUARRY_TOKENIZERS`` or the installed package of public tokenizers."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.resolved_archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extract_pages(table(spark, sf_dir, "pages"))


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.repetition_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "dup_line_chars", *[f"dup_{n}_chars" for n in quality.MAX_COVERAGE])


def op6_balanced_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"))


def op8_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "batch_id")


def op11_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return convrepair.repair_report(conversations, convrepair.damaged(conversations))


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_prefix_free_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocate.collocations(table(spark, sf_dir, "documents"))


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


_ALL = [op1_latent_decontamination, op2_perspective_rotation, op3_revisit_resolution, op4_tag_path_ratios, op5_repetition_coverage,
        op6_balanced_propagation, op7_feistel_pseudonyms, op8_bit_sliced_simhash, op9_ftrl_toxicity, op10_binary_packing,
        op11_glr_repair, op12_whole_token_counts, op13_prefix_free_collocations]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _query(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_perspective_rotation": chat.oracle_sql(), "op3_revisit_resolution": warc.oracle_sql(),
            "op5_repetition_coverage": quality.oracle_sql(), "op13_prefix_free_collocations": collocate.oracle_sql()}
