"""The pipeline's stages, each against its own rule, and odd rows through all of them."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import packing, queries
from quarry.llm.common import table
from tests.llm.helpers import SF_SMALL, documents
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    r = compare(queries.queries()[name](spark, SF_SMALL), queries.oracle_sql()[name], duck(SF_SMALL))
    assert r["cols_match"] and r["rows_spark"] == r["rows_oracle"] and r["hash_match"], r


def test_stages_over_the_small_tables(spark, tmp):
    docs = table(spark, SF_SMALL, "documents")
    n = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, stage(spark, docs, SF_SMALL)
        docs.write.parquet(f"{tmp}/{k}")
        docs = spark.read.parquet(f"{tmp}/{k}")
        n[name] = docs.count()
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert n["near_duplicates"] < n["toxicity"] <= 200 and n["decontamination"] < n["near_duplicates"] and n["pii"] == n["decontamination"]
    total = docs.filter("start = 0").count()
    assert total == n["pii"]
    left = docs.groupBy("doc_id").agg(F.sum("length").alias("a"), F.max("doc_tokens").alias("b")).filter("a <> b").count()
    assert left == 0


def test_odd_rows_pass_every_stage(spark, tmp):
    docs = documents(spark)
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF_SMALL)
        docs.write.parquet(f"{tmp}/{k}")
        docs = spark.read.parquet(f"{tmp}/{k}")
    ids = {r.doc_id for r in docs.collect()}
    # 1 and 2 are copies, 3, 4 and 5 are empty: the smallest id of each stays, and rows without an id
    assert ids == {None, 1, 3, 6, 7, 8, 9}


def test_empty_table_passes_every_stage(spark):
    docs = table(spark, SF_SMALL, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0


def test_near_duplicates_keep_one_row_of_repeated_ids(spark):
    docs = documents(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z w")]).toDF(*P.COLUMNS, "a", "b", "c", "d", "e", "f")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, SF_SMALL).collect()) == [1, 3]
    assert packing.MAX_TOKENS == 4096
