import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import embed as E


def test_bucket_counts_come_in_blocks(monkeypatch):
    rnd = np.random.default_rng(2)
    lists = [rnd.integers(0, 6, size=n).tolist() for n in rnd.integers(0, 40, size=50)]
    lists[3] = lists[20] = None
    column = pa.array([[1], *lists, [2]], pa.list_(pa.int32())).slice(1, 50)
    whole = E._bincounts(column, 6).to_pylist()
    seen = []
    count = np.bincount
    monkeypatch.setattr(E, "COUNTED_TOKENS", 30)
    monkeypatch.setattr(E.np, "bincount", lambda x, **kw: (seen.append(len(x)), count(x, **kw))[1])
    assert E._bincounts(column, 6).to_pylist() == whole
    assert max(seen) <= max(len(x) for x in lists if x) + 30 and len(seen) > 10
    for x, v in zip(lists, whole):
        if x is None:
            assert v is None
        else:
            c = count(x, minlength=6) if x else np.zeros(6)
            assert np.allclose(v, c / max(np.linalg.norm(c), 1e-12))


def test_token_vectors_are_windows_of_one_array(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i"), (2, ""), (3, None)], "doc_id long, text string")
    toks = E.token_matrix(df, dim=5, max_length=None)
    assert all(len(r.vec) == 5 and sum(r.vec) == 1.0 for r in toks.collect())
    # no function is called for each number of a vector
    plan = toks.select(F.col("vec"))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan and "sequence(0, 4" not in plan
    assert [r.vec for r in E.token_matrix(df, dim=1, max_length=None).collect()] == [[1.0]] * E.token_matrix(df, dim=1, max_length=None).count()


ODD_TEXTS = ["a b", "", None, "  x  x ", "\n\t", "Wörd\tb\r\nÇ", "a b", None, "q" * 50, "tail ", "next word \u0085 é", "A a"]


def plain_buckets(text, dim):
    if text is None:
        return None
    return [int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dim for t in re.split("[ \t\n\r]+", text) if t]


def test_distinct_tokens_of_some_rows_are_hashed_once(monkeypatch):
    shapes = [pa.array(["skipped", *ODD_TEXTS, "x"]).slice(1, len(ODD_TEXTS)), pa.array(ODD_TEXTS, pa.large_string()),
              pa.array([], pa.string()), pa.array([None, None], pa.string()), pa.array(["", ""])]
    for size in (1, 3, 8, 1 << 20):
        monkeypatch.setattr(E, "TOKEN_BYTES", size)
        for texts in shapes:
            assert E._text_buckets(texts, 7).to_pylist() == [plain_buckets(t, 7) for t in texts.to_pylist()]
    hashed, md5 = [], hashlib.md5
    monkeypatch.setattr(E.hashlib, "md5", lambda t: (hashed.append(t), md5(t))[1])
    E._text_buckets(pa.array(["a b a", "b a", "c"] * 20), 7)
    assert sorted(hashed) == [b"a", b"b", b"c"]


def test_text_vectors_equal_native_buckets(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")
    both = df.select("text", E.hash_embed_col(F.col("text"), 16).alias("v"), E.hash_buckets(F.col("text"), 16).alias("b"))
    for r in both.collect():
        if r.text is None:
            assert r.v is None and r.b is None
        else:
            c = np.bincount(r.b, minlength=16) if r.b else np.zeros(16)
            assert np.allclose(r.v, c / max(np.linalg.norm(c), 1e-12), atol=1e-15)
    # no lambda runs for each token
    plan = both.select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
