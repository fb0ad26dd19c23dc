"""Stored indexes: base, deltas, compaction, manifest, two writers."""
import os
import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.operators import store as ST

SCHEMA = "id string, file_path string, embedding array<double>, embedding_model string, batch_no int"


def frame(spark, rows):
    return spark.createDataFrame([(i, p, v, "m", b) for i, p, v, b in rows], SCHEMA)


def make(spark, base, rule="upsert", **kw):
    order = ("batch_no", "file_path")
    return ST.create(spark, base, frame(spark, []).schema, kw.pop("dim", 2), model="m", rule=rule, order=order, buckets=4, **kw)


def rows(df):
    return sorted(((r.id, r.file_path, r.batch_no) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


V = [1.0, 0.0]


@pytest.mark.parametrize("rule", ST.RULES)
def test_loads_equal_the_plain_rules(spark, tmp, rule):
    """Base, three deltas and a compaction give what rewriting the whole table does."""
    base = os.path.join(tmp, "s")
    make(spark, base, rule)
    loads = [[(f"k{i}", f"/a{i}", V, 0) for i in range(30)] + [(None, "/n", V, 0)],
             [(f"k{i}", f"/b{i}", V, 1) for i in range(20, 50)] + [("k20", "/c", V, 1)],
             [(f"k{i}", f"/d{i}", V, -1) for i in range(5)] + [(f"k{i}", "/e", V, -1) for i in range(48, 53)],
             [("k1", "/f", V, 2), ("k20", "/f", V, 2), (None, "/g", V, 2)]]
    plain: dict = {}
    for part in loads:
        best: dict = {}
        for i, p, _, b in part:
            if i not in best or ((b, p) > best[i]) == (rule == "upsert"):
                best[i] = (b, p)
        plain = {**plain, **best} if rule == "upsert" else {**best, **plain}
        m = ST.load(spark, base, frame(spark, part))
        want = sorted(((i, p, b) for i, (b, p) in plain.items()), key=lambda r: (r[0] is not None, r))
        assert rows(ST.read(spark, base)) == want and m["rows"] == len(want)
    before = rows(ST.read(spark, base))
    m = ST.compact(spark, base)
    assert len(m["segments"]) == 1 and m["rows"] == len(before)
    assert rows(ST.read(spark, base)) == before
    assert rows(ST.read(spark, base, version=2)) == rows(frame(spark, loads[0]))     # older versions stay readable
    assert "Join" not in ST.read(spark, base)._jdf.queryExecution().toString()        # nothing to merge after it


def test_a_small_load_writes_little(spark, tmp):
    base = os.path.join(tmp, "s")
    make(spark, base, dim=64)
    wide = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("id"), F.lit("/p").alias("file_path"),
                                      F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.hash("id", i).cast("double")).alias("embedding"),
                                      F.lit("m").alias("embedding_model"), F.lit(0).alias("batch_no"))
    ST.load(spark, base, wide)
    whole = size(base)
    m = ST.load(spark, base, wide.limit(200).withColumn("batch_no", F.lit(1)))
    assert m["rows"] == 20_000 and size(base) - whole < 0.02 * whole
    assert ST.read(spark, base).filter("batch_no = 1").count() == 200


def test_only_touched_buckets_are_read(spark, tmp):
    base = os.path.join(tmp, "s")
    make(spark, base)
    ST.load(spark, base, frame(spark, [(f"k{i}", "/a", V, 0) for i in range(40)]))
    m = ST.manifest(spark, base)
    plan = ST._live(spark, base, m, [2]).select("_digest")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket").replace("(bucket", "bucket") and "embedding" not in plan.split("ReadSchema")[-1]


def test_remove_and_vacuum(spark, tmp):
    base = os.path.join(tmp, "s")
    make(spark, base)
    ST.load(spark, base, frame(spark, [("a", "/1", V, 0), ("b", "/1", V, 0)]))
    m = ST.remove(spark, base, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert m["rows"] == 1 and rows(ST.read(spark, base)) == [("b", "/1", 0)]
    assert ST.load(spark, base, frame(spark, [("a", "/2", V, 0)]))["rows"] == 2
    assert rows(ST.read(spark, base)) == [("a", "/2", 0), ("b", "/1", 0)]
    ST.compact(spark, base)
    assert ST.vacuum(spark, base) == 0                       # young folders may be a writer's
    assert ST.vacuum(spark, base, older_than=-5) == 3
    assert rows(ST.read(spark, base)) == [("a", "/2", 0), ("b", "/1", 0)] and len(ST.versions(spark, base)) == 1
    ST.drop(spark, base)
    assert not ST.exists(spark, base)


def test_manifest_refuses_what_does_not_fit(spark, tmp):
    base = os.path.join(tmp, "s")
    make(spark, base)
    with pytest.raises(ValueError, match="dim"):
        make(spark, base, dim=3)
    with pytest.raises(ValueError, match="metric"):
        make(spark, base, metric="l2")
    with pytest.raises(Exception, match="dimension must be 2"):
        ST.load(spark, base, frame(spark, [("a", "/1", [1.0, 2.0, 3.0], 0)]))
    with pytest.raises(Exception, match="embedding model must be m"):
        ST.load(spark, base, frame(spark, [("a", "/1", V, 0)]).withColumn("embedding_model", F.lit("other")))
    assert ST.manifest(spark, base)["rows"] == 0 and ST.read(spark, base).count() == 0
    ST.load(spark, base, frame(spark, [("a", "/1", V, 0), ("b", "/1", [0.0, 1.0], 0)]))
    facts = ST.list_stores(spark, tmp).first()
    assert (facts.name, facts.dimension, facts.metric, facts.embedding_model, facts.total_vector_count) == ("s", 2, "cosine", "m", 2)
    q = spark.createDataFrame([("q", [1.0, 0.1], "m")], "question_id string, embedding array<double>, embedding_model string")
    assert [r.id for r in ST.search(spark, base, q, k=1).collect()] == ["a"]
    with pytest.raises(ValueError, match="embedded with"):
        ST.search(spark, base, q.withColumn("embedding_model", F.lit("other")))
    with pytest.raises(ValueError, match="dimensions"):
        ST.search(spark, base, q.withColumn("embedding", F.array(F.lit(1.0))))


def test_named_loads_are_added_once(spark, tmp):
    base = os.path.join(tmp, "s")
    make(spark, base)
    ST.load(spark, base, frame(spark, [("a", "/1", V, 0)]), name="s", number=1)
    m = ST.load(spark, base, frame(spark, [("b", "/1", V, 0)]), name="s", number=1)
    assert m["version"] == 2 and rows(ST.read(spark, base)) == [("a", "/1", 0)]


@pytest.mark.parametrize("rule", ST.RULES)
def test_two_writers_lose_nothing(spark, tmp, rule):
    """Both begin at one version; their common key is one row, the count is right."""
    base = os.path.join(tmp, "s")
    make(spark, base, rule)
    start, failed = threading.Barrier(2), []

    def writer(n):
        try:
            batch = frame(spark, [(f"w{n}-{i}", f"/{n}", V, n) for i in range(10)] + [("both", f"/{n}", V, n)])
            start.wait()
            ST.load(spark, base, batch)
        except Exception as e:  # noqa: BLE001 - shown by the assert
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    m = ST.manifest(spark, base)
    assert m["version"] == 3 and m["rows"] == 21 == ST.read(spark, base).count()


def test_a_load_beside_a_compaction_stays(spark, tmp, monkeypatch):
    base = os.path.join(tmp, "s")
    make(spark, base)
    for n in range(2):
        ST.load(spark, base, frame(spark, [("a", f"/{n}", V, n), (f"k{n}", "/", V, n)]))
    real, late = ST._commit, []

    def commit(spark, b, old, **changes):
        if changes["kind"] == "compact" and not late:
            late.append(1)
            ST.load(spark, b, frame(spark, [("a", "/late", V, 9)]))
        return real(spark, b, old, **changes)

    monkeypatch.setattr(ST, "_commit", commit)
    m = ST.compact(spark, base)
    assert len(m["segments"]) == 2 and m["rows"] == 3
    assert rows(ST.read(spark, base)) == [("a", "/late", 9), ("k0", "/", 0), ("k1", "/", 1)]


def test_commit_is_taken_once(spark, tmp):
    path = os.path.join(tmp, "log", "000000000001.json")
    assert ST._create_atomic(spark, path, "one") and not ST._create_atomic(spark, path, "two")
    assert open(path).read() == "one" and os.listdir(os.path.dirname(path)) == ["000000000001.json"]


def test_index_functions_read_stores(spark, tmp):
    base = os.path.join(tmp, "s")
    make(spark, base)
    assert IX.index_exists(spark, base) and IX.read_index(spark, base).count() == 0
    IX.drop_index(spark, base)
    assert not IX.index_exists(spark, base)


def test_subword_store_is_loaded_and_searched_with_its_model(spark, tmp):
    """M5, M6, A1: against plain Python; F8: the store's model embeds, another's questions are refused."""
    import hashlib

    import numpy as np

    from quarry.operators import embed as E

    texts = [(1, "Hello wonderful World"), (2, ""), (3, None), (4, " \n "), (5, "x" * 3000), (6, " ".join(f"w{i}" for i in range(400))), (7, "日本語テキスト é")]
    docs = spark.createDataFrame(texts, "n int, text string")

    def plain(text):
        pieces = [("##" if i else "") + w[i:i + 4] for w in (text or "").lower().split() for i in range(0, len(w), 4)][:256]
        rows = [np.frombuffer(b"".join(hashlib.md5(f"{k}:{p}".encode()).digest() for k in range(2)), np.uint8)[:20] / 127.5 - 1 for p in pieces]
        v = np.sum(rows, axis=0) / max(len(rows), 1e-9) if rows else np.zeros(20)
        return v / max(np.linalg.norm(v), 1e-12)

    got = {r.n: r.embedding for r in E.embed_as(docs, "text", "subword-20").collect()}
    for n, text in texts:
        assert np.allclose(got[n], plain(text), atol=1e-12)
    assert not np.any(got[2]) and not np.any(got[3])
    base = ST.open_first(spark, os.path.join(tmp, "s"), 20, "subword-20")
    rows = docs.filter("text IS NOT NULL").select(F.col("text").alias("id"), F.lit("/p").alias("file_path"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"),
                                                  F.lit("subword-20").alias("embedding_model"), F.lit(0).alias("batch_no"), "text")
    ST.load(spark, base, rows, enrich=lambda d: E.embed_as(d, "text", "subword-20"))
    ask = spark.createDataFrame([("q", "hello world wonderful")], "question_id string, text string")
    q = E.embed_as(ask, "text", "subword-20").withColumn("embedding_model", F.lit("subword-20"))
    assert ST.search(spark, base, q, k=1).first().id == "Hello wonderful World"
    with pytest.raises(ValueError, match="embedded with"):
        ST.search(spark, base, E.embed_as(ask, "text", "hash-20").withColumn("embedding_model", F.lit("hash-20")))
    with pytest.raises(ValueError, match="no embedder"):
        E.embed_as(ask, "text", "other-20")
    with pytest.raises(Exception, match="token vectors of shape"):
        E.pooled_embed(ask, "text", 20, vectors=lambda: lambda tokens: np.zeros((len(tokens), 3))).collect()
    # a job's own token vectors and memory that is too small for them
    old, E.TOKENS_KNOWN = E.TOKENS_KNOWN, 5
    try:
        assert np.allclose({r.n: r.embedding for r in E.embed_as(docs, "text", "subword-20").collect()}[6], plain(texts[5][1]))
    finally:
        E.TOKENS_KNOWN = old
