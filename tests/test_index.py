import os

from pyspark.sql import functions as F

from quarry.operators import index as IX

SCHEMA = "id string, file_path string, embedding array<double>, embedding_model string, batch_no int"


def _rows(df):
    return sorted((r.id, r.file_path, r.batch_no) for r in df.collect())


def test_upsert_last_writer_wins(spark):
    old = spark.createDataFrame([("k1", "/a", [1.0], "m", 0), ("k2", "/b", [1.0], "m", 0)], SCHEMA)
    new = spark.createDataFrame([("k1", "/c", [2.0], "m", 1), ("k3", "/d", [1.0], "m", 1),
                                 ("k3", "/e", [1.0], "m", 1)], SCHEMA)
    got = IX.upsert(old, new)
    assert _rows(got) == [("k1", "/c", 1), ("k2", "/b", 0), ("k3", "/e", 1)]
    # idempotent: applying the same batch again changes nothing
    assert _rows(IX.upsert(got, new)) == _rows(got)
    # a later load wins even with a lower batch number and a smaller path
    late = spark.createDataFrame([("k1", "/0", [3.0], "m", -5)], SCHEMA)
    assert _rows(IX.upsert(got, late)) == [("k1", "/0", -5), ("k2", "/b", 0), ("k3", "/e", 1)]


def test_insert_if_absent_keeps_existing(spark):
    old = spark.createDataFrame([("k1", "/a", [1.0], "m", 0)], SCHEMA)
    new = spark.createDataFrame([("k1", "/z", [9.0], "m", 1), ("k2", "/y", [1.0], "m", 1),
                                 ("k2", "/x", [2.0], "m", 1)], SCHEMA)
    got = IX.insert_if_absent(old, new, order=("batch_no", "file_path"))
    assert _rows(got) == [("k1", "/a", 0), ("k2", "/x", 1)]
    assert _rows(IX.insert_if_absent(got, new, order=("batch_no", "file_path"))) == _rows(got)


def test_keys(spark):
    df = spark.createDataFrame([(None, "x" * 80), ("/p.txt", "y" * 80)], "path string, text string")
    got = [r.k for r in df.select(IX.second_store_key(F.col("path"), F.col("text")).alias("k")).collect()]
    assert got == ["x" * 50, "/p.txt"]
    t = spark.createDataFrame([("é" * 600,)], "text string")
    assert len(t.select(IX.first_store_key(F.col("text")).alias("k")).first().k) == 512


def test_versioned_store(spark, tmp):
    base = os.path.join(tmp, "idx")
    empty = IX.create_if_absent(spark, base, IX.FIRST_STORE_SCHEMA)
    assert empty.count() == 0
    assert IX.create_if_absent(spark, base, IX.FIRST_STORE_SCHEMA).count() == 0  # exists: kept
    b = spark.createDataFrame([("k", "/a", {"file_path": "/a"}, [1.0, 0.0], "m", 1)],
                              "id string, file_path string, metadata map<string,string>, "
                              "embedding array<double>, embedding_model string, batch_no int")
    IX.write_index(IX.upsert(IX.read_index(spark, base), b), base)
    cur = IX.read_index(spark, base)
    assert cur.count() == 1
    st = IX.stats(cur).first()
    assert (st.total_vector_count, st.min_dim, st.max_dim) == (1, 2, 2)
    IX.drop_index(spark, base)
    assert not IX.index_exists(spark, base)


def test_dimension_check(spark):
    import pytest
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="dimension must be 3"):
        IX.check_dimension(df, 3).collect()


def test_bucketed_merges_match_dataframe_rules(spark, tmp):
    import uuid
    name = "idx_" + uuid.uuid4().hex[:8]
    old = spark.createDataFrame([("k1", "/a", [1.0], "m", 0), ("k2", "/b", [1.0], "m", 0)], SCHEMA)
    new = spark.createDataFrame([("k1", "/c", [2.0], "m", 1), ("k3", "/d", [1.0], "m", 1),
                                 ("k3", "/e", [1.0], "m", 1)], SCHEMA)
    IX.merge_bucketed(spark, name, old, 4)
    t = IX.merge_bucketed(spark, name, new, 4)
    assert _rows(spark.table(t)) == _rows(IX.upsert(old, new))
    # the merge plan reads the bucketed index without an exchange on its side
    cur = spark.table(IX.latest_table(spark, name))
    assert cur.count() == 3
    name2 = "ins_" + uuid.uuid4().hex[:8]
    IX.merge_bucketed(spark, name2, old, 4, rule="insert")
    t2 = IX.merge_bucketed(spark, name2, new, 4, rule="insert")
    exp = IX.insert_if_absent(old, new, order=("batch_no", "file_path"))
    assert _rows(spark.table(t2)) == _rows(exp)


def test_list_indexes(spark, tmp):
    base = os.path.join(tmp, "root")
    IX.create_if_absent(spark, os.path.join(base, "a"), IX.FIRST_STORE_SCHEMA)
    IX.create_if_absent(spark, os.path.join(base, "b"), IX.SECOND_STORE_SCHEMA)
    got = {(r.name, r.kind, r.versions) for r in IX.list_indexes(spark, base).collect() if r.kind == "folder"}
    assert got == {("a", "folder", 1), ("b", "folder", 1)}


def test_partial_version_is_skipped(spark, tmp):
    base = os.path.join(tmp, "idx")
    IX.create_if_absent(spark, base, IX.FIRST_STORE_SCHEMA)
    os.makedirs(os.path.join(base, "v000001"))          # a write that died: no _SUCCESS
    assert IX._versions(spark, base) == [0]
    b = spark.createDataFrame([("k", "/a", {"file_path": "/a"}, [1.0], "m", 1)],
                              "id string, file_path string, metadata map<string,string>, "
                              "embedding array<double>, embedding_model string, batch_no int")
    out = IX.write_index(IX.upsert(IX.read_index(spark, base), b), base)
    assert out.endswith("v000002") and IX.read_index(spark, base).count() == 1


def test_partitioned_merge_rewrites_only_touched_buckets(spark, tmp):
    import uuid
    name = "pidx_" + uuid.uuid4().hex[:8]
    old_rows = [(f"k{i}", f"/p{i}", [1.0], "m", 0) for i in range(40)]
    old = spark.createDataFrame(old_rows, SCHEMA)
    IX.merge_partitioned(spark, name, old, 8)
    loc = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first().data_type
    root = loc.replace("file:", "")

    def stamps():
        out = {}
        for d in os.listdir(root):
            if d.startswith("bucket="):
                out[d] = sorted(os.path.getmtime(os.path.join(root, d, f)) for f in os.listdir(os.path.join(root, d)))
        return out
    before = stamps()
    new = spark.createDataFrame([("k1", "/z", [2.0], "m", 1), ("new", "/n", [1.0], "m", 1)], SCHEMA)
    IX.merge_partitioned(spark, name, new, 8)
    after = stamps()
    touched = {f"bucket={r.b}" for r in new.select(IX.bucket_of(F.col("id"), 8).alias("b")).collect()}
    assert all(before[d] == after[d] for d in before if d not in touched)     # untouched files kept
    assert _rows(spark.table(name)) == _rows(IX.upsert(old, new))
    # insert rule: existing k1 is kept
    name2 = "pins_" + uuid.uuid4().hex[:8]
    IX.merge_partitioned(spark, name2, old, 8, rule="insert")
    IX.merge_partitioned(spark, name2, new, 8, rule="insert")
    assert _rows(spark.table(name2)) == _rows(IX.insert_if_absent(old, new, order=("batch_no", "file_path")))


def test_merges_let_the_batch_win(spark, tmp):
    old = spark.createDataFrame([("k1", "/z", [1.0], "m", 3), ("k2", "/b", [1.0], "m", 0)], SCHEMA)
    new = spark.createDataFrame([("k1", "/a", [2.0], "m", 0), ("k3", "/d", [1.0], "m", 0)], SCHEMA)
    want = [("k1", "/a", 0), ("k2", "/b", 0), ("k3", "/d", 0)]
    IX.write_bucketed(old, "win_b", 4)
    assert _rows(spark.table(IX.merge_bucketed(spark, "win_b", new, 4))) == want
    IX.merge_partitioned(spark, "win_p", old, 4)
    IX.merge_partitioned(spark, "win_p", new, 4)
    assert _rows(spark.table("win_p")) == want
