import os

from quarry.operators import index as IX
from quarry.streaming import ingest


def _write(d, name, text):
    with open(os.path.join(d, name), "w") as f:
        f.write(text)


def test_chunk_ingest_two_runs_and_archive(spark, tmp):
    staged, arch, out, ck = (os.path.join(tmp, x) for x in ("staged", "archive", "out", "ck"))
    os.makedirs(staged)
    os.makedirs(arch)
    _write(staged, "a.txt", "First doc. " * 30)
    _write(staged, "b.txt", "Second doc! " * 10)
    _write(staged, "c.pdf", "not text input")
    q = ingest.start_chunk_ingest(ingest.staged_text(spark, staged, "archive", arch), out, ck)
    q.awaitTermination(120)
    first = spark.read.parquet(out)
    assert {os.path.basename(p) for (p,) in first.select("doc_id").distinct().collect()} == {"a.txt", "b.txt"}
    n1 = first.count()
    # second run: only the new file is read
    _write(staged, "d.txt", "Third one? " * 5)
    q = ingest.start_chunk_ingest(ingest.staged_text(spark, staged, "archive", arch), out, ck)
    q.awaitTermination(120)
    second = spark.read.parquet(out)
    docs = [os.path.basename(p) for (p,) in second.select("doc_id").collect()]
    assert sorted(set(docs)) == ["a.txt", "b.txt", "d.txt"]
    assert second.count() == n1 + 1
    # consumed files were archived (the last one may move one batch late)
    archived = [f for _, _, fs in os.walk(arch) for f in fs]
    assert "a.txt" in archived or "b.txt" in archived


def test_pdf_rejects(spark, tmp):
    staged, out, rej, ck = (os.path.join(tmp, x) for x in ("staged", "out", "rej", "ck"))
    os.makedirs(staged)
    _write(staged, "good.pdf", "Readable words here. More words!")
    with open(os.path.join(staged, "bad.pdf"), "wb") as f:
        f.write(b"\xff\xfe\xfa broken")
    _write(staged, "skip.PDF", "wrong case suffix is not picked up")
    q = ingest.start_chunk_ingest(ingest.staged_pdfs(spark, staged), out, ck, route="pdf", reject_dir=rej)
    q.awaitTermination(120)
    for s in spark.streams.active:
        s.awaitTermination(120)
    got = spark.read.parquet(out)
    assert [os.path.basename(p) for (p,) in got.select("doc_id").distinct().collect()] == ["good.pdf"]
    bad = spark.read.parquet(rej).collect()
    assert [os.path.basename(r.path) for r in bad] == ["bad.pdf"] and "Decode" in bad[0].error


def test_index_ingest_both_stores(spark, tmp):
    staged, a, b, ck = (os.path.join(tmp, x) for x in ("staged", "a", "b", "ck"))
    os.makedirs(staged)
    _write(staged, "x.txt", "Alpha beta gamma. " * 40)
    _write(staged, "y.txt", "Alpha beta gamma. " * 40)   # same text: same keys
    ingest.start_index_ingest(ingest.staged_text(spark, staged), a, b, ck).awaitTermination(120)
    ia, ib = IX.read_index(spark, a), IX.read_index(spark, b)
    assert ia.count() == ia.select("id").distinct().count() > 0
    assert ib.count() == ib.select("id").distinct().count() > 0
    before = sorted(r.id for r in ib.collect())
    # replaying the same batch id is skipped (idempotent)
    df = spark.createDataFrame([("/p/x.txt", "Alpha beta gamma. " * 40)], "path string, text string")
    ingest.index_batch(df, 0, a, b, stream=ingest.stream_id(spark, ck))
    assert sorted(r.id for r in IX.read_index(spark, b).collect()) == before


def test_upload_chain(spark, tmp):
    d = {x: os.path.join(tmp, x) for x in ("staged", "arch", "chunks", "rej", "a", "b", "ck")}
    os.makedirs(d["staged"])
    os.makedirs(d["arch"])
    _write(d["staged"], "one.pdf", "First line.\nSecond line! " * 50)
    _write(d["staged"], "two.pdf", "Other words here? " * 20)
    with open(os.path.join(d["staged"], "bad.pdf"), "wb") as f:
        f.write(b"\xff\xfe\xfa")
    q = ingest.start_upload_chain(spark, d["staged"], d["arch"], d["chunks"], d["rej"], d["a"], d["b"], d["ck"])
    q.awaitTermination(180)
    assert q.exception() is None
    ch = spark.read.parquet(d["chunks"])
    assert {os.path.basename(p) for (p,) in ch.select("doc_id").distinct().collect()} == {"one.pdf", "two.pdf"}
    assert [os.path.basename(r.path) for r in spark.read.parquet(d["rej"]).collect()] == ["bad.pdf"]
    a, b = IX.read_index(spark, d["a"]), IX.read_index(spark, d["b"])
    assert a.count() > 0 and b.count() > 0
    # same chunk set in both stores: every second-store document is a chunk text
    texts = {r.text for r in ch.collect()}
    assert {r.document for r in b.collect()} <= texts


def test_index_ingest_second_run_adds_only_new(spark, tmp):
    staged, a, b, ck = (os.path.join(tmp, x) for x in ("staged", "a", "b", "ck"))
    os.makedirs(staged)
    _write(staged, "x.txt", "Alpha beta gamma. " * 40)
    ingest.start_index_ingest(ingest.staged_text(spark, staged), a, b, ck).awaitTermination(120)
    n_a, n_b = IX.read_index(spark, a).count(), IX.read_index(spark, b).count()
    v_b = IX._versions(spark, b)
    _write(staged, "z.txt", "Delta epsilon zeta! " * 40)
    ingest.start_index_ingest(ingest.staged_text(spark, staged), a, b, ck).awaitTermination(120)
    ib = IX.read_index(spark, b)
    assert IX._versions(spark, b) == v_b + [v_b[-1] + 1]      # exactly one new version
    assert ib.count() > n_b and IX.read_index(spark, a).count() > n_a
    assert sorted(set(r.batch_no for r in ib.collect())) == [0, 1]  # x from batch 0, z from batch 1


def test_index_ingest_into_partitioned_tables(spark, tmp):
    import uuid
    staged, ck = os.path.join(tmp, "staged"), os.path.join(tmp, "ck")
    os.makedirs(staged)
    ta, tb = "ta_" + uuid.uuid4().hex[:6], "tb_" + uuid.uuid4().hex[:6]
    _write(staged, "x.txt", "Alpha beta gamma. " * 40)
    ingest.start_index_ingest_tables(ingest.staged_text(spark, staged), ta, tb, ck, buckets=16).awaitTermination(120)
    n_a, n_b = spark.table(ta).count(), spark.table(tb).count()
    _write(staged, "z.txt", "Delta epsilon zeta! " * 40)
    ingest.start_index_ingest_tables(ingest.staged_text(spark, staged), ta, tb, ck, buckets=16).awaitTermination(120)
    # the stream merged from its own session: refresh this session's listing
    spark.catalog.refreshTable(ta)
    spark.catalog.refreshTable(tb)
    a, b = spark.table(ta), spark.table(tb)
    assert a.count() > n_a and b.count() > n_b
    assert a.count() == a.select("id").distinct().count() and b.count() == b.select("id").distinct().count()
    # replaying a batch changes nothing
    before = sorted(r.id for r in b.collect())
    ingest.index_batch_tables(spark.createDataFrame([(os.path.join(staged, "z.txt"), "Delta epsilon zeta! " * 40)],
                                                    "path string, text string"), 1, ta, tb, 16)
    assert sorted(r.id for r in spark.table(tb).collect()) == before


def test_failure_stops_the_chain_and_restart_completes(spark, tmp):
    staged, b, ck = (os.path.join(tmp, x) for x in ("staged", "b", "ck"))
    os.makedirs(staged)
    _write(staged, "x.txt", "Alpha beta gamma. " * 40)
    blocked = os.path.join(tmp, "blocked")
    _write(tmp, "blocked", "a file where the first store's folder should be")
    q = ingest.start_index_ingest(ingest.staged_text(spark, staged), blocked, b, ck)
    try:
        q.awaitTermination(120)
    except Exception:  # noqa: BLE001 - the batch error surfaces here
        pass
    assert q.exception() is not None                      # X3: the failure stopped the query
    assert not IX.index_exists(spark, b)                  # nothing of the failed batch is visible
    # restart on the same checkpoint with a usable folder: the batch is redone
    a = os.path.join(tmp, "a")
    ingest.start_index_ingest(ingest.staged_text(spark, staged), a, b, ck).awaitTermination(120)
    ia, ib = IX.read_index(spark, a), IX.read_index(spark, b)
    assert ia.count() > 0 and ib.count() == ib.select("id").distinct().count() > 0


def test_a_second_stream_adds_to_the_same_stores(spark, tmp):
    import os
    from quarry.operators import index as IX
    from quarry.streaming import ingest
    for k in ("one", "two"):
        os.makedirs(f"{tmp}/{k}")
        for i in range(2):
            with open(f"{tmp}/{k}/{i}.txt", "w") as f:
                f.write(f"A common heading that every staged file of this lab begins with, number {k} {i}.")
        src = ingest.staged_text(spark, f"{tmp}/{k}")
        ingest.start_index_ingest(src, f"{tmp}/first", f"{tmp}/second", f"{tmp}/ck-{k}").awaitTermination()
    assert IX.read_index(spark, f"{tmp}/first").count() == 4
    assert IX.read_index(spark, f"{tmp}/second").count() == 4       # not one for each 50-character heading


def test_chunks_and_rejects_come_from_one_query(spark, tmp):
    import os
    from quarry.streaming import ingest
    os.makedirs(f"{tmp}/in")
    for i in range(3):
        with open(f"{tmp}/in/{i}.pdf", "wb") as f:
            f.write(b"\xff\xfe" if i == 1 else f"text {i}.".encode())
    ingest.start_chunk_ingest(ingest.staged_pdfs(spark, f"{tmp}/in"), f"{tmp}/out", f"{tmp}/ck", "pdf", f"{tmp}/rej").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp}/out").collect()) == ["text 0.", "text 2."]
    assert [os.path.basename(r.path) for r in spark.read.parquet(f"{tmp}/rej").collect()] == ["1.pdf"]
