import os

from quarry.__main__ import main
from quarry.operators import index as IX


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_cli_end_to_end(spark, tmp):
    pages = spark.createDataFrame(
        [("https://a.example.com/x/doc.html", "<html><title>T</title><p>Apache Iceberg is a table format.</p></html>"),
         ("https://a.example.com/y", "<p>ML runtimes run models.</p>"),
         ("bad-url", "<p>skip</p>")], "url string, html string")
    pages.write.parquet(f"{tmp}/pages.parquet")
    main(["pages", "--pages", f"{tmp}/pages.parquet", "--out", f"{tmp}/text"])
    txt = {r.path: r.text for r in spark.read.parquet(f"{tmp}/text").collect()}
    assert txt == {"/data/https:/a.example.com/x/doc.txt": "TApache Iceberg is a table format.",
                   "/data/https:/a.example.com/y.txt": "ML runtimes run models."}

    _w(f"{tmp}/staged/s.txt", "First sentence here. Second one! " * 30)
    main(["chunk", "--staged", f"{tmp}/staged", "--out", f"{tmp}/chunks", "--checkpoint", f"{tmp}/ck"])
    assert spark.read.parquet(f"{tmp}/chunks").count() >= 1

    _w(f"{tmp}/data/a.txt", "Apache Iceberg is an open table format for huge analytic datasets.")
    _w(f"{tmp}/data/sub/b.txt", "ML runtimes are container images for running models.")
    for store in ("first", "second"):
        main(["index", "--docs", f"{tmp}/data", "--store", store, "--index", f"{tmp}/idx_{store}"])
        main(["index", "--docs", f"{tmp}/data", "--store", store, "--index", f"{tmp}/idx_{store}", "--batch", "1"])
        assert IX.read_index(spark, f"{tmp}/idx_{store}").count() == 2
    _w(f"{tmp}/q.txt", "What is Apache Iceberg?\n\nWhat are ML runtimes?\n")
    main(["ask", "--index", f"{tmp}/idx_second", "--store", "second", "--questions", f"{tmp}/q.txt",
          "--out", f"{tmp}/hits", "--k", "1"])
    hits = {r.question: os.path.basename(r.id) for r in spark.read.parquet(f"{tmp}/hits").collect()}
    assert hits == {"What is Apache Iceberg?": "a.txt", "What are ML runtimes?": "b.txt"}


def test_cli_subword_index_compaction_and_rejects(spark, tmp):
    from quarry.operators import store as ST
    _w(f"{tmp}/data/a.txt", "Apache Iceberg is an open table format for huge analytic datasets.")
    _w(f"{tmp}/data/b.txt", "ML runtimes are container images for running models.")
    for batch in ("0", "1"):
        main(["index", "--docs", f"{tmp}/data", "--store", "first", "--index", f"{tmp}/idx/one", "--embedder", "subword", "--dim", "32", "--batch", batch])
    m = ST.manifest(spark, f"{tmp}/idx/one")
    assert (m["model"], m["rows"], len(m["segments"])) == ("subword-32", 2, 2)
    main(["compact", "--index", f"{tmp}/idx/one", "--vacuum-days", "7"])
    assert len(ST.manifest(spark, f"{tmp}/idx/one")["segments"]) == 1
    main(["describe", "--root", f"{tmp}/idx"])
    _w(f"{tmp}/q.txt", "What is Apache Iceberg?\nWhat is Apache Iceberg?\n")
    main(["ask", "--index", f"{tmp}/idx/one", "--questions", f"{tmp}/q.txt", "--out", f"{tmp}/hits", "--k", "1"])
    assert [r.id[:6] for r in spark.read.parquet(f"{tmp}/hits").collect()] == ["Apache"]
    # a file that can't be extracted leaves a row, also without --rejects
    os.makedirs(f"{tmp}/pdf")
    with open(f"{tmp}/pdf/bad.pdf", "wb") as f:
        f.write(b"\xff\xfe\xff")
    _w(f"{tmp}/pdf/good.pdf", "One sentence. Two!")
    main(["chunk", "--pdf", "--staged", f"{tmp}/pdf", "--out", f"{tmp}/chunks", "--checkpoint", f"{tmp}/ck"])
    assert [os.path.basename(r.path) for r in spark.read.parquet(f"{tmp}/chunks-rejects").collect()] == ["bad.pdf"]
    assert spark.read.parquet(f"{tmp}/chunks").count() == 1


def test_cli_ingest_tables(spark, tmp):
    import uuid
    _w(f"{tmp}/staged/a.txt", "Alpha beta gamma. " * 30)
    t1, t2 = "c1_" + uuid.uuid4().hex[:6], "c2_" + uuid.uuid4().hex[:6]
    main(["ingest", "--staged", f"{tmp}/staged", "--checkpoint", f"{tmp}/ck", "--first-table", t1,
          "--second-table", t2, "--buckets", "8"])
    spark.catalog.refreshTable(t1)
    assert spark.table(t1).count() > 0 and spark.table(t2).count() > 0
