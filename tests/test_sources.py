import os

import pytest

from quarry.plans.pages import link_lines
from quarry.sources import files


def _w(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_text_corpus_recursive_and_flat(spark, tmp):
    _w(f"{tmp}/a/x.txt", "one\ntwo")
    _w(f"{tmp}/a/b/y.txt", "three")
    _w(f"{tmp}/a/z.md", "skip")
    rows = files.text_corpus(spark, f"{tmp}/a").collect()
    assert all(r.path.startswith("/") for r in rows)          # absolute path, not a file: URI
    rec = {os.path.relpath(r.path, tmp): r.text for r in rows}
    assert rec == {"a/x.txt": "one\ntwo", "a/b/y.txt": "three"}
    flat = [r.path for r in files.text_corpus(spark, f"{tmp}/a", recursive=False).collect()]
    assert [os.path.basename(p) for p in flat] == ["x.txt"]


def test_staged_text_errors(spark, tmp):
    with pytest.raises(FileNotFoundError):
        files.staged_text_batch(spark, f"{tmp}/missing")
    os.makedirs(f"{tmp}/empty")
    _w(f"{tmp}/empty/a.pdf", "x")
    with pytest.raises(FileNotFoundError):
        files.staged_text_batch(spark, f"{tmp}/empty")


def test_pdf_batch(spark, tmp):
    _w(f"{tmp}/s/ok.pdf", "Some text.")
    _w(f"{tmp}/s/bad.pdf", "x")
    _w(f"{tmp}/s/up.PDF", "not picked")

    def extract(b: bytes) -> str:
        if b == b"x":
            raise ValueError("unreadable")
        return b.decode()
    got = {os.path.basename(r.path): (r.text, r.error) for r in files.pdf_batch(spark, f"{tmp}/s", extract).collect()}
    assert got == {"ok.pdf": ("Some text.", None), "bad.pdf": (None, "ValueError: unreadable")}


def test_link_lines(spark, tmp):
    _w(f"{tmp}/links.txt", "https://a.com/x.html\n\n  https://b.com/y  \n\t\n")
    assert [r.url for r in link_lines(spark, f"{tmp}/links.txt").collect()] == ["https://a.com/x.html", "https://b.com/y"]


def test_overwrite_and_append(spark, tmp):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(2, "y")], "id int, t string")
    files.write_overwrite(a, f"{tmp}/o")
    files.write_overwrite(b, f"{tmp}/o")
    assert [r.id for r in spark.read.parquet(f"{tmp}/o").collect()] == [2]      # K1: replaced
    files.write_append(a, f"{tmp}/c")
    files.write_append(b, f"{tmp}/c")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp}/c").collect()) == [1, 2]  # K2: kept


def test_page_file_rules(spark, tmp):
    """First visit per URL (F2); when two URLs map to one file (N5 drops
    '.html') the later first visit wins (K1)."""
    from quarry.plans import pages as PG
    rows = [(1, "https://h.com/a/doc.html", "<p>one</p>"),
            (2, "https://h.com/a/doc", "<p>two</p>"),
            (3, "https://h.com/a/doc.html", "<p>three</p>"),     # repeat: first visit is page 1
            (4, "HTTP://h.com/x", "<p>bad scheme</p>"),
            (5, "  https://h.com/b  ", "<p>five</p>")]
    d = f"{tmp}/sf"
    os.makedirs(d)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    got = {r.path: (r.url, r.page_id, r.text) for r in PG.page_text(spark, d).collect()}
    assert got == {"/data/https:/h.com/a/doc.txt": ("https://h.com/a/doc", 2, "two"),
                   "/data/https:/h.com/b.txt": ("https://h.com/b", 5, "five")}


def test_paths_with_odd_names(spark, tmp):
    import os
    names = ["a b.txt", "50%.txt", "c+d.txt", "ü%20.txt"]
    for n in names:
        with open(os.path.join(tmp, n), "w") as f:
            f.write(n)
    got = {r.path: r.text for r in files.text_corpus(spark, tmp).collect()}
    assert got == {os.path.join(tmp, n): n for n in names}
    got = {r.path: r.text for r in files.staged_text_batch(spark, tmp).collect()}
    assert got == {os.path.join(tmp, n): n for n in names}
    os.rename(os.path.join(tmp, names[0]), os.path.join(tmp, "a +ü%.pdf"))
    assert [r.path for r in files.pdf_batch(spark, tmp, lambda b: b.decode()).collect()] == [os.path.join(tmp, "a +ü%.pdf")]
