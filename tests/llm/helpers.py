"""Inputs shared by the operators' tests."""
from __future__ import annotations

import duckdb

from tests.conftest import SF_SMALL
from tests.oracle_check import TABLES, digest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))

#: nulls, empty and very long texts, ties, repeated rows, copies
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (3, None), (4, ""), (5, " \n\t "), (None, "a row without an id"), (6, LONG), (7, "Ünïcode straße 日本語 😀 it's"),
    (8, "same line\nsame line\nsame line\nother words here to make it long enough for the rules"), (9, "one"),
]


def documents(spark, rows=TEXTS):
    """With columns whose names differ by case or are used inside the operators."""
    data = [(i, t, "en", "src0", len(t or ""), "x", 1, 2, 3, 4.0, "y") for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, fp int, g int, label int, score double, _0 string")


def same(df, sql: str, views: dict) -> None:
    """The rows of ``df`` equal the SQL's over the views (name -> DataFrame)."""
    con = duckdb.connect()
    for name, v in views.items():
        con.register(f"_{name}", v.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    res = con.execute(sql)
    cols, rows = [d[0] for d in res.description], res.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(rows)
    assert digest(df.columns, got) == digest(cols, rows)


__all__ = ["LONG", "SF_SMALL", "TABLES", "TEXTS", "documents", "same"]
