"""Quality rules: repetition coverage by rolling hashes in numpy.

For every text, words are runs of non-space characters.  Rolling hashes of
5 to 10 words mark the windows that occur twice or more in the same text;
each length's coverage is the number of characters in words inside such
windows, and the lines' coverage the characters in lines that equal an
earlier line.  A text is kept if it passes the base rules and every
coverage stays within its share of the word characters.

Memory is bounded by one slice (2 MB of text) or one single longer text;
there is no shuffle.

Nulls and empty texts have no words: all counts 0, base_failed, not kept.
Repeated rows give one row each.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import numtext as nt
from quarry.llm.common import exact, text_column

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: n-gram length -> largest percentage of word characters inside duplicated n-grams
MAX_COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MAX_DUP_LINE_PERCENT = 30
MAX_DUP_LINE_CHAR_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "n_lines",
          *[f"dup_{n}_chars" for n in MAX_COVERAGE]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, equals an earlier one) for each key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def covered(h: np.ndarray, doc: np.ndarray, n: int, c: np.ndarray | None = None) -> np.ndarray:
    """Words that lie in a window of n words found twice or more in their text."""
    out = np.zeros(len(h), bool)
    if len(h) < n:
        return out
    whole = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1])
    if not len(whole):
        return out
    keys = nt.ngram_hashes(h, n, c)[whole] + nt.mix(doc[whole].astype(np.uint64))
    at = whole[repeated(keys)[0]]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    w = nt.words(buf, offs)
    n = w.n
    per_doc = lambda v: np.bincount(w.doc, v, n).astype(np.int64)
    chars, c = w.chars(), w.byte_prefix()
    h = w.hashes(c)
    out = {"n_words": np.diff(w.first), "word_chars": per_doc(chars)}
    sym = nt.count_below(_SYMBOL[buf])
    out["n_symbols"] = sym[offs[1:]] - sym[offs[:-1]]

    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(buf == 10)
    ls = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    le = np.sort(np.concatenate([breaks, offs[1:]]))
    ldoc = np.searchsorted(offs, ls, "right") - 1
    at = np.searchsorted(w.start, ls), np.searchsorted(w.start, le)
    ok = (at[1] > at[0]) & (le > ls)
    ls, le, ldoc, a, b = ls[ok], le[ok], w.doc[at[0][ok]], at[0][ok], at[1][ok]
    later = repeated(nt.span_hash(c, ls, le, nt.BYTE_BASE) + nt.mix(ldoc.astype(np.uint64)))[1]
    below = nt.count_below(chars)
    out["n_lines"] = np.bincount(ldoc, minlength=n)
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=n)
    out["dup_line_chars"] = np.bincount(ldoc[later], (below[b] - below[a])[later], n).astype(np.int64)

    # a duplicated longer window holds a duplicated window of five words
    five = covered(h, w.doc, 5)
    out["n_repeat_words"] = per_doc(five)
    out["dup_5_chars"] = per_doc(five * chars)
    some = np.bincount(w.doc, five, n) > 0
    part = some[w.doc]
    hp, dp, cp = h[part], w.doc[part], chars[part]
    sums = nt.ngram_prefix(hp)
    for k in MAX_COVERAGE:
        if k > 5:
            out[f"dup_{k}_chars"] = np.bincount(dp, covered(hp, dp, k, sums) * cp, n).astype(np.int64)
    return out


def coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the counts of ``COUNTS``."""
    docs = exact(docs, id_col, text_col)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches):
        for b in batches:
            for i, j, buf, offs in nt.slices(b.column(1)):
                m = measures(buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *[pa.array(m[c], pa.int64()) for c in COUNTS]], [id_col, *COUNTS])

    return docs.select(F.col(id_col), text_column(docs, text_col).alias("text")).mapInArrow(run, schema)


def judged(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    bad = ((F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT)
           | (F.col("dup_line_chars") * 100 > F.col("word_chars") * MAX_DUP_LINE_CHAR_PERCENT))
    for n, most in MAX_COVERAGE.items():
        bad = bad | (F.col(f"dup_{n}_chars") * 100 > F.col("word_chars") * most)
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed`` and the verdict ``kept`` of every document."""
    return judged(coverage(docs, id_col, text_col))


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows, from the words' strings."""
    spaces = r"[^\x20\x09-\x0D]+"
    grams = "\n".join(
        f"""      , g{n} AS (SELECT r, i FROM gr WHERE g{n} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g{n}) > 1)
        , c{n} AS (SELECT r, count(*) AS words, sum(chars) AS chars FROM gr
              JOIN (SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM g{n}) USING (r, i) GROUP BY r)"""
        for n in MAX_COVERAGE)
    windows = ", ".join("w" + "".join(f" || ' ' || lead(w, {k}) OVER o" for k in range(1, n)) + f" AS g{n}" for n in MAX_COVERAGE)
    cols = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}_chars" for n in MAX_COVERAGE)
    joins = " ".join(f"LEFT JOIN c{n} USING (r)" for n in MAX_COVERAGE)
    bad = " OR ".join([f"dup_{n}_chars * 100 > word_chars * {m}" for n, m in MAX_COVERAGE.items()]
                      + [f"n_dup_lines * 100 > n_lines * {MAX_DUP_LINE_PERCENT}",
                         f"dup_line_chars * 100 > word_chars * {MAX_DUP_LINE_CHAR_PERCENT}"])
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)
      , w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{spaces}') AS ws FROM d)
      , n AS (SELECT *, len(ws) AS n_words FROM w)
      , pos AS (SELECT r, unnest(ws) AS w, unnest(range(1, n_words + 1)) AS i FROM n)
      , gr AS (SELECT r, i, len(w) AS chars, {windows} FROM pos WINDOW o AS (PARTITION BY r ORDER BY i))
      , ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      , lw AS (SELECT r, line, len(array_to_string(regexp_extract_all(line, '{spaces}'), '')) AS chars FROM ln)
      , lc AS (SELECT r, line, chars, count(*) AS c FROM lw WHERE chars > 0 GROUP BY ALL)
      , ls AS (SELECT r, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines,
                      sum((c - 1) * chars)::BIGINT AS dup_line_chars FROM lc GROUP BY r)
{grams}
      , m AS (SELECT doc_id, n_words::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
                len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c5.words, 0)::BIGINT AS n_repeat_words,
                coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {cols}
              FROM n LEFT JOIN ls USING (r) {joins})
      , j AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT ({bad}) AS kept, dup_line_chars, {", ".join(f"dup_{n}_chars" for n in MAX_COVERAGE)} FROM j"""
