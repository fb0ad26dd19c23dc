"""Sentence-aware greedy chunking.

Rule, for words ``w[0..n-1]`` and a start ``s`` (first ``s = 0``):

1. ``e = s + step``; if ``e >= n`` then ``e = n - 1``.
2. If some ``i`` in ``(s, e]`` has a word ending in ``.``, ``!`` or ``?``,
   ``e`` becomes the largest such ``i``; otherwise the cut is hard at ``e``.
3. Emit ``w[s..e]`` (end inclusive, so up to ``step + 1`` words).  Stop when
   ``e >= n - 1``, else continue at ``s = e + 1``.

Plan shape: a narrow map, no shuffle, no Python.  Cleaning, splitting,
finding the sentence ends and the sequential cut rule (one ``aggregate``
fold over the sentence-end positions, see ``cut_ends``) are native
expressions.  Chunk texts are built inside ``transform`` before the explode
so the word array is never copied into every chunk row.  ``chunk_ends`` is
the same rule in plain Python, kept as the executable statement of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: the reference steps 500 words from each chunk start.
CHUNK_STEP = 500


def chunk_ends(n: int, bounds: np.ndarray, step: int = CHUNK_STEP) -> list[int]:
    """End positions (inclusive) of every chunk of an ``n``-word document.

    ``bounds`` are the sorted positions of sentence-ending words.
    """
    ends: list[int] = []
    s = 0
    while s < n:
        e = min(s + step, n - 1)
        j = int(np.searchsorted(bounds, e, side="right")) - 1
        if j >= 0 and bounds[j] > s:
            e = int(bounds[j])
        ends.append(e)
        s = e + 1
    return ends


def cut_ends(n: Column, bounds: Column, step: int = CHUNK_STEP) -> Column:
    """Chunk end positions as a native fold over the sentence ends.

    ``bounds`` are the ascending sentence-end positions of an ``n``-word
    document.  The fold carries the current chunk start ``s``, the best cut
    seen inside its window ``c`` (−1 for none) and the ends so far.  A
    sentence end beyond the window closes the chunk (at ``c``, or a hard cut
    at ``s + step``), followed in closed form by the hard cuts needed to
    reach it; after the last sentence end the tail is cut the same way.  One
    pass, O(sentence ends + chunks) per document, all inside the JVM.
    """
    w = step + 1                       # words per full chunk
    init = F.struct(F.lit(0).alias("s"), F.lit(-1).alias("c"),
                    F.array().cast("array<int>").alias("ends"))

    def hard(start, h):
        # ends of h hard-cut chunks starting at `start`
        return F.transform(F.slice(F.sequence(F.lit(0), h), 1, h), lambda j: start + w * j + step)

    def merge(acc, b):
        s_, c_ = acc["s"], acc["c"]
        end1 = F.when(c_ >= 0, c_).otherwise(s_ + step)
        s1 = end1 + 1
        h = F.greatest(F.lit(0), F.ceil((b - s1 - step) / F.lit(w)).cast("int"))
        s2 = s1 + w * h
        fits = b <= F.least(s_ + step, n - 1)
        return F.when(fits, F.struct(s_.alias("s"), F.when(b > s_, b).otherwise(c_).alias("c"),
                                     acc["ends"].alias("ends"))) \
            .otherwise(F.struct(s2.alias("s"), F.when(b > s2, b).otherwise(F.lit(-1)).alias("c"),
                                F.concat(acc["ends"], F.array(end1), hard(s1, h)).alias("ends")))

    def finish(acc):
        s_, c_ = acc["s"], acc["c"]
        end0 = F.when(c_ >= 0, c_).otherwise(F.least(s_ + step, n - 1))
        s1 = end0 + 1
        t = F.greatest(F.lit(0), F.ceil((n - s1) / F.lit(w)).cast("int"))
        tail = F.transform(F.slice(F.sequence(F.lit(0), t), 1, t), lambda j: F.least(s1 + w * j + step, n - 1))
        return F.when(s_ <= n - 1, F.concat(acc["ends"], F.array(end0), tail)).otherwise(acc["ends"])

    return F.aggregate(F.coalesce(bounds, F.array().cast("array<int>")), init, merge, finish)


def chunk_id(doc_id: Column, chunk_ix: Column) -> Column:
    """Deterministic id ``sha256('<doc_id>:<chunk_ix>')`` (not random)."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), chunk_ix.cast("string")), 256)


def prepare_words(df: DataFrame, text_col: str = "text", route: str = "txt") -> DataFrame:
    """Add ``words``: C5 (``pdf`` route only) → C4 → C6."""
    c = F.col(text_col)
    if route == "pdf":
        c = T.normalise_lines(c)
    elif route != "txt":
        raise ValueError("route must be 'txt' or 'pdf'")
    return df.withColumn("words", T.split_words(T.clean_for_chunking(c)))


def chunk(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          route: str = "txt", step: int = CHUNK_STEP, keep: list[str] | None = None) -> DataFrame:
    """Documents → ``chunks(doc_id, chunk_ix, start_word, end_word, n_words, text, chunk_id)``.

    ``keep`` lists extra document columns to carry onto each chunk row.
    """
    keep = list(keep or [])
    w = prepare_words(df.select(id_col, text_col, *keep), text_col, route)
    w = w.withColumn("_n", F.size("words")).withColumn(
        "_ends", cut_ends(F.col("_n"), T.sentence_end_positions(F.col("words")), step))
    spans = F.transform(
        F.col("_ends"),
        lambda e, i: F.struct(
            i.alias("chunk_ix"),
            F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("_ends"), i) + 1).alias("start_word"),
            e.alias("end_word")))
    spans = F.transform(
        spans,
        lambda s: F.struct(
            s["chunk_ix"].alias("chunk_ix"), s["start_word"].alias("start_word"),
            s["end_word"].alias("end_word"),
            F.array_join(F.slice(F.col("words"), s["start_word"] + 1,
                                 s["end_word"] - s["start_word"] + 1), " ").alias("text")))
    out = (w.select(F.col(id_col), *keep, F.explode(spans).alias("c"))
           .select(F.col(id_col), *keep,
                   F.col("c.chunk_ix").alias("chunk_ix"),
                   F.col("c.start_word").alias("start_word"),
                   F.col("c.end_word").alias("end_word"),
                   (F.col("c.end_word") - F.col("c.start_word") + 1).alias("n_words"),
                   F.col("c.text").alias("text")))
    # an empty chunk is skipped (cannot happen after C6, kept as a guard).
    out = out.filter(F.trim(F.col("text")) != "")
    return out.withColumn("chunk_id", chunk_id(F.col(id_col), F.col("chunk_ix")))


def chunk_counts(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks per document (partial aggregation before the shuffle)."""
    return chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"),
                                      F.max("n_words").alias("max_words"))
