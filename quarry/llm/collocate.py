"""Phrase collocations by prefix-free parsing.

A text's words are cut into overlapping chunks: a chunk ends with a trigger,
a window of ``WINDOW`` words whose hash is divisible by ``EVERY`` (or after
``MOST`` words without one), and the next starts with that window.  Where a
text is cut depends on its own words only, so copies, repeated lines and
shared passages give equal chunks wherever they stand.  Chunks grouped by
language form the dictionary, with their frequency in the parse; n-grams are
counted inside distinct chunks, weighted.  Phrases of at most ``WINDOW + 1``
words lie whole in the chunk in which their last word is new, and are counted
there alone: ``fresh`` is the number of words that a chunk has in common with
the one before it.  Ends of pieces stand in a chunk as line feeds, which no
phrase crosses.  The counts are exact whatever the hashes.

Words and pairs are counted first.  Longer phrases can only be frequent where
all their pairs are, so a filter of the frequent pairs (a Bloom filter of
fixed size; what it lets through wrongly is counted and falls by its count)
goes to the tasks that count them.  The filter is the only broadcast and
never grows; nothing else leaves the executors but the result.  Within a task
words have exact numbers (Arrow's dictionary) and phrases are numbered from
those, batch by batch, before Spark's own partial sums: a hot word or passage
crosses the shuffle once for each task.

Score of a candidate: the lowest over its cuts of floor(2000000 a / (l + r)),
in decimals of 38 digits.  Null texts are empty, a null language is ``und``.
Texts without words add nothing; an empty table gives no rows.  Repeated rows
count each.  Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import numtext as nt
from quarry.llm.common import exact, stored, text_column

LEAST = 30              # a candidate's occurrences
LONGEST = 4             # words of a phrase
TOP = 2000              # rows of a language
COVERED = 80            # per cent of a phrase inside one longer candidate
WINDOW = LONGEST - 1
PARTS = 32              # of a language, ranked side by side
EVERY = 32
MOST = 512
FILTER_BITS = 1 << 26
BATCH_BYTES = 8 << 20   # chunks handed on at a time
SLICE_BYTES = 1 << 19   # texts parsed at a time
COUNT_BYTES = 1 << 19   # chunks counted at a time
OUT_ROWS = 1 << 16      # counts handed on at a time
UNKNOWN = "und"

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = _PIECE.copy()
_BREAK[[0x20, 0x09]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[0x20, 0x0A]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> pa.StringArray:
    """The spans of ``data``, which may overlap."""
    size = to - at
    stop = np.cumsum(size)
    got = data[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32)), pa.py_buffer(got))


def chunks(buf: np.ndarray, offs: np.ndarray, every: int = EVERY, most: int = MOST) -> Iterator[tuple]:
    """Chunks of the texts of one slice: (text of each, chunk strings, words in common, new words)."""
    low = _LOWER[buf]
    w = nt.words(low, offs, _BREAK)
    n = len(w.start)
    if not n:
        return
    ends_of = nt.count_below(_PIECE[low])
    size = w.end - w.start + 1
    at = np.concatenate([[0], np.cumsum(size)])               # place of each word in the joined bytes
    joined = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[inside] = low[np.repeat(w.start - at[:-1], size)[inside] + np.flatnonzero(inside)]
    joined[at[1:n][ends_of[w.start[1:]] > ends_of[w.end[:-1]]] - 1] = 0x0A
    last = w.first[1:][w.doc] - 1                             # last word of each word's text
    cut = np.zeros(n + 1, bool)
    cut[w.first[:-1][w.first[1:] > w.first[:-1]]] = True
    h = nt.ngram_hashes(w.hashes(), WINDOW)
    hit = np.flatnonzero(h % np.uint64(every) == 0)
    hit = hit[w.doc[hit] == w.doc[hit + WINDOW - 1]] + WINDOW - 1
    cut[hit[hit < last[hit]] + 1] = True
    begin = np.flatnonzero(cut[:n])
    length = np.diff(np.append(begin, n))
    if length.max() > most:
        parts = -(-length // most)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + k * most
        length = np.diff(np.append(begin, n))
    head = np.maximum(begin - WINDOW, w.first[:-1][w.doc[begin]])
    stop = begin + length
    room = np.cumsum(at[stop] - at[head])
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(room, (room[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield w.doc[begin[i:j]], _strings(joined, at[head[i:j]], at[stop[i:j]] - 1), (begin - head)[i:j], length[i:j]
        i = j


def dictionary(docs: DataFrame, every: int = EVERY, most: int = MOST) -> DataFrame:
    """lang, chunk, fresh, words and freq of every distinct chunk."""
    names = ["lang", "chunk", "fresh", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, buf, offs in nt.slices(b.column(1), SLICE_BYTES):
                for doc, chunk, fresh, words in chunks(buf, offs, every, most):
                    yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(doc + i)), chunk, pa.array(fresh, pa.int32()),
                                                      pa.array(words, pa.int32())], names)

    docs = exact(docs, "lang", "text")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_column(docs).alias("text"))
    parsed = rows.mapInArrow(run, "lang string, chunk string, fresh int, words int")
    return parsed.groupBy("lang", "chunk", "fresh").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("freq"))


class _Batch:
    """Words of the chunks of one batch, numbered exactly."""

    def __init__(self, table: pa.Table):
        chunk = table["chunk"].combine_chunks()
        flat = pc.split_pattern(pc.replace_substring(chunk, "\n", " "), " ").flatten().dictionary_encode()
        self.words, self.id = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs = langs.dictionary
        _, offs, data = chunk.buffers()
        offs = np.frombuffer(offs, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
        w = nt.words(buf, offs - offs[0], _JOINT)
        first = w.first[:-1][w.doc]
        place = np.arange(len(w.start)) - first
        self.fresh = place >= table["fresh"].to_numpy()[w.doc]
        self.lang = langs.indices.to_numpy()[w.doc].astype(np.int64)
        self.freq = table["freq"].to_numpy()[w.doc]
        starts = place == 0                                    # first words of pieces
        starts[1:] |= buf[w.start[1:] - 1] == 0x0A
        begin = np.flatnonzero(starts)
        self.run = np.arange(len(starts)) - begin[np.cumsum(starts) - 1]     # words before it in its piece
        # pair hashes, for the filter
        words = self.words.cast(pa.large_string())
        _, o, d = words.buffers()
        o = np.frombuffer(o, np.int64)[words.offset:words.offset + len(words) + 1]
        c = nt.byte_hash(np.frombuffer(d, np.uint8)[o[0]:o[-1]])
        h = nt.span_hash(c, o[:-1] - o[0], o[1:] - o[0], nt.BYTE_BASE)
        lang_hash = np.array([hash_of(x) for x in self.langs.to_pylist()], np.uint64)
        self.pair = np.zeros(len(starts), np.uint64)           # that ends at the word
        self.pair[1:] = pair_hash(h[self.id[:-1]], h[self.id[1:]], lang_hash[self.lang[1:]])

    def count(self, n: int, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Weighted counts of the phrases of ``n`` words that end at the words ``ends``."""
        key = self.lang[ends]
        for k in range(n - 1, -1, -1):
            key = key * len(self.words) + self.id[ends - k]
            if k:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        total = np.add.reduceat(self.freq[ends][order], np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)
        found = ends[order[new]]
        for i in range(0, len(found), OUT_ROWS):
            yield self._rows(n, found[i:i + OUT_ROWS], total[i:i + OUT_ROWS])

    def _rows(self, n: int, one: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        words = [self.words.take(pa.array(self.id[one - k])) for k in range(n - 1, -1, -1)]
        phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[one])), phrase, pa.array(np.full(len(one), n), pa.int32()),
                                           pa.array(total, pa.int64())], ["lang", "phrase", "n_words", "a"])


def hash_of(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(nt.span_hash(nt.byte_hash(data), np.array([0]), np.array([len(data)]), nt.BYTE_BASE)[0])


def pair_hash(left: np.ndarray, right: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return nt.mix(nt.mix(left + lang) * np.uint64(3) + right)


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bit numbers for each hash."""
    return [(h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= COUNT_BYTES:
            yield _Batch(pa.Table.from_batches(held))
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield _Batch(pa.Table.from_batches(held))


_COUNTS = "lang string, phrase string, n_words int, a long"


def _counted(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase", "n_words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _short(words: DataFrame, least: int) -> DataFrame:
    """Frequent words and pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield from b.count(1, np.flatnonzero(b.fresh))
            yield from b.count(2, np.flatnonzero(b.fresh & (b.run >= 1)))
    return _counted(words.mapInArrow(run, _COUNTS), least)


def pair_filter(frequent: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of the frequent pairs: ``bits`` / 64 numbers, whatever their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            at = np.concatenate(_bits(b.pair[b.run == 1], bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "mask"])

    pairs = frequent.filter("n_words = 2").select("lang", F.col("phrase").alias("chunk"), F.lit(0).alias("fresh"), F.lit(1).cast("long").alias("freq"))
    got = pairs.mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got["at"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def _long(words: DataFrame, passes: np.ndarray, least: int) -> DataFrame:
    """Frequent phrases of three words and more."""
    shared = words.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in _batches(batches):
            ok = b.run >= 1
            for at in _bits(b.pair, len(f) << 6):
                ok &= (f[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            whole = ok.copy()                                  # all pairs of the phrase that ends here pass
            for n in range(3, LONGEST + 1):
                whole[n - 2:] &= ok[:len(ok) - (n - 2)]
                whole[:n - 2] = False
                yield from b.count(n, np.flatnonzero(whole & b.fresh & (b.run >= n - 1)))
    return _counted(words.mapInArrow(run, _COUNTS), least)


def _part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def phrase_counts(docs: DataFrame, least: int = LEAST, every: int = EVERY, most: int = MOST,
                  filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, n_words, a) of 1 to ``LONGEST`` words, and the word total n of each language."""
    words = stored(dictionary(docs, every, most), "phrase-chunks")
    short = stored(_short(words, least), "phrase-pairs")
    frequent = stored(short.unionByName(_long(words, pair_filter(short, filter_bits), least)), "phrase-counts")
    return frequent, words.groupBy("lang").agg(F.sum(F.col("words") * F.col("freq")).alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, every: int = EVERY,
                 most: int = MOST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = phrase_counts(docs, least, every, most, filter_bits)
    big = "decimal(20,0)"
    found = frequent.filter("n_words > 1").withColumn("w", F.split("phrase", " "))
    cuts = found.select("lang", "phrase", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), "w")
    count = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias("f"))

    def with_count(rows: DataFrame, part: Column, name: str) -> DataFrame:
        p = count.withColumnRenamed("f", name)
        return rows.withColumn("_p", part).join(p, (F.col("lang") == F.col("_lang")) & (F.col("_p") == F.col("_phrase"))) \
            .drop("_lang", "_phrase", "_p")

    cuts = with_count(cuts, _part(1, F.col("k")), "l")
    cuts = with_count(cuts, _part(F.col("k") + 1, F.col("n_words") - F.col("k")), "r")
    cuts = cuts.withColumn("_num", F.col("a").cast(big) * F.lit(2_000_000).cast("decimal(7,0)")) \
        .withColumn("_den", F.col("l").cast(big) + F.col("r").cast(big)).withColumn("score", F.expr("_num div _den"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = found.filter("n_words > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("_longer").isNull() | (F.col("_longer").cast(big) * 100 < F.col("a").cast(big) * covered))
    best_first = F.desc("b.score"), F.desc("a"), F.asc("phrase")
    # a language's best are among the best of its parts: one task ranks PARTS * top phrases at most
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = kept.withColumn("_n", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best_first))).filter(F.col("_n") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", "b.score")


def oracle_sql(least: int = LEAST, top: int = TOP, covered: int = COVERED) -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, sizes WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE a >= {least} AND m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM found),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (
  SELECT f.lang, f.a, array_to_string(f.w[i:i + s.m - 1], ' ') AS phrase
  FROM found f JOIN sizes s ON s.m BETWEEN 2 AND f.m - 1, unnest(range(1, 4)) AS t(i) WHERE i <= f.m - s.m + 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_of GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.a IS NULL OR 100::HUGEINT * o.a < {covered}::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
