"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of ``WINDOW`` words at every half window.  Document
   frequencies of the benchmark's words are counted over all passages.
2. Randomised SVD of the TF-IDF matrix of the documents' texts, cut into
   passages side by side, over the benchmark's words (other words can't add
   to a cosine with a benchmark text): every task adds up its part of A'(A R)
   for a seeded random matrix R, the parts are summed in two steps, and a
   single-pass Nystroem factorisation gives the right singular vectors.  The
   benchmark's own passages are rows of A too, weighted so that the latent
   space, of ``OVERSAMPLE`` dimensions more than the block has passages, holds
   them all.
3. Every passage of every document is projected and compared with the
   benchmark's projected passages; those with a cosine of ``MIN_COSINE`` or
   more are candidates.  Nothing else chooses them.
4. A candidate is checked on the words themselves: the longest common
   subsequence of the item and the text around the passage.  From
   ``LCS_ALONE`` of the item's words on it is contaminated; from
   ``LCS_PARAPHRASE`` on only if the answer (the item's last sentence, or
   last third) is there in order as well.

The benchmark is taken in blocks of ``BLOCK`` passages; what a block
broadcasts is bounded by its words times the rank, and a task holds its
words times the rank and the block's passages.  The corpus is read
three times for each block, and nothing of it is shuffled but the partial
sums and the pairs found.

Nulls and texts without words contaminate nothing and are not contaminated.
Repeated documents give one pair; repeated items count under their id once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import numtext as nt
from quarry.llm.common import exact, stored, text_column

WINDOW, STRIDE = 64, 32
BLOCK = 512
#: dimensions of the latent space beyond the passages of a block
OVERSAMPLE = 24
MAX_DF = 0.1
#: the rarest words of an item that count however frequent they are
RAREST = 8
BENCHMARK_WEIGHT = 8.0
MIN_COSINE = 0.4
LCS_ALONE, LCS_PARAPHRASE, ANSWER = 0.8, 0.5, 0.75
SEED = 20240229
_TERMS = 256        # words of one row of partial sums
#: bytes of text at a time: the arrays of eight bytes a letter stay in a core's cache
PIECE_BYTES = 1 << 18
_U = np.uint64


@dataclass
class Item:
    id: object
    words: np.ndarray       # hashes
    answer: np.ndarray


@dataclass
class Block:
    """Benchmark passages with what the passes share."""
    items: list[Item]
    owner: np.ndarray       # item of each passage
    passages: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes of the items' words
    flags: np.ndarray = None
    weight: np.ndarray = None

    def set_vocabulary(self, weight: np.ndarray | None = None) -> None:
        if weight is not None:
            self.vocabulary, self.weight = self.vocabulary[weight > 0], weight[weight > 0].astype(np.float32)
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.vocabulary & _U((1 << 20) - 1)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, word numbers) of the words in the vocabulary."""
        at = np.flatnonzero(self.flags[(h & _U((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.vocabulary, h[at])
        k[k == len(self.vocabulary)] = 0
        ok = self.vocabulary[k] == h[at] if len(self.vocabulary) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def text_words(buf: np.ndarray, offs: np.ndarray) -> tuple[nt.Words, np.ndarray]:
    w = nt.words(nt.lowered(buf), offs, nt.NON_ALNUM)
    return w, w.hashes()


def read_items(rows: list[tuple[object, str]]) -> list[Item]:
    out = []
    for key, text in rows:
        sentences = [s for s in _hash_sentences(text) if len(s)]
        if sentences:
            words = np.concatenate(sentences)
            answer = sentences[-1] if len(sentences) > 1 else words[-max(1, len(words) // 3):]
            out.append(Item(key, words, answer))
    return out


def _hash_sentences(text: str) -> list[np.ndarray]:
    for mark in "!?\n":
        text = text.replace(mark, ".")
    parts = text.split(".")
    data = [p.encode() for p in parts]
    w, h = text_words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    return np.split(h, w.first[1:-1])


def blocks(items: list[Item]) -> Iterator[Block]:
    passages = [(i, it.words[a:a + WINDOW]) for i, it in enumerate(items)
                for a in range(0, max(1, len(it.words) - STRIDE), STRIDE)]
    for k in range(0, len(passages), BLOCK):
        part = passages[k:k + BLOCK]
        used = sorted({i for i, _ in part})
        b = Block([items[i] for i in used], np.array([used.index(i) for i, _ in part]), [p for _, p in part],
                  np.unique(np.concatenate([p for _, p in part])))
        b.set_vocabulary()
        yield b


def passages_of(w: nt.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``at``, passage) of the words at the places ``at``, passages' texts and first words."""
    n_words = np.diff(w.first)
    n_seg = -(-n_words // STRIDE)
    n_win = np.maximum(n_seg - 1, n_words > 0)
    base = np.cumsum(n_win) - n_win
    doc = w.doc[at]
    seg = (at - w.first[doc]) // STRIDE
    own = np.arange(len(at))
    late = seg < n_win[doc]             # the passage that begins with this half
    early = seg > 0                     # the one that ends with it
    index = np.concatenate([own[late], own[early]])
    passage = np.concatenate([(base[doc] + seg)[late], (base[doc] + seg - 1)[early]])
    texts = np.repeat(np.arange(w.n), n_win)
    first = w.first[texts] + (np.arange(len(texts)) - base[texts]) * STRIDE
    return index, passage, texts, first


def side_by_side(w: nt.Words, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Passage of the words at the places ``at`` where each word lies in one passage only, and the passages' number."""
    n = -(-np.diff(w.first) // WINDOW)
    doc = w.doc[at]
    return (np.cumsum(n) - n)[doc] + (at - w.first[doc]) // WINDOW, int(n.sum())


def tf_idf(passage: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, value) with each passage's values of length one, sorted."""
    key, count = np.unique(passage.astype(np.int64) << 32 | term, return_counts=True)
    p, t = key >> 32, key & 0xFFFFFFFF
    v = count * weight[t]
    norm = np.sqrt(np.bincount(p, v * v, n))
    return p, t, (v / norm[p]).astype(np.float32)


def dense_parts(p: np.ndarray, t: np.ndarray, v: np.ndarray, rows: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passages, words, small dense matrix) of runs of passages, for fast products in cache."""
    if not len(p):
        return
    which, first = np.unique(p, return_index=True)
    first = np.append(first, len(p))
    for k in range(0, len(which), rows):
        part = which[k:k + rows]
        span = slice(first[k], first[k + len(part)])
        words, column = np.unique(t[span], return_inverse=True)
        a = np.zeros((len(part), len(words)), np.float32)
        a[np.searchsorted(part, p[span]), column] = v[span]
        yield part, words, a


def times(p: np.ndarray, t: np.ndarray, v: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the sparse matrix times ``matrix``: (passages that aren't empty, their rows)."""
    parts = [(part, a @ matrix[words]) for part, words, a in dense_parts(p, t, v)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, matrix.shape[1]), np.float32)
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])


def add_gram(total: np.ndarray, p: np.ndarray, t: np.ndarray, v: np.ndarray, matrix: np.ndarray) -> None:
    """total += A'A matrix."""
    for _, words, a in dense_parts(p, t, v):
        total[words] += a.T @ (a @ matrix[words])


def random_matrix(n: int, rank: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, rank), np.float32)


def benchmark_rows(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    passage = np.repeat(np.arange(len(b.passages)), [len(x) for x in b.passages])
    at, term = b.lookup(np.concatenate(b.passages))
    return tf_idf(passage[at], term, b.weight, len(b.passages))


def nystroem(total: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors from Y = A'A R, largest first."""
    shift = 1e-4 * float(np.linalg.norm(total)) / np.sqrt(omega.shape[1])
    y = total + np.float32(shift) * omega
    c = omega.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((c + c.T) / 2)
    keep = value > value.max() * 1e-7
    y = y @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    s, u = np.linalg.eigh(y.T.astype(np.float64) @ y)
    keep = s > s.max() * 1e-9
    return (y @ (u[:, keep] / np.sqrt(s[keep])).astype(np.float32))[:, ::-1].copy()


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = place.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judge(item: Item, around: np.ndarray) -> tuple[int, int, bool]:
    """(common words, common words of the answer, contaminated)"""
    n = lcs(item.words, around)
    k = lcs(item.answer, around)
    m = len(item.words)
    return n, k, n >= LCS_ALONE * m or (n >= LCS_PARAPHRASE * m and k >= ANSWER * len(item.answer))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = exact(docs, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))


def document_frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Half passages that hold each word, and their number."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        b = Block([], np.zeros(0), [], shared.value)
        b.set_vocabulary()
        count, total = np.zeros(len(b.vocabulary), np.int64), 0
        for batch in batches:
            for _, _, buf, offs in nt.slices(batch.column(0), PIECE_BYTES):
                w, h = text_words(buf, offs)
                n_seg = -(-np.diff(w.first) // STRIDE)
                total += int(n_seg.sum())
                at, term = b.lookup(h)
                doc = w.doc[at]
                seg = (np.cumsum(n_seg) - n_seg)[doc] + (at - w.first[doc]) // STRIDE
                count += np.bincount(np.unique(seg << 32 | term) & 0xFFFFFFFF, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(count[used], total))], ["term", "n"])

    got = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    df = np.zeros(len(vocabulary), np.int64)
    words = got[got["term"] >= 0]
    df[words["term"]] = words["n"]
    return df, int(got.loc[got["term"] < 0, "n"].sum())


def word_weights(b: Block, df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies; 0 for words of many passages but the rarest of each passage."""
    idf = np.log((1.0 + n) / (1.0 + df)) + 0.05
    keep = df <= MAX_DF * n
    for words in b.passages:
        t = np.searchsorted(b.vocabulary, np.unique(words))
        keep[t[np.argsort(df[t], kind="stable")[:RAREST]]] = True
    return np.where(keep, idf, 0.0)


def _add_up(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(data, "<f4")
            sums[part] = sums[part] + x if part in sums else x
    for part, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["part", "data"])


def latent_basis(texts: DataFrame, b: Block, rank: int | None = None) -> np.ndarray:
    """(words, rank): right singular vectors of the weighted passages; by default as many as the block needs."""
    spark = texts.sparkSession
    n = len(b.vocabulary)
    rank = min(rank or len(b.passages) + OVERSAMPLE, n)
    shared = spark.sparkContext.broadcast(b)

    def run(batches):
        blk = shared.value
        omega = random_matrix(n, rank)
        total = np.zeros((n, rank), np.float32)
        for batch in batches:
            for _, _, buf, offs in nt.slices(batch.column(0), PIECE_BYTES):
                w, h = text_words(buf, offs)
                at, term = blk.lookup(h)
                passage, count = side_by_side(w, at)
                p, t, v = tf_idf(passage, term, blk.weight, count)
                add_gram(total, p, t, v, omega)
        for k in range(0, n, _TERMS):
            if total[k:k + _TERMS].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _TERMS], pa.int32()),
                                                  pa.array([total[k:k + _TERMS].astype("<f4").tobytes()], pa.binary())], ["part", "data"])

    schema = "part int, data binary"
    parts = texts.select("text").mapInArrow(run, schema)
    add = lambda it: _add_up(it, rank)
    # two steps: no task reads more than a share of the partial sums
    half = parts.repartition(F.col("part"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, schema)
    got = half.repartition("part").mapInArrow(add, schema).collect()        # words x rank numbers
    shared.unpersist()
    total = np.zeros((n, rank), np.float32)
    for r in got:
        x = np.frombuffer(r.data, "<f4").reshape(-1, rank)
        total[r.part * _TERMS:r.part * _TERMS + len(x)] += x
    omega = random_matrix(n, rank)
    p, t, v = benchmark_rows(b)
    own = np.zeros_like(total)
    add_gram(own, p, t, v, omega)
    # the benchmark's rows weigh as much as the corpus altogether
    scale = BENCHMARK_WEIGHT * max(1.0, float(np.linalg.norm(total)) / max(1e-9, float(np.linalg.norm(own))))
    return nystroem(total + np.float32(scale) * own, omega)


def search(texts: DataFrame, b: Block, basis: np.ndarray, id_type: str, item_type: str, min_cosine: float) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, answer_lcs, contaminated) of all candidates."""
    spark = texts.sparkSession
    p, t, v = benchmark_rows(b)
    rows, z = times(p, t, v, basis)
    queries = np.zeros((len(b.passages), basis.shape[1]), np.float32)
    queries[rows] = z / np.maximum(1e-9, np.linalg.norm(z, axis=1))[:, None]
    shared = spark.sparkContext.broadcast((b, basis, queries))
    names = ["doc_id", "item_id", "cosine", "lcs", "item_words", "answer_lcs", "contaminated"]

    def run(batches):
        blk, base, q = shared.value
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offs in nt.slices(batch.column(1), PIECE_BYTES):
                w, h = text_words(buf, offs)
                at, term = blk.lookup(h)
                index, passage, texts_, first = passages_of(w, at)
                p, t, v = tf_idf(passage, term[index], blk.weight, len(texts_))
                found: dict[tuple[int, int], tuple] = {}
                which, z = times(p, t, v, base)
                for k in range(0, len(which), 8192):
                    cosine = z[k:k + 8192] @ q.T
                    for r, c in zip(*np.nonzero(cosine >= min_cosine)):
                        win = which[k + r]
                        doc, item = int(texts_[win]), int(blk.owner[c])
                        it = blk.items[item]
                        lo = max(w.first[doc], first[win] - len(it.words))
                        hi = min(w.first[doc + 1], first[win] + WINDOW + len(it.words))
                        n, a, bad = judge(it, h[lo:hi])
                        old = found.get((doc, item))
                        new = (bad, n, a, float(cosine[r, c]))
                        if old is None or new > old:
                            found[doc, item] = new
                if found:
                    keys = list(found)
                    bad, n, a, c = zip(*found.values())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + d for d, _ in keys])), pa.array([blk.items[k].id for _, k in keys], item_kind),
                         pa.array(c, pa.float64()), pa.array(n, pa.int64()), pa.array([len(blk.items[k].words) for _, k in keys], pa.int64()),
                         pa.array(a, pa.int64()), pa.array(bad)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    item_kind = to_arrow_type(_parse_datatype_string(item_type))
    return texts.mapInArrow(run, f"doc_id {id_type}, item_id {item_type}, cosine double, lcs long, item_words long, answer_lcs long, contaminated boolean")


def candidates(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", rank: int | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per (document, item) whose passages are close, with the checks' outcome."""
    spark: SparkSession = docs.sparkSession
    benchmark = exact(benchmark, item_col, item_text_col)
    texts = _texts(docs, id_col, text_col)
    id_type, item_type = texts.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    # the benchmark is the query set: it is read by the driver and broadcast in blocks of bounded size
    rows = benchmark.select(F.col(item_col), text_column(benchmark, item_text_col).alias("t")).dropDuplicates().orderBy(item_col, "t").toLocalIterator()
    items = read_items([(r[0], r[1]) for r in rows])
    out = None
    for b in blocks(items):
        df, n = document_frequencies(texts, b.vocabulary)
        b.set_vocabulary(word_weights(b, df, max(n, 1)))
        found = search(texts, b, latent_basis(texts, b, rank), id_type, item_type, min_cosine)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, cosine double, lcs long, item_words long, answer_lcs long, contaminated boolean")
    best = stored(out, "decontam-pairs").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("contaminated", "lcs", "answer_lcs", "cosine", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.cosine", 3).alias("cosine"), "b.lcs", "b.item_words", "b.answer_lcs", "b.contaminated")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The pairs that pass the checks."""
    return candidates(docs, benchmark, **options).filter("contaminated").drop("contaminated")
