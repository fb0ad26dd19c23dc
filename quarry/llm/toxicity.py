"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the set of its lower-case words, word pairs, and pairs
with one word left out between, hashed into 2**BITS slots.  Training is
FTRL-proximal with per-coordinate rates and L1 sparsity on a sample of at
most about ``SAMPLE`` labelled rows: the labelled ids are drawn by a hash
threshold, so the bound holds at any size and the draw doesn't depend on
partitions.  FTRL is a sequence of small steps, and shards whose states are
averaged or added up learn rare words worse; so the features are made and
counted in parallel, and one task takes the bounded sample through the
``ROUNDS``.  A slot takes part if enough toxic sampled texts fall into it that
its weight could rise above zero (``least_toxic``, from L1 and the rounds
alone).  The non-zero weights (some hundreds) are broadcast, and every
document is scored whole: its slots are looked up, and only those with a
weight are sorted.

Nulls and empty texts have no features: their score is that of the bias.
Repeated documents get one row each; of repeated ids one text is learned
(the smallest), and of contradicting labels the greater.  Labels without a
text and null labels are not learned.  With no labelled row at all the
score is that of the prior rate, 0.05, for every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import numtext as nt
from quarry.llm.common import exact, stored, text_column

BITS = 22
SAMPLE = 20_000
ROUNDS = 5
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.0
#: tasks that count slots into dense arrays
COUNTERS = 4
_U = np.uint64


def features(buf: np.ndarray, offs: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every feature of every text, each once, sorted by text; ``only``: a flag for each slot that counts."""
    w = nt.words(buf, offs, nt.NON_ALNUM)
    h, doc = w.hashes(), w.doc
    parts = [(doc, h)]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            i = np.flatnonzero(doc[:-gap] == doc[gap:])
            parts.append((doc[i], nt.mix(h[i] * _U(3) + h[i + gap] + _U(salt))))
    found = []
    for d, f in parts:
        f = f >> _U(64 - BITS)
        if only is not None:
            hit = np.flatnonzero(only[f])
            d, f = d[hit], f[hit]
        found.append(d.astype(np.uint64) << _U(32) | f)
    both = np.unique(np.concatenate(found))
    return (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.int64)


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) -> (doc_id, toxic, slots as little-endian int32)."""
    def run(batches):
        for b in batches:
            for i, j, buf, offs in nt.slices(b.column(2)):
                d, s = features(buf, offs)
                cuts = np.searchsorted(d, np.arange(1, j - i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                     pa.array([x.astype("<i4").tobytes() for x in np.split(s, cuts)], pa.binary())], ["doc_id", "toxic", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, slots binary")


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of FTRL-proximal: zero unless |z| exceeds L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: Iterator[tuple[int, np.ndarray]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass, in place; the last coordinate is the bias, which isn't shrunk."""
    for y, s in rows:
        zs, ns = z[s], n[s]
        w = weights(zs, ns)
        b = bias(z, n)
        g = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum() + b)))) - y
        z[s] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) * w / ALPHA
        n[s] = ns + g * g
        z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) * b / ALPHA
        n[-1] += g * g


def bias(z: np.ndarray, n: np.ndarray) -> float:
    return float(-z[-1] * ALPHA / (BETA + np.sqrt(n[-1])))


def sampled_labels(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic): about ``sample`` labelled ids at most, drawn by a hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n <= sample:
        return known
    return known.filter(F.pmod(F.xxhash64(F.lit("ftrl"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))


@dataclass
class Model:
    """Sparse weights by hash slot, and the bias."""
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def least_toxic(rounds: int) -> int:
    """A toxic text moves z by less than one in a round, and a weight is positive only where z is below -L1."""
    return int(L1 // max(1, rounds)) + 1


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """The slots that at least ``least`` toxic texts fall into.

    Each of a few tasks counts into one dense array and sends it on in
    blocks; the blocks are added up side by side.
    """
    width = 1 << 16

    def count(batches):
        n = np.zeros(1 << BITS, np.int32)
        for b in batches:
            for data in b.column(0).to_pylist():
                n[np.frombuffer(data, "<i4")] += 1
        for k in range(0, 1 << BITS, width):
            if n[k:k + width].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k:k + width].tobytes()], pa.binary())], ["start", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int32)
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array((k + np.flatnonzero(n >= least)).astype(np.int32))], ["slot"])

    return rows.filter("toxic = 1").select("slots").coalesce(COUNTERS).mapInArrow(count, "start int, data binary") \
        .repartition(2 * COUNTERS, "start").mapInArrow(add, "slot int")


def _numbered(rows: DataFrame, kept: Broadcast) -> DataFrame:
    """Slots as numbers of the kept ones, the others left out."""
    def run(batches):
        for b in batches:
            out = []
            for data in b.column(2).to_pylist():
                s = np.frombuffer(data, "<i4")
                k = np.searchsorted(kept.value, s)
                k[k == len(kept.value)] = 0
                out.append(k[kept.value[k] == s].astype("<i4").tobytes() if len(kept.value) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "toxic", "slots"])

    return rows.select("doc_id", "toxic", "slots").mapInArrow(run, rows.select("doc_id", "toxic", "slots").schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
        rounds: int = ROUNDS) -> Model:
    """The model from (doc_id, toxic) labels."""
    spark = docs.sparkSession
    drawn = F.broadcast(sampled_labels(exact(labels, "doc_id", "toxic"), sample))   # bounded by ``sample``
    texts = exact(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.lower(text_column(docs, text_col)).alias("text")).join(drawn, "doc_id")
    rows = stored(feature_rows(texts).groupBy("doc_id").agg(F.min(F.struct("toxic", "slots")).alias("r")).select("doc_id", "r.*"), "ftrl-rows")
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    kept = spark.sparkContext.broadcast(np.sort(_frequent(rows, least_toxic(rounds)).toPandas()["slot"].to_numpy(np.int32)))   # 2**BITS at most
    size = len(kept.value)
    rate = (seen.pos + 1) / (seen.n + 20)
    start = -np.log(rate / (1 - rate)) * BETA / ALPHA       # the bias begins at the labels' rate
    if not seen.n:
        return Model(np.zeros(0, np.int32), np.zeros(0), -start * ALPHA / BETA)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values(["place", "doc_id"], kind="stable")
        texts = [(int(y), np.frombuffer(x, "<i4")) for y, x in zip(pdf["toxic"], pdf["slots"])]
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        z[-1] = start
        for _ in range(rounds):
            train(texts, z, n)
        w = weights(z, n)[:-1]
        used = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.append(used, -1), "weight": np.append(w[used], bias(z, n))})

    ready = _numbered(rows, kept).withColumn("place", F.xxhash64(F.lit("shard"), "doc_id"))
    got = ready.repartition(1).mapInPandas(learn, "slot long, weight double").toPandas().sort_values("slot")
    slots, w = got["slot"].to_numpy(), got["weight"].to_numpy()
    return Model(kept.value[slots[1:]], w[1:], float(w[0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, with ``score`` and ``predicted`` (replaced if there)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)        # the non-zero weights

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value.slots] = shared.value.weights
        used = dense != 0
        for text in batches:
            out = []
            for i, j, buf, offs in nt.slices(pa.array(text, pa.large_string())):
                d, s = features(buf, offs, used)
                total = np.bincount(d, dense[s], j - i) + shared.value.bias
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    names = docs.columns
    plain = docs.toDF(*[f"_{k}" for k in range(len(names))])
    # six decimals: the sums' last bits may differ with the slices
    scored = plain.withColumn("score", F.round(probability(F.lower(text_column(plain, f"_{names.index(text_col)}"))), 6))
    return scored.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(names) if c not in ("score", "predicted")],
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    """True for the rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
