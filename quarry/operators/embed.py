"""Embedding operators.

* ``hash_embed`` – the built-in embedder that needs no model: every token is
  hashed to one of ``dim`` buckets (first four hex digits of its MD5, mod
  ``dim``), bucket counts form the vector, then L2 normalisation (M1).
  Lower case is a native expression; tokens, hashes (each distinct token of
  some rows once) and the bucket counts are taken on Arrow batches.  Narrow:
  no shuffle, so it scales with the scan.
* ``embed_with`` – plug-in point for a real model: an iterator
  ``mapInPandas`` that loads the model once per Python worker and encodes
  whole Arrow batches, with a dimension check.
* ``pooled_embed`` – the first store's recipe on subword tokens: the first 256
  of a text, padded and masked to that length, real-valued token vectors,
  masked mean, L2 normalisation.  Narrow; the padded matrix exists for some
  rows at a time only.  The token vectors are a plug-in too.
* ``embed_as`` – the embedder that a model name such as ``subword-64`` means;
  the load and question jobs of the command line use it.
* ``token_matrix`` / ``mean_pool`` – the reference's pooling path in data
  form: padded token rows with an attention mask, pooled by masked mean
  (A1) with partial aggregation per (doc, dimension) so a very long or hot
  document is pre-reduced before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V

DEFAULT_DIM = 64
# Comment in the reference's loader: its model reads the first 256 tokens.
MODEL_TOKEN_LIMIT = 256


def token_bucket(tok: Column, dim: int) -> Column:
    """Bucket of one token: ``int('0x' + md5(tok)[:4]) mod dim``."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 4), 16, 10).cast("int"), F.lit(dim))


def hash_buckets(text: Column, dim: int, max_tokens: int | None = None) -> Column:
    toks = T.hash_tokens(text)
    if max_tokens is not None:
        toks = V.truncate(toks, max_tokens)
    return F.transform(toks, lambda t: token_bucket(t, dim))


# Tokens counted at a time (one row at least).
COUNTED_TOKENS = 1 << 18


def _bincounts(buckets: pa.ListArray, dim: int) -> pa.ListArray:
    """Unit vectors of bucket counts, some rows at a time; null lists stay null."""
    known = np.asarray(buckets.is_valid())
    n = np.asarray(buckets.value_lengths().fill_null(0), dtype=np.int64)
    flat = buckets.flatten()
    ends = np.cumsum(n)
    out = np.zeros((len(n), dim))
    i = 0
    while i < len(n):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + COUNTED_TOKENS, "right")))
        row = np.repeat(np.arange(j - i) * dim, n[i:j])
        row += flat.slice(before, ends[j - 1] - before).to_numpy(zero_copy_only=False)
        m = np.bincount(row, minlength=(j - i) * dim).reshape(-1, dim)
        m = out[i:j] = m.astype(np.float64)
        out[i:j] /= np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), V.NORM_EPS)[:, None]
        i = j
    offsets = np.append(0, np.cumsum(np.where(known, dim, 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[known].ravel()), mask=pa.array(~known))


# Bytes of text cut into tokens at a time (one row at least).
TOKEN_BYTES = 1 << 23
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r", np.uint8))      # T.TOKEN_SPLIT


def _text_buckets(texts: pa.Array, dim: int) -> pa.ListArray:
    """``hash_buckets`` of lower-cased texts, some rows at a time: each of their
    distinct tokens is hashed once.  Null texts give null lists."""
    null = np.asarray(texts.is_null())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    counts, parts = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + TOKEN_BYTES, "right")) - 1)
        rows = ends[i:j + 1] - ends[i]
        raw = np.frombuffer(data, np.uint8, rows[-1], ends[i]) if rows[-1] else np.zeros(0, np.uint8)
        word = np.append(~_BLANK[raw], False)
        first = word.copy()                                # a token begins where no word's byte of its row precedes
        first[1:] &= ~word[:-1]
        first[rows] = word[rows]
        starts, word = np.flatnonzero(first), word[:-1]
        length = np.add.reduceat(word, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
        tokens = tokens.dictionary_encode()
        heads = b"".join([hashlib.md5(t).digest()[:2] for t in tokens.dictionary.to_pylist()])
        bucket = (np.frombuffer(heads, ">u2") % dim).astype(np.int32)
        parts.append(bucket[tokens.indices.to_numpy()])
        counts.append(np.diff(np.searchsorted(starts, rows)))
        i = j
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)), mask=pa.array(null))


def _hash_embed_udf(dim: int):
    @F.arrow_udf(ArrayType(DoubleType()))
    def _vec(texts: pa.Array) -> pa.Array:
        return _bincounts(_text_buckets(texts, dim), dim)
    return _vec


def _bincount_udf(dim: int):
    @F.arrow_udf(ArrayType(DoubleType()))
    def _vec(buckets: pa.Array) -> pa.Array:
        return _bincounts(buckets, dim)
    return _vec


def hash_embed_col(text: Column, dim: int = DEFAULT_DIM, max_tokens: int | None = None) -> Column:
    if max_tokens is None:
        return _hash_embed_udf(dim)(F.lower(text))
    return _bincount_udf(dim)(hash_buckets(text, dim, max_tokens))


def hash_embed(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM,
               max_tokens: int | None = None, out_col: str = "embedding") -> DataFrame:
    """Add an L2-normalised ``array<double>`` hash embedding of ``text_col``.

    ``max_tokens=None`` embeds the whole text.
    """
    return df.withColumn(out_col, hash_embed_col(F.col(text_col), dim, max_tokens))


# ---- plug-in embedder ------------------------------------------------------
_MODEL_CACHE: dict[str, Callable] = {}


def embed_with(df: DataFrame, text_col: str, loader: Callable[[], Callable[[list[str]], np.ndarray]],
               dim: int, name: str, out_col: str = "embedding") -> DataFrame:
    """Encode ``text_col`` with a model built by ``loader`` (once per worker).

    ``loader()`` returns ``encode(list[str]) -> ndarray (n, dim)``.
    """
    # a new schema object: StructType.add would change df.schema in place
    out_schema = StructType(list(df.schema.fields) + [StructField(out_col, ArrayType(DoubleType()))])

    # two loaders of one name are two models
    key = f"{name}:{hashlib.sha1(cloudpickle.dumps(loader)).hexdigest()}"

    def run(batches):
        enc = _MODEL_CACHE.get(key)
        if enc is None:
            enc = _MODEL_CACHE[key] = loader()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            m = np.asarray(enc(texts), dtype=np.float64) if texts else np.zeros((0, dim))
            if m.shape != (len(texts), dim):
                raise ValueError(f"embedder {name!r} returned shape {m.shape}, expected ({len(texts)}, {dim})")
            pdf[out_col] = list(m)
            yield pdf

    return df.mapInPandas(run, out_schema)


def hash_encoder(dim: int = DEFAULT_DIM) -> Callable[[list[str]], np.ndarray]:
    """Pure-Python twin of ``hash_embed`` for use as an ``embed_with`` loader."""
    import hashlib
    import re

    split = re.compile(T.TOKEN_SPLIT)

    def enc(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            for tok in split.split(t.lower()):
                if tok:
                    out[r, int(hashlib.md5(tok.encode()).hexdigest()[:4], 16) % dim] += 1
            out[r] /= max(float(np.sqrt(out[r] @ out[r])), V.NORM_EPS)
        return out
    return enc


# ---- subword tokens: truncated, padded, masked, pooled -----------------------
SUBWORD_CHARS = 4
TOKENS_KNOWN = 100_000          # token vectors that a worker keeps
PADDED_CELLS = 1 << 20          # numbers of the padded matrix held at a time


def subwords(words: list[str], max_length: int | None = MODEL_TOKEN_LIMIT, chars: int = SUBWORD_CHARS) -> list[str]:
    """Pieces of words, a word's first as it is, its later ones marked ``##``; the first ``max_length`` (M5)."""
    out = [("##" if i else "") + w[i:i + chars] for w in words for i in range(0, len(w), chars)]
    return out[:max_length]


def md5_token_vectors(dim: int) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Loader of the built-in token vectors: number ``j`` is byte ``j % 16`` of ``md5('<j // 16>:<token>')``, from -1 to 1."""
    def load() -> Callable[[list[str]], np.ndarray]:
        def encode(tokens: list[str]) -> np.ndarray:
            raw = [b"".join(hashlib.md5(f"{k}:{t}".encode()).digest() for k in range(-(-dim // 16)))[:dim] for t in tokens]
            return np.frombuffer(b"".join(raw), np.uint8).reshape(len(tokens), dim) / 127.5 - 1.0
        return encode
    return load


def masked_mean(ids: list[np.ndarray], table: np.ndarray, length: int) -> np.ndarray:
    """A1 + M1 + M6: rows of token numbers padded to ``length`` with mask 0, pooled and normalised."""
    out = np.zeros((len(ids), table.shape[1]))
    step = max(1, PADDED_CELLS // max(1, length * table.shape[1]))
    for k in range(0, len(ids), step):
        part = ids[k:k + step]
        padded, mask = np.zeros((len(part), length), np.int64), np.zeros((len(part), length))
        for r, t in enumerate(part):
            padded[r, :len(t)], mask[r, :len(t)] = t, 1.0
        total = np.einsum("rl,rld->rd", mask, table[padded])
        out[k:k + step] = total / np.maximum(mask.sum(axis=1), V.MASK_EPS)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1), V.NORM_EPS)[:, None]


def pooled_embed(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM, max_length: int = MODEL_TOKEN_LIMIT,
                 vectors: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, out_col: str = "embedding") -> DataFrame:
    """The text's first ``max_length`` subword tokens as one vector; a null or blank text, all masked, gives zeros.

    ``vectors()`` is called once in a worker and returns ``encode(tokens) -> (n, dim)``.
    """
    load = vectors or md5_token_vectors(dim)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        number: dict[str, int] = {}
        table = np.zeros((1, dim))                       # row 0 stands for the padding
        for words in batches:
            tokens = [subwords(w, max_length) if w is not None else [] for w in words]
            new = sorted({t for row in tokens for t in row} - number.keys())
            if len(number) + len(new) > TOKENS_KNOWN:
                number, table, new = {}, np.zeros((1, dim)), sorted({t for row in tokens for t in row})
            if new:
                got = np.asarray(encode(new), dtype=np.float64)
                if got.shape != (len(new), dim):
                    raise ValueError(f"token vectors of shape {got.shape}, expected ({len(new)}, {dim})")
                number.update((t, len(table) + k) for k, t in enumerate(new))
                table = np.vstack([table, got])
            yield pd.Series(list(masked_mean([np.array([number[t] for t in row], np.int64) for row in tokens], table, max_length)), dtype=object)

    # a word has one piece at least, so no more words are needed than tokens
    return df.withColumn(out_col, run(V.truncate(T.hash_tokens(F.col(text_col)), max_length)))


# ---- embedders by model name ---------------------------------------------------
#: (frame, text column, dimension) -> frame with ``embedding``; a job's own model is added here
EMBEDDERS: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {
    "hash": lambda df, text_col, dim: hash_embed(df, text_col, dim),
    "subword": lambda df, text_col, dim: pooled_embed(df, text_col, dim),
}


def embed_as(df: DataFrame, text_col: str, model: str) -> DataFrame:
    """``embedding`` of ``text_col`` by the model ``<embedder>-<dimension>``."""
    name, _, dim = model.rpartition("-")
    if name not in EMBEDDERS or not dim.isdigit():
        raise ValueError(f"no embedder for model {model!r}; known: {', '.join(f'{n}-<dimension>' for n in EMBEDDERS)}")
    return EMBEDDERS[name](df, text_col, int(dim))


# ---- token matrix and masked mean pooling (A1) -----------------------------
def token_matrix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 dim: int = DEFAULT_DIM, max_length: int | None = MODEL_TOKEN_LIMIT,
                 pad_multiple: int = 8) -> DataFrame:
    """``tokens(doc_id, pos, mask, vec)``.

    With ``max_length`` the tokens are truncated to it (M5) and padded up to
    it with mask 0 (M6), as a fixed-window model sees them; ``None`` keeps
    every token and pads to the next multiple of ``pad_multiple``.  Each
    token vector is the one-hot of its hash bucket; padding repeats the
    bucket of the empty string (masked out anyway).
    """
    b = hash_buckets(F.col(text_col), dim, max_length)
    if max_length is None:
        n = F.size(F.col("_b"))
        length = (F.ceil(n / F.lit(pad_multiple)) * pad_multiple).cast("int")
    else:
        length = F.lit(max_length)
    pad_bucket = token_bucket(F.lit(""), dim)
    rows = df.select(F.col(id_col), b.alias("_b")).withColumn("_len", length)
    mask = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_len"), F.lit(1)) - 1),
                       lambda i: F.when(i < F.size("_b"), 1).otherwise(0))
    rows = rows.select(
        F.col(id_col),
        F.posexplode(F.transform(mask, lambda m, i: F.struct(
            m.alias("mask"), F.coalesce(F.try_element_at(F.col("_b"), i + 1), pad_bucket).alias("bucket")))))
    # a window of one constant array, whose one stands where the bucket is
    zeros = F.array_repeat(F.lit(0.0), dim - 1)
    one_hot = F.slice(F.concat(zeros, F.array(F.lit(1.0)), zeros), F.lit(dim) - F.col("col.bucket"), F.lit(dim))
    return rows.select(F.col(id_col), F.col("pos").cast("int").alias("pos"),
                       F.col("col.mask").alias("mask"), one_hot.alias("vec"))


def mean_pool(tokens: DataFrame, id_col: str = "doc_id", out_col: str = "embedding",
              normalise: bool = True, dim: int | None = None) -> DataFrame:
    """A1: ``Σ(vec·mask) / max(Σmask, 1e-9)`` per dimension, then M1.

    One hash aggregate with a sum for each of the ``dim`` dimensions: partial
    sums pre-reduce each document's tokens map-side, one row a document and
    task is shuffled, and no token row is multiplied.
    """
    if dim is None:     # read from the data
        dim = tokens.agg(F.max(F.size("vec"))).first()[0] or 0
    sums = [F.sum(F.col("vec")[d] * F.col("mask")).alias(f"_{d}") for d in range(dim)]
    total = tokens.groupBy(id_col).agg(F.greatest(F.sum("mask").cast("double"), F.lit(V.MASK_EPS)).alias("_mask"), *sums)
    vec = total.select(F.col(id_col), F.array(*[F.col(f"_{d}") / F.col("_mask") for d in range(dim)]).alias(out_col))
    if normalise:
        vec = vec.withColumn(out_col, V.l2_normalise(F.col(out_col)))
    return vec
