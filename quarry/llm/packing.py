"""Packing by power-of-two decomposition.

A document's tokens (with one end id) are cut into pieces of binary
lengths: as many of the longest as fit, then one for each set bit of the
rest, longest first.  Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding.  Each task deals its pieces into
buckets of equal length and numbers batches of equal token counts inside
them; only the last batch of each bucket and task can be short.

The tokenizer drops white space between words, so the ids of a text are
those of its parts; each Python worker keeps the ids of the parts it has met
(at most ``CACHE`` of them, about 35 bytes each) and sends only new ones
through the tokenizer.  The map
is narrow: nothing is shuffled, and a lost task is simply run again with
the same result (sequence numbers follow partition and row).

Marks of the tokenizer's added tokens (``<|endoftext|>``) give those tokens'
ids with ``added``, as the library's plain call does, else the ids of their
letters and signs.

Nulls and empty texts give the end id alone: one piece of length one.
Repeated rows are packed once each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import numtext as nt
from quarry.llm.common import exact, text_column

MAX_TOKENS = 4096
END_ID = 2
CACHE = 3_000_000
#: sequences of one batch hold this many tokens together
BATCH_TOKENS = 1 << 16


_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[nt.SPACE] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII bytes whose words go through the whole tokenizer: controls and the apostrophe
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = _ODD[39] = True
_ODD[nt.SPACE] = False


class TextTokens:
    """Ids of many texts at once by way of a memory of their parts.

    Texts are cut at ASCII white space; words of ASCII and of Latin-1
    letters further into runs of letters, single digits and runs of
    punctuation, as the tokenizer's own splitter does.  Each different part
    goes through the library once and its ids are then copied by numpy.
    Any other word is one part for the whole tokenizer, and with ``added``
    also words that hold the mark of an added token.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark has a task on each core already
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.marks = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = Tokenizer(self.whole.model)     # for parts: lower case and cut already
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        """The memory: sorted part hashes, and each part's span of ids."""
        self.keys = np.zeros(0, np.uint64)
        self.spans = np.zeros((0, 2), np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def parts(buf: np.ndarray, offs: np.ndarray, marks: list[bytes] = []):
        """(lower-case bytes, starts, ends, is a word for the whole tokenizer)"""
        low = _LOWER[buf]
        after = np.zeros(len(buf), bool)             # follows the lead byte of U+00C0 to U+00FF
        after[1:] = buf[:-1] == 0xC3
        low[after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 0x20
        odd = _ODD[buf] | ((buf >= 0x80) & (buf != 0xC3) & ~(after & (buf < 0xC0))) | (after & ((buf == 0x97) | (buf == 0xB7)))
        w = nt.words(buf, offs)
        kind = _CLASS[buf]
        begin = np.ones(len(buf), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin &= kind != _SPACE
        n_odd = nt.count_below(odd)
        strange = n_odd[w.end] > n_odd[w.start]
        data = low.tobytes() if marks else b""
        for mark in marks:
            at = data.find(mark)
            while at >= 0:
                k = np.searchsorted(w.start, at, "right") - 1
                low[w.start[k]:w.end[k]] = buf[w.start[k]:w.end[k]]     # the mark counts in its own case only
                strange[k] = True
                at = data.find(mark, at + 1)
        if strange.any():
            step = np.zeros(len(buf) + 1, np.int32)
            step[w.start[strange]] += 1
            step[w.end[strange]] -= 1
            begin &= np.cumsum(step[:-1]) == 0
        begin[w.start] = True
        start = np.flatnonzero(begin)
        word = np.searchsorted(w.start, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(buf)), w.end[word])
        return low, start, end, strange[word]

    def _learn(self, keys: np.ndarray, texts: list[str], whole: np.ndarray) -> None:
        got: list = [None] * len(texts)
        for tokenizer, which in ((self.model, np.flatnonzero(~whole)), (self.whole, np.flatnonzero(whole))):
            for k in range(0, len(which), 2048):
                part = which[k:k + 2048].tolist()
                for i, e in zip(part, tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                    got[i] = e.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.spans = np.insert(self.spans, where, np.stack([at, size], 1), axis=0)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)"""
        low, start, end, whole = self.parts(buf, offs, self.marks)
        h = nt.span_hash(nt.byte_hash(low), start, end, nt.BYTE_BASE)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = first[~known]
            data = low.tobytes()
            self._learn(keys[~known], [data[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())], whole[new])
            at = np.searchsorted(self.keys, keys)
        spans = self.spans[at][inverse]
        size = spans[:, 1]
        until = np.cumsum(size)
        ids = self.ids[np.repeat(spans[:, 0] - (until - size), size) + np.arange(until[-1] if len(until) else 0)]
        ends = np.concatenate([[0], until])[np.searchsorted(start, offs)]
        return ids, np.diff(ends)


_workers: dict[tuple[str, bool], TextTokens] = {}


def text_tokens(path: str, added: bool = False) -> TextTokens:
    """One for each Python worker, which Spark uses for many tasks."""
    if (path, added) not in _workers:
        _workers[path, added] = TextTokens(path, added)
    return _workers[path, added]


def lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Piece lengths of a document of n tokens; ``most`` is a power of two."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         most: int = MAX_TOKENS, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS, added: bool = False) -> DataFrame:
    """One row per piece.  ``added``: marks of added tokens give their ids.

    doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit),
    sequence_id, offset (always 0), batch_id (sequences of one length).
    """
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    docs = exact(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "batch_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_tokens(tokenizer_path, added)
        base = TaskContext.get().partitionId() << 33
        done = 0
        in_bucket = dict.fromkeys((1 << b for b in range(most.bit_length())), 0)
        batch_of: dict[int, int] = {}
        n_batches = 0
        for b in batches:
            for i, j, buf, offs in nt.slices(b.column(1)):
                ids, n = tokens(buf, offs)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                cut = [lengths(x, most) for x in (n + 1).tolist()]
                count = np.fromiter(map(len, cut), np.int64, len(cut))
                length = np.fromiter(chain.from_iterable(cut), np.int64, int(count.sum()))
                batch = []
                for size in length.tolist():
                    if in_bucket[size] % max(1, batch_tokens // size) == 0:
                        batch_of[size] = base + n_batches
                        n_batches += 1
                    in_bucket[size] += 1
                    batch.append(batch_of[size])
                stop = np.cumsum(length)
                row = np.repeat(np.arange(len(cut)), count)
                doc_end = np.cumsum(n + 1)
                start = stop - length - (doc_end - n - 1)[row]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [
                    None, pa.py_buffer(np.concatenate([[0], stop * 4]).astype(np.int64)), pa.py_buffer(ids)])
                seq = base + done + np.arange(len(length))
                done += len(length)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(b.column(0).slice(i, j - i), pa.array(row)), pa.array(start), pa.array(length), pa.array((n + 1)[row]),
                     data.cast(pa.binary()), pa.array(seq), pa.array(np.zeros(len(length), np.int64)), pa.array(batch, pa.int64())], names)

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, batch_id long"
    return docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(run, schema)
