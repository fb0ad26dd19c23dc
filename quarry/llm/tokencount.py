"""Token counts by whole-token shortcut, for byte-level BPE files of ``tokenizers``.

The library cuts a text into pre-tokens and merges the bytes of each by
rank.  A pre-token equal to a vocabulary string is mostly that one token, but
not always: an earlier merge can take the string's bytes apart for good.
``whole_tokens`` proves once, ahead of the job, for which strings it holds:
each string of the vocabulary goes through the library's own merges and stays
if its own id alone comes out.  The set is no larger than the vocabulary and
is broadcast.

In the job a text is cut at the tokenizer's pattern; pre-tokens of the set
count one each without a merge, and only the others are merged, each different
one once for a worker while it is remembered (at most ``CACHE`` of them; ones
over ``CACHE_CHARS`` are not kept).  The map is narrow: nothing is shuffled.

The pattern is run by ``regex``, whose tables of letters, digits and white
space can be of another Unicode version than the library's.  So every
character is compared once for a worker in both, and texts that hold one on
which they differ go through the library whole; so do texts that hold the
mark of an added token, which the library by default cuts out first.

Null and empty texts have no tokens.  Repeated rows are counted each.  Other
columns may have any names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import exact, text_column

#: fixed value: the pattern of the byte-level pre-tokenizer
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: the same for ASCII texts
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
LIMIT = 512
CACHE = 500_000
CACHE_CHARS = 64
#: pre-tokens of a text held at a time
PIECES = 200_000
#: texts up to this length are cut in one go
SHORT = 1 << 18


def _tokenizer(source: str):
    from tokenizers import Tokenizer
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark has a task on each core already
    t = Tokenizer.from_str(source)
    t.no_padding()
    t.no_truncation()
    return t


def _merges_only(tokenizer):
    """The tokenizer's merges alone: a string is one pre-token, marks are plain text."""
    from tokenizers import Tokenizer, pre_tokenizers
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return bare


def check_kind(source: str) -> None:
    """The shortcut holds for a byte-level BPE without normaliser, whose pre-tokenizer is the fixed pattern alone."""
    d = json.loads(source)
    pre = d.get("pre_tokenizer") or {}
    if d["model"].get("type") != "BPE" or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
            or not pre.get("use_regex", True) or d["model"].get("dropout"):
        raise ValueError("token counts need a byte-level BPE tokenizer without normalizer and prefix space")


def whole_tokens(source: str) -> list[str]:
    """Vocabulary strings which the merges turn into their own id alone."""
    t = _tokenizer(source)
    byte_of = _byte_of_sign()
    strings, ids = [], []
    for token, i in t.get_vocab(with_added_tokens=False).items():
        try:
            strings.append(bytes(byte_of[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):      # no text consists of this token
            continue
        ids.append(i)
    got = _merges_only(t).encode_batch_fast(strings, add_special_tokens=False)
    return [s for s, i, e in zip(strings, ids, got) if e.ids == [i]]


def _byte_of_sign() -> dict[str, int]:
    """Signs of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenCounter:
    """Tokens of texts; ``direct`` and ``merged`` count pre-tokens by their way."""

    def __init__(self, source: str, whole: list[str]):
        check_kind(source)
        self.library = _tokenizer(source)
        self.merges = _merges_only(self.library)
        self.cut, self.cut_ascii = regex.compile(PATTERN), re.compile(ASCII)
        self.kinds = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]
        self.whole = frozenset(whole)
        self.size = dict.fromkeys(whole, 1)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: set[str] = set()      # characters on which the pattern and the library agree
        self.odd: set[str] = set()

    def _compare(self, chars: set[str]) -> None:
        split = self.library.pre_tokenizer.pre_tokenize_str
        for c in chars:
            mine = next((k for k, p in enumerate(self.kinds) if p.match(c)), 3)
            # a letter joins "a", a digit joins "1", white space stands before " a", any other joins "#"
            theirs = 0 if len(split("a" + c)) == 1 else 1 if len(split("1" + c)) == 1 else 3 if len(split("#" + c)) == 1 else 2
            (self.known if mine == theirs else self.odd).add(c)

    def _sizes(self, pieces: list[str]) -> tuple[int, int]:
        """(tokens, pre-tokens that are no whole token)"""
        size = self.size
        new = list(set(pieces).difference(size))
        if new:
            if len(size) + len(new) > CACHE + len(self.whole):
                size = self.size = dict.fromkeys(self.whole, 1)
                new = list(set(pieces).difference(size))
            size.update(zip(new, map(len, self.merges.encode_batch_fast(new, add_special_tokens=False))))
        whole = self.whole
        n = sum(map(size.__getitem__, pieces)), len(pieces) - sum(map(whole.__contains__, pieces))
        for p in new:
            if len(p) > CACHE_CHARS:
                del size[p]
        return n

    def __call__(self, text: str) -> tuple[int, int, int]:
        """(tokens, pre-tokens counted directly, pre-tokens merged); a text sent whole has none of either."""
        chars = set(text)
        if not chars <= self.known:
            self._compare(chars - self.known - self.odd)
        if any(m in text for m in self.marks) or not chars.isdisjoint(self.odd):
            return len(self.library.encode(text, add_special_tokens=False).ids), 0, 0
        cut = self.cut_ascii if text.isascii() else self.cut
        if len(text) <= SHORT:
            pieces = cut.findall(text)
            n, merged = self._sizes(pieces)
            return n, len(pieces) - merged, merged
        n = direct = merged = 0
        found = cut.finditer(text)
        while pieces := [m.group() for m in islice(found, PIECES)]:
            k, rest = self._sizes(pieces)
            n, direct, merged = n + k, direct + len(pieces) - rest, merged + rest
        return n, direct, merged


_counters: dict[int, TokenCounter] = {}


def _counter(shared) -> TokenCounter:
    """One for each Python worker, which Spark uses for many tasks."""
    if shared.value[0] not in _counters:
        _counters[shared.value[0]] = TokenCounter(*shared.value[1:])
    return _counters[shared.value[0]]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, n_direct and n_merged pre-tokens.

    ``tokenizer_path`` is read on the driver only; tasks get its content.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    check_kind(source)
    docs = exact(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((hash(source), source, whole_tokens(source)))
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct", "n_merged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared)
        for b in batches:
            got = [count(t.as_py()) for t in b.column(1)]
            n = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), n, pa.array([g[0] > limit for g in got], pa.bool_()),
                 pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names)

    text = text_column(docs, text_col)
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_direct long, n_merged long"
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, schema)
