"""Words of many texts at once in numpy, straight from Arrow's string buffers.

A slice of a batch is one byte array; words are found with a 256-entry
class table and hashed with a polynomial prefix sum modulo the prime
2**61 - 1, so no Python code runs per word.  (Modulo a power of two some
long words of two letters would hash alike whatever the base.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1

#: separators: space and the ASCII controls tab to carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: separators: every ASCII character that is no letter or digit
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: the modulus of the polynomial hashes
PRIME = (1 << 61) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 31 and 30 bits."""
    low = _U((1 << 31) - 1)
    ah, al, bh, bl = a >> _U(31), a & low, b >> _U(31), b & low
    middle = al * bh + ah * bl
    return _reduced(_reduced(ah * bh * _U(2) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31))) + _reduced(al * bl))


def _up31(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo the prime, for numbers below it: a rotation of their 61 bits."""
    return (x >> _U(30)) | ((x & _U((1 << 30) - 1)) << _U(31))


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime, from 0: those of the upper and of the lower 31 bits can't overflow."""
    c = np.zeros(len(x) + 1, np.uint64)
    low = _U((1 << 31) - 1)
    c[1:] = _reduced(_up31(_reduced(np.cumsum(x >> _U(31), dtype=np.uint64))) + _reduced(np.cumsum(x & low, dtype=np.uint64)))
    return c


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(n - 1, (1 << 16) - 1).bit_length()
        both = []
        for b in (base % PRIME, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, _times(p, np.full(1, pow(b, len(p), PRIME), np.uint64))])
            both.append(p)
        if size > 4 * SLICE_BYTES:      # one very long text: not kept
            return both[0][:n], both[1][:n]
        _powers[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """c with hash(i, j) = (c[j] - c[i]) * base**-i."""
    return _sums(_times(_reduced(values), powers(base, len(values))[0]))


def span_hash(c: np.ndarray | tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans i to j; ``c`` is a ``prefix_hash`` or a ``byte_hash``."""
    if isinstance(c, tuple):
        up, down = c
        gap = _reduced(_up31(_reduced(up[j] - up[i])) + _reduced(down[j] - down[i]))
        n = len(up)
    else:
        gap, n = _reduced(c[j] + _U(PRIME) - c[i]), len(c)
    return mix(_times(gap, powers(base, n)[1][i]))


def count_below(flags: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c


#: base of ``byte_hash`` for ``span_hash``
BYTE_BASE = _P % PRIME


#: up to so many bytes the sums of byte times half a power stay below 2**64
_HALVES = 1 << 24
_split: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bits of the powers of ``BYTE_BASE``, kept for a slice's bytes."""
    have = _split.get(BYTE_BASE)
    if have is None or len(have[0]) < n:
        p = powers(BYTE_BASE, 1 << max(n - 1, (1 << 16) - 1).bit_length() if n <= SLICE_BYTES else n)[0]
        have = p >> _U(31), p & _U((1 << 31) - 1)
        if n <= SLICE_BYTES:
            _split[BYTE_BASE] = have
    return have[0][:n], have[1][:n]


def byte_hash(buf: np.ndarray) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """For ``span_hash``: running sums of each byte times the upper and the lower bits of its power, reduced only at the spans."""
    if len(buf) > _HALVES:
        return prefix_hash(buf.astype(np.uint64) + _U(1), BYTE_BASE)
    high, low = _halves(len(buf))
    value = buf.astype(np.uint64) + _U(1)
    up, down = np.zeros(len(buf) + 1, np.uint64), np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value * high, out=up[1:])
    np.cumsum(value * low, out=down[1:])
    return up, down


@dataclass
class Words:
    """Words of the texts of one slice, in order."""
    buf: np.ndarray        # the slice's bytes
    offs: np.ndarray       # byte offset of each text, and the end
    start: np.ndarray      # byte span of each word
    end: np.ndarray
    doc: np.ndarray        # text of each word
    first: np.ndarray      # first word of each text, and the number of words

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def byte_prefix(self) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        return byte_hash(self.buf)

    def hashes(self, c: np.ndarray | tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        return span_hash(self.byte_prefix() if c is None else c, self.start, self.end, BYTE_BASE)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        c = count_below((self.buf & 0xC0) != 0x80)
        return c[self.end] - c[self.start]


def ngram_prefix(h: np.ndarray) -> np.ndarray:
    """For ``ngram_hashes`` of several lengths."""
    return prefix_hash(h, _Q)


def ngram_hashes(h: np.ndarray, n: int, c: np.ndarray | None = None) -> np.ndarray:
    """Rolling hash of every window of n words (also those across texts)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    c = prefix_hash(h, _Q) if c is None else c
    i = np.arange(len(h) - n + 1)
    return span_hash(c, i, i + n, _Q)


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole texts; a longer text stands alone."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, o, data = column.buffers()
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    inside = ~separators[buf]
    prev = np.empty_like(inside)
    prev[1:] = inside[:-1]
    cuts = offs[:-1][offs[:-1] < len(buf)]
    if len(buf):
        prev[0] = False
    prev[cuts] = False
    start = np.flatnonzero(inside & ~prev)
    nxt = np.empty_like(inside)
    nxt[:-1] = inside[1:]
    if len(buf):
        nxt[-1] = False
    ends = offs[1:][offs[1:] > 0] - 1
    nxt[ends] = False
    end = np.flatnonzero(inside & ~nxt) + 1
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(buf, offs, start, end, doc, first)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for U+00C0 to U+00DE (other letters stay)."""
    low = _LOWER[buf]
    if len(buf):
        upper = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][upper] += 0x20
    return low
