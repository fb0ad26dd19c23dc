"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its kind's check is replaced by another valid value of
the same format: a keyed Feistel network permutes the digits (or days,
octets, letters) within the kind's own range, walking the cycle until the
result is valid.  The permutation depends on the key, the kind and the
format only, so equal values stay equal in all documents, different ones
stay different, and the holder of the key can reverse it.  The network is
applied as x -> E'(E(x) + 1), so that no value maps to itself.

Kinds: e-mail addresses (letters and digits of the local part), IBANs (mod
97), IPv4 addresses, dates (calendar days 1900-2099 as Y-M-D, D/M/Y, M/D/Y
with - / . between), US social security numbers, payment cards (Luhn, 13-19
digits), telephone numbers (+ and 8-15 digits, or North American groups).
Numbers that fail their check are left alone.

A card or IBAN may stand next to other digits or capitals that look like more
of it.  If the longest reading fails its check, the shorter ones that end at a
separator are tried (for cards, those in groups of three digits or more), then
the search goes on behind the first group.  Of a value found so, the cycle is
walked on until the new value is found in the same place, so that it can be
reversed; only there can equal values get different pseudonyms.

Null texts stay null; other columns pass through.  Values are found left to
right, so they never overlap.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEMO_KEY = b"quarry pseudonyms, replace in production"

KINDS = re.compile(r"""
  (?P<email>(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-]))
| (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
| (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
| (?P<date>(?<![\w./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt][0-9]{2}(?![A-Za-z_]))
    |(?<![\w./-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?!\w|[./-][0-9]))
| (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
| (?P<phone>(?<![\w+])\+[0-9]{1,3}(?:[ ().-]{0,2}[0-9]){7,12}(?![0-9])
    |(?<![\w+])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w|[.-][0-9]))
| (?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|-[0-9]))
""", re.X)
_POSSIBLE = re.compile("[0-9@]")
_FIRST_GROUP = re.compile("[^A-Za-z0-9]*[A-Za-z0-9]+")


class Feistel:
    """A keyed permutation of 0 .. n - 1 without fixed points (n > 1)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.a = max(2, int(n ** 0.5))
        while self.a * self.a < n:
            self.a += 1
        self.seed = hashlib.blake2b(tweak.encode(), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        h = hashlib.blake2b(b"%d:%d" % (i, x), key=self.seed, digest_size=40).digest()
        return int.from_bytes(h, "big") % self.a

    def _round(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in range(ROUNDS):
            left, right = right, (left + self._f(i, right)) % self.a
        return left * self.a + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in reversed(range(ROUNDS)):
            left, right = (right - self._f(i, left)) % self.a, left
        return left * self.a + right

    def _walk(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.n:          # a * a is little more than n
            x = step(x)
        return x

    def forward(self, x: int) -> int:
        return self._walk(self._back, (self._walk(self._round, x) + 1) % self.n) if self.n > 1 else x

    def backward(self, x: int) -> int:
        return self._walk(self._back, (self._walk(self._round, x) - 1) % self.n) if self.n > 1 else x


# -- kinds: value -> (format, number, range) and back ----------------------
# ``parse`` gives None for an invalid value, else (format, number, size);
# ``build`` the value for a format and number, or None if it isn't valid
# (the walk then goes on).

def _mixed(digits: list[tuple[int, int]]) -> tuple[int, int]:
    """(digit, radix) from the left -> number and size."""
    x, n = 0, 1
    for d, r in digits:
        x, n = x * r + d, n * r
    return x, n


def _unmixed(x: int, radix: list[int]) -> list[int]:
    out = []
    for r in reversed(radix):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _radix(c: str) -> tuple[int, int]:
    """(radix, code point of the class's zero); radix 1 for a fixed character."""
    if "0" <= c <= "9":
        return 10, 48
    if "a" <= c <= "z":
        return 26, 97
    if "A" <= c <= "Z":
        return 26, 65
    return 1, ord(c)


def _classes(text: str) -> tuple[str, int, int]:
    """Format with each digit or letter as its class, number and size."""
    rz = [_radix(c) for c in text]
    x, n = _mixed([(ord(c) - z, r) for c, (r, z) in zip(text, rz)])
    return "".join({48: "0", 97: "a", 65: "A"}[z] if r > 1 else c for c, (r, z) in zip(text, rz)), x, n


def _unclassed(form: str, x: int) -> str:
    rz = [_radix(c) for c in form]
    return "".join(chr(z + d) for d, (r, z) in zip(_unmixed(x, [r for r, _ in rz]), rz))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _filled(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in form)


def _mask(text: str) -> str:
    return re.sub("[0-9]", "0", text)


def parse_card(v: str):
    d = _digits(v)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1 or d[0] == "0":
        return None
    return f"{d[0]}|{_mask(v)}", int(d[1:-1]), 10 ** (len(d) - 2)      # the first digit (the network) stays


def build_card(form: str, x: int):
    first, mask = form.split("|", 1)
    body = first + str(x).zfill(mask.count("0") - 2)
    d = next(body + c for c in "0123456789" if luhn(body + c))
    return _filled(mask, d)


def parse_ip(v: str):
    parts = v.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    return "ip", _mixed([(int(p), 256) for p in parts])[0], 1 << 32


def build_ip(form: str, x: int):
    return ".".join(map(str, _unmixed(x, [256] * 4)))


_DAY0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _DAY0 + 1


def _day(y: str, m: str, d: str):
    try:
        o = datetime.date(int(y), int(m), int(d)).toordinal() - _DAY0
    except ValueError:
        return None
    return o if 0 <= o < _DAYS else None


def parse_date(v: str):
    a, s1, b, s2, c = re.split(r"([-/.])", v)
    if s1 != s2:
        return None
    if len(a) == 4:
        order, o, two = "ymd", _day(a, b, c), len(b) == 2 and len(c) == 2
    else:
        order, o, two = "dmy", _day(c, b, a), len(a) == 2 and len(b) == 2
        if o is None:
            order, o = "mdy", _day(c, a, b)
    return None if o is None else (f"{order}{s1}{'2' if two else '1'}", o, _DAYS)


def build_date(form: str, x: int):
    day = datetime.date.fromordinal(x + _DAY0)
    two = form[4] == "2"
    if not two and day.day > 9 and day.month > 9:
        return None             # would read as two digits each
    part = {"y": f"{day.year:04d}", "m": f"{day.month:02d}" if two else str(day.month), "d": f"{day.day:02d}" if two else str(day.day)}
    v = form[3].join(part[c] for c in form[:3])
    return v if parse_date(v) == (form, x, _DAYS) else None


def parse_ssn(v: str):
    a, g, s = map(int, v.split("-"))
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    return "ssn", _mixed([(a - 1 - (a > 666), 898), (g - 1, 99), (s - 1, 9999)])[0], 898 * 99 * 9999


def build_ssn(form: str, x: int):
    a, g, s = _unmixed(x, [898, 99, 9999])
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def parse_phone(v: str):
    d = _digits(v)
    if v[0] == "+":
        code = re.match(r"\+[0-9]{1,3}", v)[0]
        if len(d) < 8 or len(d) > 15 or d[0] == "0":
            return None
        code = "+1" if d[0] == "1" else code[:3]       # the country's digits stay
        rest = v[len(code):]
    else:
        code, rest = "", v
    d = _digits(rest)
    return f"{code}|{_mask(rest)}", int(d), 10 ** len(d)


def build_phone(form: str, x: int):
    code, mask = form.split("|", 1)
    return code + _filled(mask, str(x).zfill(mask.count("0")))


def _iban_sum(v: str) -> int:
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def parse_iban(v: str):
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_sum(plain) != 1:
        return None
    form, x, n = _classes(plain[4:])
    return f"{plain[:2]}|{form}|{re.sub('[^ ]', 'x', v)}", x, n


def build_iban(form: str, x: int):
    land, bban, mask = form.split("|")
    body = _unclassed(bban, x)
    plain = f"{land}{98 - _iban_sum(f'{land}00{body}'):02d}{body}"
    it = iter(plain)
    return "".join(c if c == " " else next(it) for c in mask)


def parse_email(v: str):
    local, _, domain = v.partition("@")
    form, x, n = _classes(local)
    return (f"{form}@{domain}", x, n) if n > 1 else None


def build_email(form: str, x: int):
    local, _, domain = form.partition("@")
    return f"{_unclassed(local, x)}@{domain}"


PARSE = {"card": parse_card, "ip": parse_ip, "date": parse_date, "ssn": parse_ssn, "phone": parse_phone, "iban": parse_iban, "email": parse_email}
BUILD = {"card": build_card, "ip": build_ip, "date": build_date, "ssn": build_ssn, "phone": build_phone, "iban": build_iban, "email": build_email}


#: what the permutation depends on besides the range: not on separators, so that a number written in two ways stays linked
TWEAK = {"card": lambda f: f[0], "phone": lambda f: f.split("|")[0], "date": lambda f: "", "ip": lambda f: "", "ssn": lambda f: "",
         "iban": lambda f: f.rpartition("|")[0], "email": lambda f: f.partition("@")[0]}


def shorter(kind: str, value: str) -> list[str]:
    """Readings of a failed value that end at a separator, longest first."""
    if kind not in ("card", "iban"):
        return []
    out = [value[:m.start()] for m in re.finditer("[ -]", value)][::-1]
    return out if kind == "iban" else [v for v in out if min(map(len, re.split("[ -]", v))) >= 3]


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.replace = lru_cache(1 << 14)(self._replace)
        self.valid = lru_cache(1 << 14)(lambda kind, value: PARSE[kind](value) is not None)
        self.network = lru_cache(1 << 12)(lambda tweak, n: Feistel(key, tweak, n))

    def _replace(self, kind: str, value: str, back: bool = False) -> str | None:
        got = PARSE[kind](value)
        if got is None:
            return None
        form, x, n = got
        net = self.network(f"{kind}:{TWEAK[kind](form)}", n)
        while True:
            x = net.backward(x) if back else net.forward(x)
            new = BUILD[kind](form, x)
            if new is not None:
                return new

    def find(self, text: str, at: int) -> tuple[int, int, str, bool] | None:
        """(start, end, kind, a longer or earlier reading failed) of the next value."""
        failed = False
        while m := KINDS.search(text, at):
            kind = m.lastgroup
            if self.valid(kind, m[0]):
                return m.start(), m.end(), kind, failed
            failed = True
            for v in shorter(kind, m[0]):
                if self.valid(kind, v):
                    return m.start(), m.start() + len(v), kind, True
            at = m.start() + _FIRST_GROUP.match(m[0]).end()
        return None

    def text(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """The new text, and (start, end, kind) of each value in it (same places in the old text's order)."""
        if not _POSSIBLE.search(text):
            return text, []
        out, spans, at, size = [], [], 0, 0
        while found := self.find(text, at):
            start, end, kind, failed = found
            new = self.replace(kind, text[start:end], back)
            # beside its neighbours the new value must be read as the old one was
            while failed and self.find(text[:start] + new + text[end:], at) != (start, start + len(new), kind, True):
                new = self.replace(kind, new, back)
            out += [text[at:start], new]
            size += start - at
            spans.append((size, size + len(new), kind))
            size += len(new)
            at = end
        return ("".join(out) + text[at:], spans) if spans else (text, [])


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", reverse: bool = False) -> DataFrame:
    """``docs`` with the text replaced, and its ``pii_spans`` (start, end, kind) in the new text.

    A column of the latter name is replaced.  ``reverse`` restores the values.
    """
    names = docs.columns
    at = names.index(text_col)
    kept = [k for k, c in enumerate(names) if k != at and c != "pii_spans"]
    # by position: columns may have any names, equal ones in other case too
    plain = docs.toDF(*[f"_{k}" for k in range(len(names))])
    narrow = plain.select(F.col(f"_{at}").cast("string").alias("_t"), *[f"_{k}" for k in kept])
    spans = "array<struct<start:int,end:int,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    schema = narrow.select("_t", F.lit(None).cast(spans).alias("_s"), *narrow.columns[1:]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [(None, []) if t is None else pseudonyms.text(t, reverse) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in got], pa.string()),
                     pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in got], kind), *part.columns[1:]],
                    ["_t", "_s", *[f"_{k}" for k in kept]])

    done = narrow.mapInArrow(run, schema)
    return done.select(*[F.col("_t" if k == at else f"_{k}").alias(c) for k, c in enumerate(names) if k == at or k in kept],
                       F.col("_s").alias("pii_spans"))
