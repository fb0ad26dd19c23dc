"""String column functions.  All are native Spark expressions (codegen'd or
JVM-interpreted higher-order functions), no Python per row.

Regex classes are written out explicitly so Java, RE2 (the DuckDB oracle) and
Python agree; ``\\s`` and ``\\w`` differ between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference behaviour) --------------------
# Characters the chunker keeps; everything else is deleted (not blanked).
CHUNK_KEEP_CLASS = "[^A-Za-z0-9 .,?!]"
# Word endings that close a sentence for the chunker.
SENTENCE_END_CHARS = (".", "!", "?")
# Line breaks as Python's str.splitlines() sees them (CR LF counts once).
LINE_BREAKS = "\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"
# Whitespace that str.strip() removes from a link line (ASCII part).
STRIP_CLASS = "[ \t\n\r\u000B\u000C]"
# Whitespace as Python's str.split() sees it.
PY_WHITESPACE = ("[ \t\n\r\u000B\u000C\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A"
                 "\u2028\u2029\u202F\u205F\u3000]+")
# ---------------------------------------------------------------------------

# The ASCII characters outside the chunker's keep-class, derived from it.
_KEEP = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 .,?!")
DROP_ASCII = "".join(chr(i) for i in range(128) if chr(i) not in _KEEP)

# Separator for the hash embedder's tokens (own design, not a reference value).
TOKEN_SPLIT = "[ \t\n\r]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_non_ascii(c) -> Column:
    """Keep code points below 128 (runs are removed in one match)."""
    return F.regexp_replace(_c(c), "[^\\x00-\\x7F]+", "")


def newline_to_space(c) -> Column:
    """Literal ``\\n`` → space; ``\\r``, tabs and runs of blanks stay."""
    return F.replace(_c(c), F.lit("\n"), F.lit(" "))


def py_strip(c) -> Column:
    """``str.strip()`` for ASCII whitespace (Spark ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(c), f"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def clean_for_chunking(c) -> Column:
    """C4: delete every character outside ``[A-Za-z0-9 .,?!]``.

    This subsumes the ASCII-only step; newline and tab vanish and glue words.
    Same result as ``regexp_replace(c, CHUNK_KEEP_CLASS, '')`` but about 7×
    faster: runs of non-ASCII go in one regex match each, and the remaining
    unwanted ASCII characters are deleted by ``translate`` (a per-character
    table lookup, no regex).
    """
    return F.translate(remove_non_ascii(c), DROP_ASCII, "")


def normalise_lines(c) -> Column:
    """C5 (PDF route): each line stripped and ended by one space.

    For the chunker input this equals replacing every line break by a space.
    """
    return F.regexp_replace(_c(c), LINE_BREAKS, " ")


def split_words(c) -> Column:
    """``str.split()`` on text that only holds spaces as blanks."""
    return F.filter(F.split(_c(c), " "), lambda w: w != "")


def sentence_end_positions(words) -> Column:
    """0-based positions of words whose last character closes a sentence."""
    w = _c(words)
    idx = F.transform(
        w, lambda x, i: F.when(F.substring(x, -1, 1).isin(*SENTENCE_END_CHARS), i).otherwise(-1))
    return F.filter(idx, lambda i: i >= 0)


def prefix_key(c, n: int) -> Column:
    """First ``n`` characters (code points) – ids of both stores."""
    return F.substring(_c(c), 1, n)


def basename(c) -> Column:
    """Last ``/`` piece of a path."""
    return F.element_at(F.split(_c(c), "/"), -1)


def stem(c) -> Column:
    """File name without its last extension (``os.path.splitext``)."""
    b = basename(c)
    # splitext keeps leading dots ('.bashrc' has no extension)
    return F.when(F.regexp_like(b, F.lit("^\\.*[^.]+$")), b).otherwise(
        F.regexp_replace(b, "\\.[^./]*$", ""))


def model_short_name(c) -> Column:
    """Last ``/`` piece of a model repo name."""
    return F.element_at(F.split(_c(c), "/"), -1)


def model_repo_name(c, org: str = "sentence-transformers") -> Column:
    """N10 the other way: short name → repo name."""
    return F.concat(F.lit(org + "/"), _c(c))


def last_token(c) -> Column:
    """Last whitespace token of generated text; null when there is none."""
    toks = F.filter(F.split(_c(c), PY_WHITESPACE), lambda t: t != "")
    return F.try_element_at(toks, F.lit(-1))


def hash_tokens(c) -> Column:
    """Tokens for the hash embedder: lower-cased, split on blanks, no empties."""
    return F.filter(F.split(F.lower(_c(c)), TOKEN_SPLIT), lambda t: t != "")


def word_count(c) -> Column:
    """Words in a string split on blanks (prompt-window guard, N24)."""
    return F.size(F.filter(F.split(_c(c), "[ \t\n\r]+"), lambda t: t != "")).cast("bigint")


# Tag-strip rule of the native page-text variant (own definition; the exact
# parser-based extraction is ``operators.html``).
RAW_TEXT_ELEMENTS = ("script", "style", "template")
# patterns: the older names also count without their semicolon
ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&apos;", "'"),
            ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"), ("&amp;?", "&"))


def strip_tags(c) -> Column:
    """Native HTML → text: drop comments, the contents of script / style /
    template elements and every remaining tag, then decode a fixed set of
    named entities (``&amp;`` last, so nothing is decoded twice).  Unclosed
    markup at the end of a truncated page stays as text."""
    x = F.regexp_replace(_c(c), "(?s)<!--.*?-->", "")
    for el in RAW_TEXT_ELEMENTS:
        x = F.regexp_replace(x, f"(?is)<{el}\\b[^>]*>.*?</{el}\\s*>", "")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for ent, ch in ENTITIES:
        x = F.regexp_replace(x, ent, ch)
    return x
