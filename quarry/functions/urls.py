"""URL and path column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import DATA_ROOT
from . import text as T

# ---- fixed values ------------------------------------------------------------
# A URL is kept only if it starts with its own "scheme://netloc".  As the
# prefix is computed from the URL itself, that holds exactly when the URL
# opens with a lower-case scheme followed by "://".
VALID_URL = "^[a-z][a-z0-9+.-]*://"
# scheme://netloc part of a URL (netloc ends at /, ? or #).
TLD = "^([a-z][a-z0-9+.-]*://[^/?#]*)"
HTML_SUFFIX = ".html"
TXT_SUFFIX = ".txt"
REFERENCE_LABEL = "Reference 1"
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def link_line(c) -> Column:
    """A link-list line with surrounding whitespace stripped."""
    return T.py_strip(c)


def is_valid_url(c) -> Column:
    """URL starts with its own ``scheme://netloc``."""
    return F.regexp_like(_c(c), F.lit(VALID_URL))


def tld(c) -> Column:
    """``scheme://netloc``."""
    return F.regexp_extract(_c(c), TLD, 1)


def strip_html_suffix(c) -> Column:
    """Drop a final ``.html`` (only at the very end)."""
    x = _c(c)
    return F.when(x.endswith(HTML_SUFFIX), F.left(x, F.length(x) - F.lit(len(HTML_SUFFIX)))).otherwise(x)


def path_from_url(c, base: str = DATA_ROOT) -> Column:
    """``base`` + URL pieces as folders + last piece + ``.txt``.

    Leading/trailing ``/`` are trimmed, the URL is split on ``/``; empty
    pieces vanish from the folder part (so ``https://h/a`` lands under
    ``base/https:/h/a.txt``).  Query string and fragment stay in the name.
    """
    trimmed = F.regexp_replace(_c(c), "^/+|/+$", "")
    parts = F.split(trimmed, "/")
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p != "")
    name = F.concat(F.element_at(parts, -1), F.lit(TXT_SUFFIX))
    return F.array_join(F.concat(F.array(F.lit(base)), folders, F.array(name)), "/")


def url_from_source(c, base: str = DATA_ROOT) -> Column:
    """Back from a file path to a link: ``<base>/https:/`` → ``https://``,
    every ``.txt`` → ``.html``, wrapped as a markdown reference.

    Not an inverse of N6 for ``http:`` links, links without ``.html`` or chunk
    files – a broken link results, as in the reference.
    """
    url = F.replace(F.replace(_c(c), F.lit(base + "/https:/"), F.lit("https://")),
                    F.lit(TXT_SUFFIX), F.lit(HTML_SUFFIX))
    return F.concat(F.lit(f"[{REFERENCE_LABEL}]("), url, F.lit(")"))
