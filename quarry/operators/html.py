"""HTML → text.

The whole document's text is kept (title and navigation included); the
contents of ``script``, ``style`` and ``template`` elements, comments,
declarations and processing instructions are dropped; character and entity
references are decoded (an unknown ``&name`` stays literal).

HTML parsing has no Spark SQL form, so this is the one Python row function
of the page job: stdlib ``html.parser`` over Arrow batches in
``mapInPandas``.  It is narrow (no shuffle) and is applied after the URL
de-duplication so each page is parsed once.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField

_SKIP = {"script", "style", "template"}
# Numeric references 128–159 name Windows-1252 characters in real pages.
_CP1252 = {i: bytes([i]).decode("cp1252", errors="replace") for i in range(128, 160)}


class _TextParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    def handle_entityref(self, name):
        ch = html5.get(name + ";")
        if ch is None:
            cp = name2codepoint.get(name)
            ch = chr(cp) if cp is not None else "&" + name
        self.handle_data(ch)

    def handle_charref(self, name):
        try:
            n = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
            ch = _CP1252.get(n) or chr(n)
        except (ValueError, OverflowError):
            ch = "&#" + name + ";"
        self.handle_data(ch)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA[") and not self.skip:
            self.out.append(data[6:])


def html_to_text(doc: str | None) -> str | None:
    if doc is None:
        return None
    p = _TextParser()
    p.feed(doc)
    p.close()
    return "".join(p.out)


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add ``out_col`` with the text of ``html_col`` (the HTML column is dropped)."""
    keep = [f for f in df.schema.fields if f.name != html_col]
    schema = type(df.schema)(keep + [StructField(out_col, StringType())])

    def run(batches):
        for pdf in batches:
            pdf[out_col] = pd.Series([html_to_text(h) for h in pdf[html_col]], index=pdf.index, dtype=object)
            yield pdf.drop(columns=[html_col])

    return df.mapInPandas(run, schema)
