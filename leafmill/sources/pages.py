"""Pages: bytes to text, and HTML to a table of nodes.

Only the tree is built in Python, because Spark has no HTML reader: one small
parser turns a page into rows. Everything that is computed over the tree
afterwards is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements without an end tag, elements whose text isn't shown, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg canvas iframe object select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul video audio math iframe embed".split()
)
CLOSES_P = BLOCK - frozenset(("body", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption", "summary"))
SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

NODE_SCHEMA = "page_id long, node int, parent int, path array<int>, tags array<string>, tag string, attrs map<string,string>, text string"

_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)


def charset_of(data: bytes, header: str | None, scan: int = 1024) -> str:
    """A byte order mark, the Content-Type, a meta element among the first bytes, or UTF-8; UTF-16 labels mean UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    m = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", header or "", re.I)
    found = m[1] if m else ((m := _META.search(data[:scan])) and m[1].decode("ascii", "replace")) or "utf-8"
    if found.lower().startswith("utf-16") or found.lower() == "x-user-defined":
        found = "utf-8" if found.lower() != "x-user-defined" else "windows-1252"
    try:
        "".encode(found)
    except LookupError:
        return "utf-8"
    return "windows-1252" if found.lower() in ("iso-8859-1", "latin1", "ascii", "us-ascii") else found


def decode_html(df: DataFrame, content: str = "content", header: str | None = None) -> DataFrame:
    """``df`` with html: the bytes of ``content`` as text."""

    @F.pandas_udf(StringType())
    def decoded(data: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(charset_of(bytes(b), h), "replace").removeprefix("﻿") for b, h in zip(data, head, strict=True)], dtype=object)

    return df.withColumn("html", decoded(F.col(content), F.col(header) if header else F.lit(None).cast("string")))


class Tree(HTMLParser):
    """Rows of a page's nodes in document order; implied ends are closed, hidden subtrees are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[int, str]] = []
        self.skip = 0
        self.raw = ""

    def put(self, tag: str, attrs: dict[str, str], text: str | None) -> int:
        path = [n for n, _ in self.open]
        self.rows.append([len(self.rows), path[-1] if path else -1, path, [t for _, t in self.open], tag, attrs, text])
        return len(self.rows) - 1

    def close_to(self, names: frozenset[str] | tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] in names:
                del self.open[k:]
                return
            if self.open[k][1] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if self.skip:
            self.skip += tag not in VOID and tag == self.raw
            return
        hidden = "hidden" in a or a.get("aria-hidden") == "true" and "math" not in a.get("class", "") or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""))
        if tag in HIDDEN or hidden:
            data = tag == "script" and (a.get("type", "").lower() == "application/ld+json" or a.get("type", "").lower().startswith("math/tex"))
            if tag in ("iframe", "script") and (tag == "iframe" or data) or tag == "noscript":
                self.put(tag, a, None)
            if tag not in VOID:
                self.skip, self.raw = 1, tag
            self.keep_data = data
            return
        if tag in CLOSES_P:
            self.close_to(("p",), ("td", "th", "li", "div", "section", "article", "body", "button"))
        if tag in SAME:
            names, stop = SAME[tag]
            self.close_to(tuple(names.split()), tuple(stop.split()))
        if re.fullmatch("h[1-6]", tag):
            self.close_to(("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "article", "body", "td"))
        node = self.put(tag, a, None)
        if tag not in VOID:
            self.open.append((node, tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.skip:
            self.close_to((tag,))

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.skip -= tag == self.raw
            return
        if any(t == tag for _, t in self.open):
            self.close_to((tag,), ("table",) if tag not in ("table", "body", "html") else ())

    def handle_data(self, data: str) -> None:
        if self.skip:
            if getattr(self, "keep_data", False) and self.rows:
                self.rows[-1][6] = (self.rows[-1][6] or "") + data
        elif data:
            self.put("#text", {}, data)


_COLUMNS = {
    "page_id": pa.int64(), "node": pa.int32(), "parent": pa.int32(), "path": pa.list_(pa.int32()), "tags": pa.list_(pa.string()), "tag": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(),
}


def page_nodes(pages: DataFrame, rows: int = 64) -> DataFrame:
    """The node table of ``pages`` (page_id, html). Null pages have no nodes; a page is parsed whole.

    Pages are dealt out by page_id before they are parsed, because a file of
    pages has fewer splits than there are cores; about ``rows`` pages make one
    batch of nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, html = batch["page_id"].to_pylist(), batch["html"].to_pylist()
            for at in range(0, len(ids), rows):
                out: list[tuple] = []
                for page, text in zip(ids[at : at + rows], html[at : at + rows], strict=True):
                    if text:
                        t = Tree()
                        t.feed(text)
                        t.close()
                        out += [(page, *r) for r in t.rows]
                if out:
                    yield pa.record_batch([pa.array([list(x.items()) for x in c] if k == "attrs" else c, kind) for c, (k, kind) in zip(zip(*out, strict=True), _COLUMNS.items(), strict=True)], list(_COLUMNS))

    return pages.select("page_id", "html").repartition("page_id").mapInArrow(run, NODE_SCHEMA)
