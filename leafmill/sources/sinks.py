"""Writers: articles as JSON, Markdown or text, books as EPUB and CBZ bytes, reports as Markdown tables."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.books import comic_pages

_STAMP = (1980, 1, 1, 0, 0, 0)


def write_articles(articles: DataFrame, path: str, form: str = "json", mode: str = "errorifexists") -> None:
    """``json``: one object a line, absent fields left out; ``markdown`` and ``text``: one file row per article, split by form feeds."""
    if form == "json":
        articles.write.mode(mode).option("ignoreNullFields", "true").json(path)
    elif form in ("markdown", "text"):
        articles.select(F.col(form).alias("value")).write.mode(mode).option("lineSep", "\f").text(path)
    elif form == "parquet":
        articles.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def archive(entries: list[tuple[str, bytes]], packed: bool) -> bytes:
    """A ZIP whose bytes depend on names and contents alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name, _STAMP)
            info.compress_type = zipfile.ZIP_DEFLATED if packed and name != "mimetype" else zipfile.ZIP_STORED
            z.writestr(info, data)
    return out.getvalue()


def epub_of(title: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A reflowable book of (heading, XHTML body) chapters."""
    e = html.escape
    names = [f"c{k:04d}.xhtml" for k in range(len(chapters))]
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{e(head)}</title></head><body>{body}</body></html>'.encode()
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    toc = "".join(f'<li><a href="{n}">{e(h or title)}</a></li>' for n, (h, _) in zip(names, chapters, strict=True))
    opf = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="i"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="i">{e(title)}</dc:identifier><dc:title>{e(title)}</dc:title><dc:language>{e(language)}</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    )
    box = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    nav = page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{toc}</ol></nav>')
    body = [(f"OEBPS/{n}", page(h, b)) for n, (h, b) in zip(names, chapters, strict=True)]
    return archive([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", box.encode()), ("OEBPS/package.opf", opf.encode()), ("OEBPS/nav.xhtml", nav), *body], True)


def epubs(blocks: DataFrame, key: str = "path", title: str = "title") -> DataFrame:
    """(key, epub): a book for each document from its blocks (key, title, page, block, role, level, text); a chapter begins at a first-level heading."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page", "block"])
        chapters: list[tuple[str, list[str]]] = [("", [])]
        for role, level, text in zip(frame["role"], frame["level"], frame["text"], strict=True):
            t = html.escape(text)
            if role == "heading":
                n = int(level) if level == level and level else 3
                if n == 1 and chapters[-1][1]:
                    chapters.append((text, []))
                chapters[-1][1].append(f"<h{n}>{t}</h{n}>")
            else:
                chapters[-1][1].append({"code": f"<pre><code>{t}</code></pre>", "list": f"<ul><li>{t}</li></ul>"}.get(role, f"<p>{t}</p>"))
        name = str(frame[title].iloc[0] or "Untitled")
        return pd.DataFrame({key: [frame[key].iloc[0]], "epub": [epub_of(name, "en", [(h, "".join(b)) for h, b in chapters])]})

    columns = blocks.select(key, title, "page", "block", "role", "level", "text")
    return columns.groupBy(key).applyInPandas(run, f"{key} {blocks.schema[key].dataType.simpleString()}, epub binary")


def comics(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, cbz): pages (key, name, content) stored in reading order under numbered names; a comic fits in a task by nature."""
    placed = comic_pages(pages.select(key, "name"), key).join(pages, [key, "name"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page")
        entries = [(f"{p:05d}.{n.rpartition('.')[2].lower()}", bytes(c)) for p, n, c in zip(frame["page"], frame["name"], frame["content"], strict=True)]
        return pd.DataFrame({key: [frame[key].iloc[0]], "cbz": [archive(entries, False)]})

    return placed.select(key, "name", "page", "content").groupBy(key).applyInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, cbz binary")


def report(table: DataFrame, digits: int = 3, limit: int = 1000) -> str:
    """A Markdown table of an aggregate of at most ``limit`` rows; refuses larger ones."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report is for aggregates")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = f"| {' | '.join(table.columns)} |\n|{' --- |' * len(table.columns)}"
    return "\n".join([head, *(f"| {' | '.join(map(show, r))} |" for r in rows)])


def palmdoc(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, name, compression, encoding, text, status) of uncompressed and LZ77 PalmDoc and MOBI files."""

    def expand(data: bytes) -> bytes:
        out, i = bytearray(), 0
        while i < len(data):
            c = data[i]
            i += 1
            if 1 <= c <= 8:
                out += data[i : i + c]
                i += c
            elif c < 0x80:
                out.append(c)
            elif c >= 0xC0:
                out += bytes([32, c ^ 0x80])
            elif i < len(data):
                pair = (c << 8 | data[i]) & 0x3FFF
                i += 1
                for _ in range((pair & 7) + 3):
                    back = pair >> 3
                    out.append(out[-back] if 0 < back <= len(out) else 32)
        return bytes(out)

    def read(data: bytes) -> tuple:
        number = lambda at, n: int.from_bytes(data[at : at + n], "big")
        starts = [number(78 + 8 * k, 4) for k in range(number(76, 2))] + [len(data)]
        if data[60:68] not in (b"BOOKMOBI", b"TEXtREAd") or len(starts) < 2:
            return None, None, None, None, "not a book"
        head = starts[0]
        kind, count, locked = number(head, 2), number(head + 8, 2), number(head + 12, 2)
        name = data[:32].split(b"\0")[0].decode("latin-1")
        if locked:
            return name, kind, None, None, "encrypted"
        if kind not in (1, 2):
            return name, kind, None, None, "unsupported compression"
        mobi = data[head + 16 : head + 20] == b"MOBI"
        code = "utf-8" if mobi and number(head + 28, 4) == 65001 else "cp1252"
        extra = number(head + 242, 2) if mobi and number(head + 20, 4) >= 228 else 0
        parts = []
        for k in range(1, min(count, len(starts) - 2) + 1):
            rec = data[starts[k] : starts[k + 1]]
            for bit in range(15, 0, -1):
                if extra >> bit & 1:
                    size = shift = 0
                    for b in reversed(rec[-4:]):
                        size |= (b & 0x7F) << shift
                        shift += 7
                        if b & 0x80:
                            break
                    rec = rec[: len(rec) - size]
            if extra & 1 and rec:
                rec = rec[: len(rec) - (rec[-1] & 3) - 1]
            parts.append(expand(rec) if kind == 2 else rec)
        return name, kind, code, b"".join(parts).decode(code, "replace"), "ok"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data in zip(batch["k"], batch["c"], strict=True):
                try:
                    out.append((k, *read(bytes(data or b""))))
                except IndexError:
                    out.append((k, None, None, None, None, "invalid"))
            yield pd.DataFrame(out, columns=["k", "name", "compression", "encoding", "text", "status"]).astype({"compression": "Int32"})

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"k {kind}, name string, compression int, encoding string, text string, status string").withColumnRenamed("k", key)
