"""Book files: kinds by first bytes, archives, comics in reading order, ranges, and search in texts."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Endings of comic pages.
PAGE_ENDINGS = "jpg jpeg png gif webp avif bmp".split()
#: Segments start at multiples of ALIGN; a ZIP file's end is within its last TAIL bytes.
ALIGN, TAIL = 64 * 1024, 22 + 65535
MIN_SEGMENT, MAX_SEGMENT, TARGET_SEGMENTS, SINGLE = 4 << 20, 16 << 20, 32, 4 << 20
#: How many ranges a run and a task make.
RUN, TASK_RANGES = 512, 1 << 21


def source_kind(content: Column | str) -> Column:
    """zip, rar, mobi, pdf, or null; unsupported:7z and unsupported:tar for containers that are refused."""
    c = F.col(content) if isinstance(content, str) else content
    head = lambda at, n: F.hex(F.substring(c, at, n))
    return (
        F.when(head(1, 2) == "504B", "zip")
        .when(head(1, 7).isin("526172211A0700") | (head(1, 8) == "526172211A070100"), "rar")
        .when(head(61, 8).isin(b"BOOKMOBI".hex().upper(), b"TEXtREAd".hex().upper()), "mobi")
        .when(head(1, 6) == "377ABCAF271C", "unsupported:7z")
        .when(head(258, 5) == b"ustar".hex().upper(), "unsupported:tar")
        .when(head(1, 5) == b"%PDF-".hex().upper(), "pdf")
    )


def archive_entries(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, name, size, packed, crc, place, status): the directory of every ZIP file, an entry to a row; broken files give one status row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data in zip(batch["k"], batch["c"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out += [(k, e.filename, e.file_size, e.compress_size, e.CRC, i, "encrypted" if e.flag_bits & 1 else "ok") for i, e in enumerate(z.infolist())]
                except (zipfile.BadZipFile, ValueError, TypeError, NotImplementedError) as e:
                    out.append((k, None, None, None, None, None, f"invalid: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["k", "name", "size", "packed", "crc", "place", "status"]).astype({c: "Int64" for c in ("size", "packed", "crc", "place")})

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"k {kind}, name string, size long, packed long, crc long, place long, status string").withColumnRenamed("k", key)


def archive_texts(files: DataFrame, key: str = "path", content: str = "content", endings: tuple[str, ...] = (".xml", ".opf", ".ncx", ".xhtml", ".html", ".htm")) -> DataFrame:
    """(key, name, text): the text entries of every ZIP file, each whole; encrypted entries and broken files give none (``archive_entries`` has their status)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch["k"], batch["c"], strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for e in z.infolist():
                            if e.filename.lower().endswith(endings) and not e.flag_bits & 1:
                                out.append((k, e.filename, z.read(e).decode("utf-8-sig", "replace")))
                except (zipfile.BadZipFile, ValueError, TypeError, NotImplementedError):
                    pass
                yield pd.DataFrame(out, columns=["k", "name", "text"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"k {kind}, name string, text string").withColumnRenamed("k", key)


PACKAGE = (
    "title string, creators array<string>, language string, identifier string, items array<struct<id:string,href:string,type:string,properties:string>>, "
    "spine array<struct<idref:string,linear:boolean>>, cover string"
)


def parse_package(opf: str | None) -> tuple | None:
    """The parts of an OPF package; null for no XML."""
    if not opf:
        return None
    try:
        root = ET.fromstring(opf)
    except ET.ParseError:
        return None
    name = lambda e: e.tag.rpartition("}")[2]
    found = {"title": [], "creator": [], "language": [], "identifier": []}
    items, spine, cover = [], [], None
    for e in root.iter():
        n = name(e)
        if n in found and e.text:
            found[n].append(e.text.strip())
        elif n == "item":
            items.append((e.get("id"), e.get("href"), e.get("media-type"), e.get("properties") or ""))
        elif n == "itemref":
            spine.append((e.get("idref"), e.get("linear") != "no"))
        elif n == "meta" and e.get("name") == "cover":
            cover = e.get("content")
    first = lambda k: found[k][0] if found[k] else None
    return first("title"), found["creator"], first("language"), first("identifier"), items, spine, cover


def epub_inspect(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per EPUB: status, title, creators, language, spine_items and cover.

    The directory, the container and the package are rows; the checks are joins
    among them: a mimetype entry first, a package the container names, no
    encryption, and every spine item present.
    """
    entries = archive_entries(files, key, content)
    texts = archive_texts(files, key, content)
    box = texts.where("name = 'META-INF/container.xml'").select(key, F.regexp_extract("text", r"""full-path\s*=\s*["']([^"']+)["']""", 1).alias("opf_path"))
    opf = texts.select(key, F.col("name").alias("opf_path"), "text").join(box, [key, "opf_path"]).select(key, "opf_path", F.udf(parse_package, PACKAGE)("text").alias("p"))
    base = F.regexp_extract("opf_path", r"^(.*/)", 1)
    spine = opf.select(key, base.alias("base"), "p.items", F.explode("p.spine").alias("s")).select(
        key, F.concat("base", F.try_element_at(F.filter("items", lambda i: i["id"] == F.col("s.idref")), F.lit(1))["href"]).alias("name")
    )
    there = spine.join(entries.select(key, "name").withColumn("there", F.lit(True)), [key, "name"], "left")
    there = there.groupBy(key).agg(F.count(F.lit(1)).alias("spine_items"), F.count_if(F.col("there").isNull()).alias("absent"))
    facts = entries.groupBy(key).agg(
        F.max((F.col("name") == "META-INF/encryption.xml").cast("int")).alias("drm"), F.max((F.col("name") == "META-INF/rights.xml").cast("int")).alias("rights"),
        F.max(((F.col("name") == "mimetype") & (F.col("place") == 0)).cast("int")).alias("mimetype"), F.min("status").alias("directory"),
    )
    by_property = F.try_element_at(F.filter("p.items", lambda i: F.contains(i["properties"], F.lit("cover-image"))), F.lit(1))["href"]
    by_name = F.try_element_at(F.filter("p.items", lambda i: i["id"] == F.col("p.cover")), F.lit(1))["href"]
    df = facts.join(opf, key, "left").join(there, key, "left")
    status = (
        F.when(F.col("directory").startswith("invalid"), "invalid").when(F.col("rights") == 1, "encrypted").when(F.coalesce("mimetype", F.lit(0)) == 0, "no mimetype")
        .when(F.col("p").isNull(), "no package").when(F.coalesce("spine_items", F.lit(0)) == 0, "empty spine").when(F.col("absent") > 0, "incomplete").otherwise("ok")
    )
    return df.select(key, status.alias("status"), "p.title", "p.creators", "p.language", "spine_items", F.concat(base, F.coalesce(by_property, by_name)).alias("cover"))


class _Text(HTMLParser):
    """Visible text of a chapter, blocks apart."""

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "head")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


@F.udf(StringType())
def plain_text(html: str):  # noqa: ANN201
    """The visible text of a chapter, one line to a block."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def is_page_name(name: Column | str) -> Column:
    n = F.regexp_replace(F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/")), "^/+", "")
    hidden = F.exists(F.split(n, "/"), lambda s: s.startswith(".") | (s == "__MACOSX"))
    return (n != "") & ~n.endswith("/") & ~hidden & F.lower(n).rlike(rf"\.(?:{'|'.join(PAGE_ENDINGS)})$")


def natural_key(name: Column | str) -> Column:
    """Sorts names as readers do: digit runs by value, then by length; digits before text; ties by the name."""
    n = F.col(name) if isinstance(name, str) else name
    runs = F.regexp_extract_all(F.lower(n), F.lit("[0-9]+|[^0-9]+"), 0)

    def one(r: Column) -> Column:
        digits = r.rlike("^[0-9]")
        value = F.regexp_replace(r, "^0+(?=.)", "")
        return F.struct(
            F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, F.length(value)).otherwise(0).alias("size"),
            F.when(digits, value).otherwise(r).alias("text"), F.when(digits, F.length(r)).otherwise(0).alias("width"),
        )

    return F.struct(F.transform(runs, one).alias("runs"), n.alias("name"))


def comic_pages(entries: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, page): the pages of each comic, numbered from 0 in natural order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(natural_key("name"))) - 1
    return entries.where(is_page_name("name")).select(key, "name", place.alias("page"))


def comic_spreads(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, spread, pages): the cover alone, wide pages alone, others two by two in their order.

    ``pages``: key, page from 0, wide. Pages between two that stand alone are
    counted from the first of them; each even one opens a spread.
    """
    order = Window.partitionBy(key).orderBy("page")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alone = (F.col("page") == 0) | F.coalesce("wide", F.lit(False))
    df = pages.select(key, "page", alone.alias("alone"), F.row_number().over(order).alias("at"))
    df = df.withColumn("since", F.col("at") - F.coalesce(F.max(F.when(F.col("alone"), F.col("at"))).over(so_far), F.lit(0)))
    opens = F.col("alone") | (F.col("since") % 2 == 1)
    df = df.withColumn("spread", (F.sum(opens.cast("int")).over(so_far) - 1).cast("int"))
    return df.groupBy(key, "spread").agg(F.array_sort(F.collect_list(F.col("page").cast("int"))).alias("pages"))  # two at most


def plan_segments(df: DataFrame, size: str) -> DataFrame:
    """A row for each range [start, end) of a file, in the order of fetching: the aligned tail, then front to back.

    A small table of files may mean very many ranges: runs of at most ``RUN`` of
    them, few rows still, are dealt out to tasks before they become rows. A task
    has the same places of many files: their numbers repeat from file to file, and
    tables store them in a fraction of what a file at a time would take.
    """
    n = F.col(size)
    tail = F.when(n <= SINGLE, 0).otherwise(F.floor(F.greatest(F.lit(0), n - TAIL) / ALIGN) * ALIGN).cast("long")
    step = (F.ceil(F.least(F.lit(MAX_SEGMENT), F.greatest(F.lit(MIN_SEGMENT), F.ceil(F.col("tail_") / TARGET_SEGMENTS))) / ALIGN) * ALIGN).cast("long")
    files = df.where(n > 0).withColumn("tail_", tail).withColumn("step_", step).withColumn("last_", F.ceil(F.col("tail_") / F.col("step_")).cast("long"))
    total = files.agg(F.sum(F.col("last_") + 1)).first()[0] or 0
    front_runs = F.when(F.col("last_") > 0, F.sequence(F.lit(1).cast("long"), F.col("last_"), F.lit(RUN).cast("long")))
    tail_run = F.array(F.lit(0).cast("long"))  # alone, as its places are the file's own
    runs = files.withColumn("run_", F.explode(F.concat(tail_run, F.coalesce(front_runs, F.array().cast("array<bigint>")))))
    tasks = min(1 + total // TASK_RANGES, 20_000)
    if tasks > 1:
        runs = runs.repartitionByRange(max(tasks, df.sparkSession.sparkContext.defaultParallelism), "step_", "run_", n).sortWithinPartitions("step_", "run_")
    of_run = F.when(F.col("run_") > 0, F.sequence(F.col("run_"), F.least(F.col("run_") + RUN - 1, F.col("last_")))).otherwise(tail_run)
    out = runs.withColumn("i_", F.explode(of_run))
    i, front = F.col("i_"), (F.col("i_") - 1) * F.col("step_")
    start, end = F.when(i == 0, F.col("tail_")).otherwise(front), F.when(i == 0, n.cast("long")).otherwise(F.least(front + F.col("step_"), F.col("tail_")))
    return out.select(*df.columns, i.cast("int").alias("fetch"), start.alias("start"), end.alias("end"))


def parse_range(header: Column | str, size: Column | str) -> Column:
    """struct(offset, length, end) of ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n``; null where it can't be met."""
    h = F.col(header) if isinstance(header, str) else header
    n = F.col(size) if isinstance(size, str) else size
    a = F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")).try_cast("long")
    b = F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")).try_cast("long")
    length = F.least(b, n)
    suffix = F.struct((n - length).alias("offset"), length.alias("length"), (n - 1).alias("end"))
    end = F.least(F.coalesce(b, n - 1), n - 1)
    plain = F.struct(a.alias("offset"), (end - a + 1).alias("length"), end.alias("end"))
    return F.when(a.isNull() & (b > 0), suffix).when((a < n) & (F.coalesce(b, n - 1) >= a), plain)


def _quoted(x: Column) -> Column:
    """A pattern of exactly ``x``: an end of a quotation inside it is spelled out."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _places(df: DataFrame, body: Column, look: Column, rows: list[str]) -> DataFrame:
    """``df`` with ``start``, a row for each place of ``look`` in ``body`` that doesn't overlap the one before; ``rows`` tell the rows of ``df`` apart."""
    pieces = F.transform(F.split(body, _quoted(look), -1), lambda p: F.length(p))
    cut_up = df.select("*", F.length(look).alias("_n"), F.posexplode(pieces).alias("_at", "_length"))
    before = Window.partitionBy(*rows).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut_up.withColumn("start", (F.sum("_length").over(before) + F.col("_at") * F.col("_n")).cast("int"))
    # the last piece ends with the text, not with a place
    return found.withColumn("_last", F.lead("_at").over(Window.partitionBy(*rows).orderBy("_at")).isNull()).where(~F.col("_last")).drop("_at", "_length", "_n", "_last")


def find_in_texts(texts: DataFrame, needle: str, keys: list[str], text: str = "text", context: int = 60) -> DataFrame:
    """(keys, start, before, hit, after, progression): every place of ``needle``, ignoring case, with text around it."""
    low, n = needle.lower(), len(needle)
    rows = texts.where(F.contains(F.lower(F.col(text)), F.lit(low))).select(*keys, F.col(text).alias("t")).withColumn("_row", F.monotonically_increasing_id())
    found = _places(rows, F.lower("t"), F.lit(low), ["_row"]).drop("_row")
    return found.select(
        *keys, "start", F.substr("t", F.greatest(F.lit(1), F.col("start") + 1 - context), F.least(F.lit(context), F.col("start"))).alias("before"),
        F.substr("t", F.col("start") + 1, F.lit(n)).alias("hit"), F.substr("t", F.col("start") + 1 + n, F.lit(context)).alias("after"),
        (F.col("start") / F.length("t")).alias("progression"),
    )


def anchor_quotes(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(quote_id, key, start, end, how): where a quote stands in its text: as written, without case, or by its first and last words.

    Of several places the one with most agreeing context before it counts, then
    the one nearest to the hinted share of the text. ``quotes``: quote_id, key,
    quote, before, hint.
    """
    joined = quotes.join(texts.select(key, "text"), key)
    t, q = F.col("text"), F.col("quote")
    head, tail = F.substring("quote", 1, 24), F.expr("right(quote, 24)")
    how = F.when(F.contains(t, q), "exact").when(F.contains(F.lower(t), F.lower(q)), "lower").when((F.length(q) >= 48) & F.contains(t, head) & F.contains(t, tail), "ends")
    df = joined.withColumn("how", how).where("how is not null")
    look = F.when(F.col("how") == "exact", q).when(F.col("how") == "lower", F.lower(q)).otherwise(head)
    body = F.when(F.col("how") == "lower", F.lower(t)).otherwise(t)
    df = df.withColumn("look", look).withColumn("body", body)
    df = _places(df.withColumn("_row", F.monotonically_increasing_id()), F.col("body"), F.col("look"), ["_row"])
    same = (F.substr("text", F.greatest(F.lit(1), F.col("start") + 1 - F.length("before")), F.least(F.length("before"), F.col("start"))) == F.col("before")).cast("int")
    far = F.abs(F.col("start") / F.greatest(F.lit(1), F.length("text")) - F.coalesce("hint", F.lit(0.0)))
    end = F.when(F.col("how") == "ends", F.col("start") + F.instr(F.substr("text", F.col("start") + 1), tail) - 1 + F.length(tail)).otherwise(F.col("start") + F.length("look"))
    best = F.max_by(F.struct("start", end.alias("end"), "how"), F.struct(F.coalesce(same, F.lit(0)).alias("same"), (-far).alias("near"), (-F.col("start")).alias("first")))
    return df.groupBy("quote_id", key).agg(best.alias("b")).select("quote_id", key, "b.*")
