"""PDF layout over a table of spans: lines, roles, paragraphs, margins and ruled tables.

All groups are by page, so that neither a document nor its pages meet in a task
but for sums over a document's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

_PAGE = ["path", "page"]


def body_size(spans: DataFrame) -> DataFrame:
    """(path, body): the font size of most characters, in half points; of equal ones the smaller."""
    bins = spans.where("kind = 'text'").groupBy("path", (F.round(F.col("size") * 2) / 2).alias("bin")).agg(F.sum(F.length("text")).alias("chars"))
    return bins.groupBy("path").agg(F.max_by("bin", F.struct("chars", -F.col("bin"))).alias("body"))


def unique_spans(spans: DataFrame) -> DataFrame:
    """Without spans that are drawn again within a unit of the same place."""
    cell = [F.round("x0").alias("cx"), F.round("y0").alias("cy")]
    df = spans.select("*", *cell)
    return df.withColumn("again", F.row_number().over(Window.partitionBy(*_PAGE, "kind", "text", "cx", "cy").orderBy("seq"))).where("again = 1").drop("cx", "cy", "again")


def lines(spans: DataFrame) -> DataFrame:
    """(path, page, line, text, x0, y0, x1, y1, size, font, height): spans of one baseline, in reading order.

    A new line begins where the baseline differs from the one before by more than
    a third of the size, going down the page, or where the gap to the right is
    wider than two and a half sizes, as between columns.
    """
    w = Window.partitionBy(*_PAGE).orderBy(F.col("y0").desc(), "x0", "seq")
    df = unique_spans(spans.where("kind = 'text'"))
    step = F.lag("y0").over(w) - F.col("y0")
    df = df.withColumn("base", F.sum(F.when(F.coalesce(step, F.lit(1e9)) > F.col("size") / 3, 1).otherwise(0)).over(w))
    across = Window.partitionBy(*_PAGE, "base").orderBy("x0", "seq")
    gap = F.col("x0") - F.lag("x1").over(across)
    df = df.withColumn("gap", gap).withColumn("piece", F.sum(F.when(F.coalesce(F.col("gap"), F.lit(0.0)) > F.col("size") * 2.5, 1).otherwise(0)).over(across))
    piece = F.struct("x0", "seq", F.when((F.col("gap") > F.col("size") * 0.15) & ~F.col("text").startswith(" "), F.concat(F.lit(" "), "text")).otherwise(F.col("text")).alias("t"), F.length("text").alias("n"), "size", "font")
    out = df.groupBy(*_PAGE, "base", "piece").agg(
        F.array_sort(F.collect_list(piece)).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max_by("size", F.struct(F.length("text"), "size")).alias("size"), F.max_by("font", F.length("text")).alias("font"), F.first("height").alias("height"), F.first("width").alias("width"),
    )
    text = T.trim_space(F.regexp_replace(T.ligatures(F.array_join(F.transform("parts", lambda p: p["t"]), "")), r"\s+", " "))
    return out.select(*_PAGE, F.struct("base", "piece").alias("line"), text.alias("text"), "x0", "y0", "x1", "y1", "size", "font", "height", "width").where("text <> ''")


def repeated_margins(line_rows: DataFrame, share: float = 0.5) -> DataFrame:
    """(path, key): lines in the upper or lower tenth that, digits masked, stand on half of a document's pages, three at least."""
    edge = (F.col("y0") > F.col("height") * 0.9) | (F.col("y1") < F.col("height") * 0.1)
    pages = line_rows.groupBy("path").agg(F.count_distinct("page").alias("pages"))
    keys = line_rows.where(edge).groupBy("path", _margin_key().alias("key")).agg(F.count_distinct("page").alias("on"))
    return keys.join(pages, "path").where((F.col("on") >= 3) & (F.col("on") >= F.col("pages") * share)).select("path", "key")


def _margin_key() -> Column:
    return F.regexp_replace(F.lower("text"), r"\d+", "#")


def without_margins(line_rows: DataFrame) -> DataFrame:
    edge = (F.col("y0") > F.col("height") * 0.9) | (F.col("y1") < F.col("height") * 0.1)
    marked = line_rows.withColumn("key", F.when(edge, _margin_key()))
    return marked.join(repeated_margins(line_rows), ["path", "key"], "left_anti").drop("key")


def classify(line_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines with ``role``: heading (with level), list, code, caption, footnote or text."""
    df = line_rows.join(sizes, "path", "left")
    big, bold = F.col("size") / F.col("body"), F.col("font").rlike("(?i)bold|black|heavy")
    mono = F.col("font").rlike("(?i)mono|courier|consol|typewriter|cmtt")
    short = F.length("text") <= 120
    number = F.col("text").rlike(r"^(?:\d+\.)*\d+\.?\s+\p{Lu}")
    role = (
        F.when(mono, "code").when(F.col("text").rlike(r"^(?:[•◦▪‣·*–-]|\(?(?:\d{1,3}|[a-z])[.)])\s+\S"), "list")
        .when(F.col("text").rlike(r"^(?i:figure|fig\.|table|listing|algorithm)\s+[\dA-Z]+[.:]"), "caption")
        .when((big >= 1.15) & short, "heading").when(bold & number & short, "heading").when((big <= 0.85) & (F.col("y0") < F.col("height") * 0.2), "footnote").otherwise("text")
    )
    level = F.when(role == "heading", F.when(big >= 1.6, 1).when(big >= 1.3, 2).otherwise(3))
    return df.withColumn("role", role).withColumn("level", level)


def column_order(line_rows: DataFrame) -> DataFrame:
    """Lines with ``flow``: on pages with two columns full lines, left column, right column; else top to bottom.

    A page has two columns where a third of its lines end left of the middle and
    a third begin right of it.
    """
    mid = F.col("width") / 2
    side = F.when(F.col("x1") <= mid + 2, 1).when(F.col("x0") >= mid - 2, 2).otherwise(0)
    df = line_rows.withColumn("side", side)
    counts = df.groupBy(*_PAGE).agg(F.count_if(F.col("side") == 1).alias("l"), F.count_if(F.col("side") == 2).alias("r"), F.count(F.lit(1)).alias("n"))
    df = df.join(counts.select(*_PAGE, ((F.col("l") * 3 >= F.col("n")) & (F.col("r") * 3 >= F.col("n"))).alias("two")), _PAGE)
    # a full line divides the page into bands that are read one after the other
    w = Window.partitionBy(*_PAGE).orderBy(F.col("y0").desc(), "x0")
    band = F.sum(F.when(F.col("two") & (F.col("side") == 0), 1).otherwise(0)).over(w)
    df = df.withColumn("band", F.when(F.col("two"), band).otherwise(0))
    order = Window.partitionBy(*_PAGE).orderBy("band", F.when(F.col("two"), F.col("side")).otherwise(0), F.col("y0").desc(), "x0")
    return df.withColumn("flow", F.row_number().over(order)).drop("side", "two", "band")


def paragraphs(line_rows: DataFrame) -> DataFrame:
    """(path, page, block, role, level, text): lines joined while role, size and spacing go on; line-end hyphens undone before lower case."""
    w = Window.partitionBy(*_PAGE).orderBy("flow")
    before = lambda c: F.lag(c).over(w)
    gap = before("y0") - F.col("y1")
    new = (
        ~before("role").eqNullSafe(F.col("role")) | (F.col("role") == "list") | (F.abs(before("size") - F.col("size")) > 0.6) | (gap > F.col("size") * 0.9) | (gap < -F.col("height") / 4)
        | ((F.col("role") == "text") & (F.col("x0") - before("x0") > F.col("size")) & before("text").rlike(r"[.!?:”\"]$"))
    )
    df = line_rows.withColumn("block", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w))
    out = df.groupBy(*_PAGE, "block").agg(F.first("role").alias("role"), F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("flow", "text"))).alias("l"))
    prose = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    prose = F.regexp_replace(F.regexp_replace(prose, r"(\p{L})-\n(?=\p{Ll})", "$1"), "\n", " ")
    code = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return out.select(*_PAGE, "block", "role", "level", F.when(F.col("role") == "code", code).otherwise(prose).alias("text"))


def ruled_tables(spans: DataFrame) -> DataFrame:
    """(path, page, row, col, text): cells between ruled lines, the text in order; pages with two rules in each direction at least."""
    rules = spans.where("kind = 'rule'")
    ys = rules.where("abs(y1 - y0) < 1").groupBy(*_PAGE).agg(F.array_sort(F.collect_set(F.round("y0"))).alias("ys"))
    xs = rules.where("abs(x1 - x0) < 1").groupBy(*_PAGE).agg(F.array_sort(F.collect_set(F.round("x0"))).alias("xs"))
    grid = ys.join(xs, _PAGE).where((F.size("ys") >= 2) & (F.size("xs") >= 2))
    t = unique_spans(spans.where("kind = 'text'")).join(grid, _PAGE)
    below = lambda edges, v: F.size(F.filter(edges, lambda e: e <= v))
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    t = t.withColumn("col", below("xs", mid_x) - 1).withColumn("row", F.size("ys") - 1 - below("ys", mid_y)).where((F.col("col") >= 0) & (F.col("col") < F.size("xs") - 1) & (F.col("row") >= 0) & (F.col("row") < F.size("ys") - 1))
    cell = F.array_sort(F.collect_list(F.struct((-F.round("y0")).alias("y"), "x0", "text")))
    return t.groupBy(*_PAGE, "row", "col").agg(F.array_join(F.transform(cell, lambda c: F.trim(c["text"])), " ").alias("text"))


def document(files_spans: DataFrame) -> DataFrame:
    """Blocks of all documents: lines, margins, roles, columns and paragraphs."""
    line_rows = without_margins(lines(files_spans))
    return paragraphs(column_order(classify(line_rows, body_size(files_spans))))


def markdown(blocks: DataFrame) -> DataFrame:
    """(path, markdown) of each document."""
    text = (
        F.when(F.col("role") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("role") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("role") == "list", F.regexp_replace("text", r"^[•◦▪‣·*–]\s+", "- ")).otherwise(F.col("text"))
    )
    return blocks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))


def statistics(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, status, pages, characters, headings, cells)."""
    a = spans.groupBy("path").agg(F.max("status").alias("status"), F.max("page").alias("pages"), F.sum(F.when(F.col("kind") == "text", F.length("text"))).alias("characters"))
    b = blocks.groupBy("path").agg(F.count_if(F.col("role") == "heading").alias("headings"))
    c = ruled_tables(spans).groupBy("path").agg(F.count(F.lit(1)).alias("cells"))
    return a.join(b, "path", "left").join(c, "path", "left").fillna(0, ["headings", "cells"])
