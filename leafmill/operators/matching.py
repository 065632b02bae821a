"""Matching of predicted to reference tables and regions, and scores of their cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G

CELL = ["row", "col", "rowspan", "colspan", "text"]
#: A rectangle over more cells of the grid is compared with all of its page.
MOST_CELLS = 64


def pair_scores(predicted: DataFrame, reference: DataFrame, page: list[str]) -> DataFrame:
    """(page, p_table, r_table, f1): cell F1 of the tables of a page that share a cell; ``predicted``: page, table and the cell columns."""
    count = lambda df, name: df.groupBy(*page, F.col("table").alias(name), *CELL).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    p, r = count(predicted, "p_table"), count(reference, "r_table")
    shared = p.join(r, [*page, *CELL]).groupBy(*page, "p_table", "r_table").agg(F.sum(F.least("n_p_table", "n_r_table")).alias("tp"))
    size = lambda df, name: df.groupBy(*page, F.col("table").alias(name)).agg(F.count(F.lit(1)).alias(f"{name}_cells"))
    out = shared.join(size(predicted, "p_table"), [*page, "p_table"]).join(size(reference, "r_table"), [*page, "r_table"])
    return out.withColumn("f1", 2 * F.col("tp") / (F.col("p_table_cells") + F.col("r_table_cells")))


def match_tables(predicted: DataFrame, reference: DataFrame, page: list[str]) -> DataFrame:
    """One-to-one matches of a page's tables by falling F1; ties by table. A page's pairs are a handful."""
    scores = pair_scores(predicted, reference, page)

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["f1", "p_table", "r_table"], ascending=[False, True, True])
        p, r, keep = set(), set(), []
        for i, a, b in zip(frame.index, frame["p_table"], frame["r_table"], strict=True):
            if a not in p and b not in r:
                p.add(a)
                r.add(b)
                keep.append(i)
        return frame.loc[keep]

    return scores.groupBy(*page).applyInPandas(greedy, scores.schema)


def micro_scores(predicted: DataFrame, reference: DataFrame, matches: DataFrame, page: list[str]) -> DataFrame:
    """(tp, predicted, reference, precision, recall, f1) over all cells."""
    tp = matches.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    sizes = predicted.agg(F.count(F.lit(1)).alias("predicted")).join(reference.agg(F.count(F.lit(1)).alias("reference")))  # one row each
    out = tp.join(sizes)
    return out.select(
        "*", (F.col("tp") / F.nullif("predicted", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("reference", F.lit(0))).alias("recall"),
        (2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("reference"), F.lit(0))).alias("f1"),
    )


def meeting_boxes(left: DataFrame, right: DataFrame, page: list[str]) -> DataFrame:
    """The rows of both sides, side by side, whose rectangles ``a`` and ``b`` meet on a page.

    Rectangles are met by the cells of a grid of their mean sides, each pair once:
    in the cell where what they share begins. Those over more than ``MOST_CELLS``
    cells meet all others of their page instead.
    """
    sides = left.select(F.col("a").alias("r")).unionByName(right.select(F.col("b").alias("r")))
    wide, high = (n or 1.0 for n in sides.agg(F.avg(F.col("r.x1") - F.col("r.x0")), F.avg(F.col("r.y1") - F.col("r.y0"))).first())
    at = lambda v, side: F.floor(v.cast("double") / F.lit(float(side)))
    cells = lambda r, lo, hi, side: F.sequence(at(r[lo], side), at(r[hi], side))
    number = lambda r: ((r["x1"] - r["x0"]) / F.lit(float(wide)) + 2.0) * ((r["y1"] - r["y0"]) / F.lit(float(high)) + 2.0)

    def split(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        r = F.col(name)
        small = df.where(number(r) <= MOST_CELLS)
        return small, df.where(number(r) > MOST_CELLS)

    def on_grid(df: DataFrame, name: str) -> DataFrame:
        r = F.col(name)
        return df.withColumn("cx_", F.explode(cells(r, "x0", "x1", wide))).withColumn("cy_", F.explode(cells(r, "y0", "y1", high)))

    a, b = F.col("a"), F.col("b")
    (small_a, large_a), (small_b, large_b) = split(left, "a"), split(right, "b")
    begins = (F.col("cx_") == at(F.greatest(a["x0"], b["x0"]), wide)) & (F.col("cy_") == at(F.greatest(a["y0"], b["y0"]), high))
    met = on_grid(small_a, "a").join(on_grid(small_b, "b"), [*page, "cx_", "cy_"]).where(G.intersects(a, b) & begins).drop("cx_", "cy_")
    for x, y in ((large_a, right), (small_a, large_b)):
        met = met.unionByName(x.join(y, page).where(G.intersects(a, b)))
    return met


def largest_overlap(regions: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """(region, block, area): the block of the same page that shares most of each region's rectangle ``box``.

    Equal rectangles of a page are compared once: of equal blocks only the least can be the answer.
    """
    regions = regions.withColumnRenamed("box", "a")
    first = blocks.groupBy(*page, F.col("box").alias("b")).agg(F.min("block").alias("block"))
    area = G.overlap(F.col("a"), F.col("b"))
    best = lambda block, area: F.max_by(F.struct(block.alias("block"), area.alias("area")), F.struct(area, -block)).alias("m")
    most = meeting_boxes(regions.select(*page, "a").distinct(), first, page).groupBy(*page, "a").agg(best(F.col("block"), area))
    return regions.join(most, [*page, "a"]).groupBy(*page, "region").agg(best(F.col("m.block"), F.col("m.area"))).select(*page, "region", "m.*")


def link_spans(annotations: DataFrame, spans: DataFrame, page: list[str]) -> DataFrame:
    """(page, link, uri, text): the texts that each link's rectangle touches, in drawing order.

    Links with the same rectangles on a page have the same text, which is put together once.
    Texts of links are much longer than what they come from: links and spans meet by page, as
    few as they are, and a link's text becomes a row where it is put together.
    """
    links = annotations.groupBy(*page, "link", "uri").agg(F.sort_array(F.collect_list("box")).alias("boxes"))
    kinds = links.groupBy(*page, "boxes").agg(F.collect_list(F.struct("link", "uri")).alias("links"))
    placed = spans.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("seq", "text")))
    held = placed.groupBy(*page, F.col("box").alias("b")).agg(F.collect_list("place").alias("places"))
    held = held.groupBy(*page).agg(F.collect_list(F.struct("b", "places")).alias("held"))
    drawn = placed.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("place", "text")))["text"].alias("drawn"))
    touched = lambda a: F.flatten(F.filter("held", lambda h: G.intersects(a, h["b"]))["places"])
    places = F.sort_array(F.flatten(F.transform("boxes", touched)))
    met = kinds.join(held.join(drawn, page), page).select(*page, "links", "drawn", F.explode(F.filter(F.array(places), lambda p: F.size(p) > 0)).alias("places"))
    text = F.array_join(F.transform("places", lambda i: F.get("drawn", i - 1)), " ")
    return met.select(*page, "links", text.alias("text")).select(*page, F.inline("links"), "text")
