"""Tables on a grid: which row and column each cell begins at once rows and columns span, header rows, and Markdown.

The cells of a table are read in order: a cell begins at the first column of its
row that no earlier cell covers. That depends on all cells before it, so a table
(part of one page) is one group, whose cells a small fold places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.content import data_tables
from leafmill.session import TASK_ROWS, pieces

#: How far a cell may span.
MOST_COLUMNS, MOST_ROWS = 100, 1000


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def page_cells(nodes: DataFrame) -> DataFrame:
    """(page_id, table, row, at, colspan, rowspan, header, align, text): the cells of data tables, rows numbered from 0 as they stand.

    Rows without cells don't count, nor do rows after the first whose cells are
    all empty. A cell of a head or a ``th`` is a header.
    """
    nearest = lambda names: F.get("path", F.array_max(F.transform("tags", lambda t, i: F.when(t.isin(names), i))))
    cell = F.col("tag").isin("td", "th") & (F.element_at("tags", -1) == "tr")
    span = lambda name, most: F.least(F.greatest(F.coalesce(_attr(name).try_cast("int"), F.lit(1)), F.lit(1)), F.lit(most))
    style = F.lower(F.regexp_extract(_attr("style"), r"(?i)text-align\s*:\s*(left|center|right)", 1))
    align = F.when(F.lower(_attr("align")).isin("left", "center", "right"), F.lower(_attr("align"))).otherwise(F.nullif(style, F.lit("")))
    cells = nodes.where(cell).select("page_id", nearest(["table"]).alias("table"), F.col("parent").alias("tr"), F.col("node").alias("cell"), span("colspan", MOST_COLUMNS).alias("colspan"), span("rowspan", MOST_ROWS).alias("rowspan"),
        ((F.col("tag") == "th") | (F.element_at(F.concat(F.array(F.lit("")), "tags"), -2) == "thead")).alias("header"), align.alias("align"))
    said = nodes.where("tag = '#text'").select("page_id", nearest(["td", "th"]).alias("cell"), "node", "text").where("cell is not null")
    said = said.groupBy("page_id", "cell").agg(T.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "")).alias("text"))
    tables = data_tables(nodes).where("data").select("page_id", F.col("node").alias("table"))
    df = cells.join(tables, ["page_id", "table"]).join(said, ["page_id", "cell"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = Window.partitionBy("page_id", "table")
    df = df.withColumn("empty", F.max(F.when(F.col("text") != "", 1).otherwise(0)).over(Window.partitionBy("page_id", "table", "tr")) == 0)
    df = df.withColumn("first", F.dense_rank().over(rows.orderBy("tr")) == 1).where(F.col("first") | ~F.col("empty"))
    return df.select("page_id", "table", (F.dense_rank().over(rows.orderBy("tr")) - 1).alias("row"), (F.row_number().over(Window.partitionBy("page_id", "table", "tr").orderBy("cell")) - 1).alias("at"), "colspan", "rowspan", "header", "align", "text")


def place_cells(cells: DataFrame, *table: str) -> DataFrame:
    """``cells`` with ``col``: where each begins; ``rowspan`` ends with the table. ``cells``: the columns of ``table``, row, at, colspan, rowspan.

    The window deals the cells out by table, in as many partitions as ``cells`` if they
    are by table already; tables come one after the other in the sorted rows of a partition.
    """
    whole = cells.withColumn("rowspan", F.least(F.col("rowspan"), F.max("row").over(Window.partitionBy(*table)) - F.col("row") + 1).cast("int")).withColumn("col", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, c, taken = None, None, 0, set()
        for batch in batches:
            cols = []
            for k, r, wide, high in zip(zip(*(batch[t].to_pylist() for t in table), strict=True), *(batch[x].to_pylist() for x in ("row", "colspan", "rowspan")), strict=True):
                if k != key:
                    key, row, taken = k, None, set()
                if r != row:
                    row, c = r, 0
                while (r, c) in taken:
                    c += 1
                taken.update((r + i, c + j) for i in range(high) for j in range(wide))
                cols.append(c)
                c += wide
            yield batch.set_column(batch.schema.get_field_index("col"), "col", pa.array(cols, pa.int32()))

    return whole.sortWithinPartitions(*table, "row", "at").mapInArrow(run, whole.schema)


def _row() -> dict[str, Column]:
    """Facts of a row by its cells."""
    return {"head": F.bool_and("header"), "wide": F.max(F.col("col") + F.col("colspan"))}


def _table() -> dict[str, Column]:
    """Facts of a table by its rows."""
    return {"rows": F.count(F.lit(1)), "columns": F.max("wide"), "last": F.max("row"), "body": F.min(F.when(~F.col("head"), F.col("row")))}


def _heads() -> Column:
    lead = F.coalesce("body", F.col("last") + 1)
    return F.when(lead < F.col("rows"), lead).when(F.col("rows") > 1, 1).otherwise(0).cast("int").alias("header_rows")


def header_rows(cells: DataFrame, *table: str) -> DataFrame:
    """(table, rows, columns, header_rows): leading rows of header cells alone; of a table that has no others, the first if there are more."""
    rows = cells.groupBy(*table, "row").agg(*[c.alias(n) for n, c in _row().items()])
    return rows.groupBy(*table).agg(*[c.alias(n) for n, c in _table().items()]).select(*table, "rows", "columns", _heads())


def markdown_tables(cells: DataFrame, *table: str) -> DataFrame:
    """(table, markdown) of placed cells: a pipe table; what a cell spans besides its first place stays empty, and a table without header rows has an empty one.

    Cells are dealt out by table once, and all that follows stays there.
    """
    cells = cells.repartition(pieces(cells, F.lit(1), TASK_ROWS), *table)
    text = F.replace(F.col("text"), F.lit("|"), F.lit("\\|"))
    lines = cells.groupBy(*table, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("col").cast("int"), text)))).alias("m"), F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("c"), F.col("align").alias("a")))), lambda x: x["a"].isNotNull())).alias("aligned"), *[c.alias(n) for n, c in _row().items()])
    one = Window.partitionBy(*table)
    lines = lines.select("*", *[c.over(one).alias(n) for n, c in _table().items()]).withColumn("header_rows", _heads())
    across = F.transform(F.sequence(F.lit(0), F.col("columns").cast("int") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    bar = F.concat(F.lit("|"), F.array_join(F.transform(across, lambda s: F.when(s == "", "  |").otherwise(F.concat(F.lit(" "), s, F.lit(" |")))), ""))
    how = lambda c: F.coalesce(F.try_element_at(F.col("aligned"), c), F.lit(""))
    marks = F.transform(F.sequence(F.lit(0), F.col("columns").cast("int") - 1), lambda c: F.when(how(c) == "center", " :-: |").when(how(c) == "right", " --: |").when(how(c) == "left", " :-- |").otherwise(" --- |"))
    rule = F.concat(F.lit("|"), F.array_join(marks, ""))
    blank = F.concat(F.lit("|"), F.repeat(F.lit("  |"), F.col("columns").cast("int")))
    own = F.when((F.col("row") == 0) & (F.col("header_rows") > 0), F.concat_ws("\n", bar, rule)).when(F.col("row") == 0, F.concat_ws("\n", blank, rule, bar)).otherwise(bar)
    return lines.select(*table, "row", own.alias("line")).groupBy(*table).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
