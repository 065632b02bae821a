"""Connected components by alternating large-star and small-star steps.

Links stay in DataFrames; every round is cut in the shared folder. No group is
collected: each step is a minimum per node, combined map-side, and a join of
every link with its node's minimum. Nodes with very many links would send all
of them to one task of that join. There are fewer than HUBS nodes with more than
rows / HUBS links each, so their minima are broadcast, a table of a bounded size
at any input, and only the links of the other nodes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut

#: More keys than this can't hold a HUBS-th of all rows each: the bound of the broadcast, at some 16 bytes a key.
HUBS = 10_000
HUB_ROWS = 1_000


def with_least(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """``rows``, of which there are ``size``, and m, the least ``value`` of the rows with their ``key``; rows of frequent keys stay where they are."""
    low = rows.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    hubs = cut(low.where(F.col("n") > max(HUB_ROWS, size // HUBS)))
    if hubs.isEmpty():
        return rows.join(low, F.col(key) == F.col("k")).select(*columns, "m")
    known = F.broadcast(hubs.select(F.col("k").alias("hub"), F.col("m").alias("hub_m"), F.lit(True).alias("is_hub")))
    marked = rows.join(known, F.col(key) == F.col("hub"), "left")
    rest = marked.where("is_hub is null").select(*columns)
    return marked.where("is_hub").select(*columns, F.col("hub_m").alias("m")).unionByName(rest.join(low, F.col(key) == F.col("k")).select(*columns, "m"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to another.

    Links with a null end and links of a node with itself are ignored;
    repeated links count once. No links give an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v")
    edges = cut(edges.distinct())
    size = edges.count()
    for _ in range(max_rounds):
        if not size:
            break
        after = cut(_small_star(cut(_large_star(edges, size))))
        before, edges, last, size = edges, after, size, after.count()
        if size == last and edges.join(before, ["u", "v"], "left_anti").isEmpty():  # as many, and all the same
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, "u", "v", 2 * size).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    led = with_least(edges, "u", "v", edges.count())
    ends = F.explode(F.array(F.col("v"), F.col("u"))).alias("u")
    return led.select(ends, F.col("m").alias("v")).where("u > v").distinct()
