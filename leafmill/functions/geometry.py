"""Rectangles, matrices and reading positions as Column expressions; rectangles are struct(x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Area that both share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def contains(a: Column, b: Column, slack: float = 0.0) -> Column:
    return (b["x0"] >= a["x0"] - slack) & (b["y0"] >= a["y0"] - slack) & (b["x1"] <= a["x1"] + slack) & (b["y1"] <= a["y1"] + slack)


def expand(a: Column, by: float) -> Column:
    return F.struct((a["x0"] - by).alias("x0"), (a["y0"] - by).alias("y0"), (a["x1"] + by).alias("x1"), (a["y1"] + by).alias("y1"))


def multiply(m: Column, n: Column) -> Column:
    """Product of two 2 x 3 matrices, each an array of six doubles."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    p, q, r, s, t, u = (n[i] for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def position_of(fraction: Column, blocks: Column) -> Column:
    """struct(block, offset, percent) of a block fraction such as 3.25; four decimals."""
    at = F.greatest(F.lit(0.0), F.least(fraction, blocks.cast("double")))
    block = F.least(F.floor(at), blocks - 1)
    four = lambda x: F.floor(x * 10000 + 0.5) / 10000
    return F.struct(block.alias("block"), four(at - block).alias("offset"), four(clamp01(at / blocks)).alias("percent"))


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
