"""Whitening of embedding vectors by LOBPCG.

Entries become whole numbers, ``x = floor(64 * c) + 1000000``; the covariance is
that of the distinct vectors (the fit list). No covariance matrix is formed: each
iteration multiplies the covariance by one block of directions, summed over the
fit list's partitions (``covariance_block``), and the driver solves the small
Rayleigh-Ritz problem on the span of the iterate, its residuals and the previous
directions. It ends when the residuals, from a product made anew, are certified
below ``tolerance`` times the largest eigenvalue; then every row is projected.

What goes through the driver is one number, or one block row, for each dimension.
A vector that a third of all rows share is one row of the fit list.

Defined results: rows whose vector is null, empty, holds null, NaN or infinite
entries, or has another length than most (of lengths that are equally frequent,
the greater) get no result. Entries beyond 2**46 count as 2**46, so that x stays
a whole number that doubles hold. Components without variance (eigenvalue below
1e-12 of the greatest) are left out; a fit list of one vector has none, and
``whitened`` is then empty. ``deviation`` is null where it needs more than 64
bits. Repeated rows get equal results; other columns stay in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stored

SCALE, SHIFT, WIDEST = 64, 1_000_000, float(1 << 46)


@dataclass
class Fit:
    """What the fit list says: its size, sums, components (columns), eigenvalues, trace, and the certificates."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    rounds: int


def whole_vectors(df: DataFrame, column: str) -> DataFrame:
    """All columns in ``row``, and the vector as whole numbers ``x``; rows without a usable vector go."""
    v = df[f"`{column}`"]
    # an infinite or missing number is not below infinity, and NaN is the greatest of all
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))
    fits = lambda c: F.greatest(F.least(c.cast("double"), F.lit(WIDEST)), F.lit(-WIDEST))
    x = F.transform(v, lambda c: F.floor(fits(c) * SCALE).cast("long") + SHIFT)
    return df.where(finite & (F.size(v) > 0)).select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), x.alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``f`` (a matrix of one shape) over the batches of the fit list; tasks send one row for each row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    parts = fit.mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).orderBy("i", "j").toArrow()
    return cells["v"].to_numpy().reshape(-1, cells["j"].to_numpy().max() + 1)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and their sums in each dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n += len(x)  # halves of 32 bits can't overflow within a batch
                sums = sums + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(sums))), pa.array([n] * len(sums)), pa.array(list(map(str, sums)))], ["i", "n", "s"])

    rows = fit.mapInArrow(run, "i long, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = rows.orderBy("i").collect()  # one row a dimension
    return (int(rows[0].n) if rows else 0), [int(r.s) for r in rows]


def centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S / n as doubles: whole numbers near the mean are taken off first, so that nothing is lost to rounding."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    base, rest = np.array(near, np.int64), np.array([(s - n * b) / n for s, b in zip(sums, near, strict=True)])
    return lambda x: (x - base) - rest


def orthonormal(block: np.ndarray, against: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal directions of ``block`` beyond the orthonormal ``against``; what hardly differs from the others goes."""
    for _ in range(2):
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, tolerance: float = 1e-13, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``wanted`` greatest eigenvalues and vectors of a symmetric operator that is only known by its products with blocks.

    The block has as many guard vectors as wanted ones, so that close eigenvalues
    at its end don't slow it. Residuals relative to the greatest eigenvalue are
    certified by a product of the iterate itself. Raises if ``rounds`` don't certify any.
    """
    m = min(dims, 2 * wanted)
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, m)))[0]
    ax = product(x)
    p = np.zeros((dims, 0))
    best = np.inf
    for k in range(rounds):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        r = ax - x * values
        size = np.linalg.norm(r, axis=0)[:wanted].max()
        if size <= tolerance * max(values[0], 0) or (size >= best and size <= 1e-11 * values[0]):
            ax = product(x)  # the certificate: what was carried along may have drifted
            values = (x * ax).sum(axis=0)
            size = np.linalg.norm(ax - x * values, axis=0)[:wanted].max()
            if size <= 10 * max(tolerance * values[0], best if best < np.inf else 0) or not values[0] > 0:
                return x[:, :wanted], values[:wanted], float(size / values[0]) if values[0] > 0 else 0.0, k
            best, p = np.inf, p[:, :0]
            continue
        best = min(best, size)
        w = orthonormal(r[:, np.linalg.norm(r, axis=0) > 1e-15 * values[0]], x, 1e-8)
        p = orthonormal(p, np.hstack([x, w]), 1e-8)
        # one pass over the data for both; directions that were scaled up are never multiplied by what was carried along
        s = np.hstack([x, w, p])
        image = np.hstack([ax, product(s[:, m:])]) if s.shape[1] > m else ax
        values, c = np.linalg.eigh((s.T @ image + image.T @ s) / 2)
        c = c[:, ::-1][:, :m]
        p = s[:, m:] @ c[m:]
        x, ax = s @ c, image @ c
    raise ArithmeticError(f"no certified residual after {rounds} rounds")


def fit(vectors: DataFrame, components: int = 16) -> Fit | None:
    """LOBPCG over the distinct vectors ``x``; None where there are none."""
    distinct = stored(vectors.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(distinct)
    if not n:
        return None
    centred, dims = centring(n, sums), len(sums)

    def covariance_block(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ block)

        return summed(distinct, part) / n

    trace = float(summed(distinct, lambda x: np.square(centred(x)).sum(axis=0)[None, :]).sum() / n)
    if not trace > 0:
        return Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), trace, 0.0, 0.0, 0)
    directions, values, residual, rounds = lobpcg(covariance_block, dims, min(components, dims))
    keep = values > 1e-12 * values[0]
    directions, values = directions[:, keep], values[keep]
    scaled = directions / np.sqrt(values)

    def second_moments(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    moments = summed(distinct, second_moments) / n
    error = np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(values))).max()
    return Fit(n, sums, directions, values, trace, residual, float(error), rounds)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2; by Python's numbers where 64 bits might not hold them."""
    near = [s // n for s in sums]
    base, rest = np.array(near, np.int64), [s - n * b for s, b in zip(sums, near, strict=True)]
    y = x - base
    if (int(np.abs(y).max(initial=0)) * n + n) ** 2 * len(sums) < 1 << 63:
        return (np.square(n * y - np.array(rest, np.int64)).sum(axis=1)).tolist()
    exact = (np.square(n * y.astype(object) - np.array(rest, object))).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whiten(df: DataFrame, column: str = "embedding", components: int = 16) -> DataFrame:
    """All columns of the usable rows in ``row``, and ``deviation``, ``whitened`` and ``explained`` (an entry for each component), ``n``, ``identity_error``, ``residual``."""
    vectors = whole_vectors(df, column)
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    out = "deviation long, whitened array<double>"
    model = fit(vectors.where(F.size("x") == sizes[0].d), components) if sizes else None
    if model is None:
        return vectors.limit(0).select("row", F.expr("cast(null as bigint) deviation"), F.expr("cast(null as array<double>) whitened"), F.expr("cast(null as array<double>) explained"), F.expr("cast(null as bigint) n"), F.expr("cast(null as double) identity_error"), F.expr("cast(null as double) residual"))
    n, sums, scaled = model.n, model.sums, model.components / np.sqrt(model.values)
    centred = centring(n, sums)

    @F.arrow_udf(out)
    def projected(xs: pa.Array) -> pa.Array:
        x = matrix(xs)
        z = centred(x) @ scaled
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviations(x, n, sums), pa.int64()), lists], ["deviation", "whitened"])

    done = vectors.where(F.size("x") == sizes[0].d).select("row", projected("x").alias("p"))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return done.select("row", "p.deviation", "p.whitened", explained.alias("explained"), F.lit(n).cast("long").alias("n"), F.lit(model.identity_error).alias("identity_error"), F.lit(model.residual).alias("residual"))
