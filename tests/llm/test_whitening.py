"""Whitening against numpy's eigenvectors, and its edge rows."""

import math

import numpy as np
import pytest

from leafmill.llm import queries, whitening
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, row string, x string, n string, whitened string, p string, i string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "r", "x", "n", "w", "p", "i") for i, v in rows], SCHEMA)


def test_query_is_numpys_whitening(spark):
    out = queries.QUERIES["op11_whitening"](spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(e.embedding).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    want = (x - sums / n) @ vectors / np.sqrt(values)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    assert (out.n == n).all() and out.identity_error.max() < 1e-10 and out.residual.max() < 1e-12
    first = out[out.component == 1].set_index("vec_id").loc[e.vec_id]
    assert (first.deviation.to_numpy() == ((n * x - sums) ** 2).sum(axis=1)).all()
    total = np.square(fit - sums / n).sum() / n
    assert np.allclose(out[out.vec_id == e.vec_id[0]].sort_values("component").explained, values / total, rtol=1e-10)


@pytest.mark.parametrize("dims,wanted", [(300, 16), (40, 3), (5, 16)])
def test_lobpcg_of_close_eigenvalues(dims, wanted):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    values = np.sort(1 + rng.random(dims) * np.r_[np.ones(dims // 2), np.full(dims - dims // 2, 1e-3)])[::-1]
    a = (q * values) @ q.T
    products = []

    def product(block):
        products.append(block.shape[1])
        return a @ block

    x, got, residual, _ = whitening.lobpcg(product, dims, min(wanted, dims))
    assert np.allclose(got, values[: len(got)], rtol=1e-12) and residual < 1e-11
    assert np.abs(x.T @ x - np.eye(len(got))).max() < 1e-12 and max(products) <= 4 * wanted and len(products) < 60


def test_edge_rows(spark):
    rows = [(1, [0.0, 1.0, 2.0]), (2, [0.5, 1.0, -2.0]), (3, None), (4, []), (5, [0.1, None, 0.2]), (6, [0.1, math.nan, 0.2]), (7, [0.1, math.inf, 0.2])]
    rows += [(8, [0.1, -math.inf, 0.2]), (9, [1.0, 2.0]), (None, [3.0, 1.0, 0.0]), (1, [0.0, 1.0, 2.0]), (10, [0.0, 1.0, 2.0])]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.row.vec_id or 0) for r in out) == [0, 1, 1, 2, 10] and {r.n for r in out} == {3}
    same = [(r.deviation, r.whitened) for r in out if r.row.vec_id in (1, 10)]
    assert all(s == same[0] for s in same) and all(len(r.whitened) == len(r.explained) == 2 for r in out)
    assert abs(sum(out[0].explained) - 1) < 1e-9 and out[0].row.x == "x"


def test_no_variance_and_empty_tables(spark):
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.n) for r in one] == [(0, [], 1)] * 2
    none = whitening.whiten(frame(spark, [(1, None)]))
    assert none.count() == 0 and none.columns == whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).columns


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 0], [5, 1]])
    n, sums = 1 << 30, [7 << 60, 12]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    assert whitening.deviations(np.array([[3, 4]]), 2, [5, 7]) == [2]
