import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from semgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def random_spectra():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 17, 64):
        basis = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for values in (rng.random(n), np.ones(n), np.repeat([5.0, 1.0], [(n + 1) // 2, n // 2]), 10.0 ** -np.arange(n),
                       1 + 1e-13 * np.arange(n), np.concatenate([[1e9], np.zeros(n - 1)])):
            yield basis @ np.diag(values) @ basis.T
        yield np.diag(rng.random(n))
        yield np.zeros((n, n))


@pytest.mark.parametrize("matrix", list(random_spectra()))
def test_leading_vectors(matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_vectors(matrix, 4)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    scale = max(np.abs(matrix).max(), 1e-300)
    assert np.abs(values - want).max() < 1e-13 * scale * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * scale * len(matrix)


def brute(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for _, v in kept]
    fit = np.array(sorted({tuple(v) for v in x}), float)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(v) for v in x})]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(sums), -1))
    order = np.argsort(-values)[:k]
    white = (np.array(x, float) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
    return {(i, c + 1): (n, sum((n * e - s) ** 2 for e, s in zip(v, sums)), w[c], values[order][c] / values.sum())
            for (i, _), v, w in zip(kept, x, white) for c in range(len(order))}


def test_query_is_that_of_numpy(spark, small_sf, sf):
    for at in (small_sf, sf):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
        want, got = brute(rows), whitening.QUERIES.queries["op13_whitening"](spark, at).collect()
        assert len(got) == len(want)
        sign = {}
        for r in got:
            n, deviation, white, share = want[r.vec_id, r.component]
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(share, rel=1e-9)
            if abs(white) > 1e-3:
                assert sign.setdefault(r.component, np.sign(white * r.whitened)) == np.sign(white * r.whitened)
            assert abs(abs(r.whitened) - abs(white)) < 1e-8 and r.identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]),
            (7, [-0.001, -0.0]), (None, [3.0, -4.5]), (8, [-inf, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("mine"), "deviation": F.lit(1), "row": F.lit(2)})
    out, model = whitening.whiten(df)
    got = out.collect()
    assert out.columns == ["vec_id", "embedding", "x", "deviation", "row", "_x", "_deviation", "whitened"]
    assert sorted(str(r.vec_id) for r in got) == ["1", "2", "2", "7", "None"] and model.n == 3
    assert {tuple(r._x) for r in got} == {(256, 512), (-1, 0), (768, -1152)}
    assert len(model.eigenvalues) == 2 and model.identity_error < 1e-9


def test_too_few_vectors(spark):
    for rows, n, components in (([], 0, 0), ([(1, [1.0, 2.0])] * 3, 1, 0), ([(1, [1.0, 2.0]), (2, [2.0, 5.0])], 2, 1), ([(1, [])], 1, 0)):
        out, model = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert (model.n, len(model.eigenvalues), out.count()) == (n, components, len(rows))
        assert all(len(r.whitened) == components for r in out.collect())
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_numbers_beyond_a_long(spark):
    rows = [(i, [float(v), 2.0**40 * v]) for i, v in enumerate((-3, 1, 8))]
    out, model = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    x = [[256 * v, 2**48 * v] for v in (-3, 1, 8)]
    assert list(model.sums) == [sum(c) for c in zip(*x)]
    exact = [sum((3 * e - s) ** 2 for e, s in zip(v, model.sums)) for v in x]
    assert [r.deviation for r in sorted(out.collect(), key=lambda r: r.vec_id)] == [e if e < 2**63 else None for e in exact]
    assert Fraction(model.eigenvalues[0] / model.trace) == pytest.approx(1, rel=1e-9)
