import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import whitening
from shelfspark.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, component string, dim string, n string"


def _rows(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "c", "d", "n") for i, v in enumerate(vectors)]


def _check(out, rows, k=4, ids=lambda i: True):
    """Against numpy's eigenvectors and exact integers, for rows of one dimension
    (those of ``ids`` that hold for them are compared)."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept, out = [(i, x) for i, x in kept if ids(i)], [r for r in out if ids(r["vec_id"])]
    got = sorted((r["vec_id"], r["component"], r["deviation"]) for r in out)
    assert got == sorted((i, c + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept for c in range(k))
    by = {}
    for r in out:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    for c, found in by.items():
        want = {i: float((np.array(x) - np.array(sums) / n) @ u[:, c - 1] / np.sqrt(e[c - 1])) for i, x in kept}
        sign = np.sign(sum(want[i] * found[i] for i in want))
        assert all(found[i] == pytest.approx(sign * want[i], abs=1e-8) for i in want)


def test_whitening_equals_numpy(spark):
    random = np.random.default_rng(3)
    vectors = (random.standard_normal((400, 12)) @ random.standard_normal((12, 12))).tolist()
    # copies, a repeated row, null, holes, infinities
    rows = _rows(vectors + [vectors[0]] * 150 + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11])
    rows += [rows[5], (None, vectors[7], 1, 2, "c", "d", "n")]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    _check(out, rows, ids=lambda i: i not in (None, 5))
    assert sum(r["vec_id"] == 5 for r in out) == 8 and sum(r["vec_id"] is None for r in out) == 4


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame(_rows([None, []]), SCHEMA)).collect() == []
    # one distinct vector has no variance
    assert whitening.whiten(spark.createDataFrame(_rows([[1, 2]] * 3), SCHEMA)).collect() == []
    # one dimension, and constant entries: only components with variance
    out = whitening.whiten(spark.createDataFrame(_rows([[1, 5, 5], [2, 5, 5], [4, 5, 5]]), SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in out) == [(0, 1), (1, 1), (2, 1)]
    assert {round(r["explained"], 12) for r in out} == {1.0}
    # dimensions are fitted apart
    mixed = whitening.whiten(spark.createDataFrame(_rows([[1], [2], [4], [1, 0], [0, 1], [3, 3]]), SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in mixed) == [(0, 1, 3), (1, 1, 3), (2, 1, 3)] + [(i, c, 3) for i in (3, 4, 5) for c in (1, 2)]


def test_deviation_is_exact_beyond_doubles_and_null_beyond_longs(spark):
    rows = [(0, [2.0**20, 0.0], 1, 2, "c", "d", "n"), (1, [1.0, 1.0], 1, 2, "c", "d", "n"), (2, [-3.0, 2.0], 1, 2, "c", "d", "n")]
    out = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [[int(256 * c) for c in v] for _, v, *_ in rows]
    s = [sum(c) for c in zip(*x)]
    assert out == {i: sum((3 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(3)}
    rows[0] = (0, [2.0**40, 0.0], 1, 2, "c", "d", "n")
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {None}
    rows[0] = (0, [3.0e38, 0.0], 1, 2, "c", "d", "n")  # beyond the range of long integers
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() > 0


def _random_orthogonal(n, seed):
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]


@pytest.mark.parametrize("values", [
    [5.0], [3.0, 1.0], [2.0, 2.0, 2.0], [9.0, 9.0 - 1e-13, 9.0 - 2e-13, 1.0, 0.5, 0.1],
    list(np.linspace(1, 2, 40)), [1.0] * 10 + [1e-3] * 20, list(10.0 ** np.arange(3, -9, -1.0))])
def test_leading_eigenpairs(values):
    values = np.sort(np.array(values))[::-1]
    for q in (np.eye(len(values)), _random_orthogonal(len(values), 1)):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        k = min(4, len(values))
        e, u = whitening.leading_eigenpairs(a, k)
        assert len(e) == k and np.allclose(e, values[:k], rtol=1e-13 * len(values), atol=1e-14 * values[0])
        assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12
        assert np.abs(a @ u - u * e).max() < 1e-13 * len(values) * values[0]


def test_tridiagonal_keeps_eigenvalues_and_sturm_counts_them():
    a = _random_orthogonal(17, 5)
    a = a + a.T
    d, off, _ = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(off, 1) + np.diag(off, -1)
    e = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), e)
    at = np.linspace(-3, 3, 41)
    assert whitening.sturm_count(d, off, at).tolist() == [(e < x).sum() for x in at]


def test_query_op11(spark):
    out = op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    _check(out.collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert out.where(F.col("identity_error") > 1e-4).isEmpty()
