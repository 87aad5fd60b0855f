import numpy as np
import pytest

from framelark.llm.eigen import leading_pairs, leading_values, sturm_count, tridiagonal
from framelark.llm.queries_exact import embedding_whitening
from framelark.llm.whitening import fit, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(rows, vectors, k=8):
    """``rows`` of whiten against numpy on the same vectors."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    got = np.array([r["whitened"] for r in rows])
    assert got.shape[1] == min(k, (values > 1e-9 * values[0]).sum())
    assert [r["deviation"] for r in rows] == [
        sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total)) for v in x]
    assert {r["n"] for r in rows} == {n}
    m = got.shape[1]
    assert np.allclose([r["explained"] for r in rows], values[:m] / np.trace(cov), rtol=1e-12)
    assert np.abs(got.T @ got / n - np.eye(m)).max() < 1e-9
    assert max(r["identity_error"] for r in rows) < 1e-9
    # Each column is the data on a unit eigenvector over the root of its value.
    for j in range(m):
        direction, *_ = np.linalg.lstsq(centred, got[:, j] * np.sqrt(values[j]), rcond=None)
        assert abs(np.linalg.norm(direction) - 1) < 1e-8
        assert np.abs(cov @ direction - values[j] * direction).max() < 1e-8 * values[0]


def frame(spark, vectors, partitions=3):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], i % 3)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def test_equals_numpy(spark):
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((400, 12)) @ draw.standard_normal((12, 12)) + 40
    rows = whiten(frame(spark, vectors)).orderBy("vec_id").collect()
    check(rows, vectors)


def test_rows_without_a_usable_vector(spark):
    draw = np.random.default_rng(2)
    vectors = [list(v) for v in draw.standard_normal((50, 3))]
    bad = [None, [], [1, None, 2], [1, float("nan"), 2], [float("inf"), 0, 0], [0, 0, -float("inf")]]
    rows = whiten(frame(spark, vectors + bad + vectors[:5])).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == [*range(50), *range(56, 61)]
    check(rows, vectors + vectors[:5])


def test_fewer_dimensions_and_ties(spark):
    """Dependent columns give fewer components, equal eigenvalues stay orthogonal."""
    signs = np.array([[a, b, c, a] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)] * 4)
    rows = whiten(frame(spark, signs)).orderBy("vec_id").collect()
    assert len(rows[0]["whitened"]) == 3
    got = np.array([r["whitened"] for r in rows])
    assert np.abs(got.T @ got / len(got) - np.eye(3)).max() < 1e-12
    assert np.allclose(rows[0]["explained"], [0.5, 0.25, 0.25])


def test_equal_single_and_no_vectors(spark):
    for vectors in ([[1, 2]] * 5, [[3, 4]]):
        rows = whiten(frame(spark, vectors)).collect()
        assert len(rows) == len(vectors)
        assert all(r["whitened"] == [] and r["deviation"] == 0 for r in rows)
    assert whiten(frame(spark, [None, []])).count() == 0
    assert fit(frame(spark, [])) is None


def test_large_entries_stay_exact(spark):
    """Products beyond 2**53, and means that would cancel without centring."""
    vectors = [[2e5 + i, 3e5 - (i % 7)] for i in range(40)] + [[1.6e5, 3.4e5]]
    check(whiten(frame(spark, vectors)).orderBy("vec_id").collect(), vectors)
    with pytest.raises(Exception, match="beyond 64 bits"):
        whiten(frame(spark, [[1e30, 1], [0, 1]])).collect()
    with pytest.raises(Exception, match="several widths"):
        whiten(frame(spark, [[1, 2], [1]]))


def test_clashing_names(spark):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((30, 4))
    docs = frame(spark, vectors).selectExpr(
        "vec_id", "embedding as `a.b`", "1 as n", "2 as whitened", "3 as v", "4 as c0", "5 as `x``y`")
    out = whiten(docs, "a.b")
    assert out.columns == ["vec_id", "a.b", "v", "c0", "x`y", "n", "deviation", "whitened",
                           "explained", "identity_error"]
    check(out.orderBy("vec_id").collect(), vectors)


def test_query_returns_a_row_per_component(spark):
    rows = embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 * 8 and {r["component"] for r in rows} == set(range(1, 9))
    assert max(r["identity_error"] for r in rows) < 1e-9


MATRICES = {
    "identity": np.eye(9), "zero": np.zeros((4, 4)), "ones": np.ones((20, 20)),
    "one": np.array([[3.0]]), "two": np.array([[2.0, 1], [1, 2]]),
    "tiny": 1e-250 * np.diag([1.0, 2, 3]), "huge": 1e250 * np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]]),
    "near ties": np.diag(1 + 1e-10 * np.arange(12)),
    "paired": np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
}


@pytest.mark.parametrize("name", MATRICES)
@pytest.mark.parametrize("turned", [False, True])
def test_leading_pairs(name, turned):
    a = MATRICES[name]
    if turned:
        q = np.linalg.qr(np.random.default_rng(4).standard_normal(a.shape))[0]
        a = q @ a @ q.T
        a = (a + a.T) / 2
    values, vectors = leading_pairs(a, 8)
    k = min(8, len(a))
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * size * len(a)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_sturm_counts():
    draw = np.random.default_rng(5)
    a = draw.standard_normal((30, 30))
    diagonal, off, _ = tridiagonal(a + a.T)
    values = np.linalg.eigvalsh(a + a.T)
    shifts = np.linspace(values[0] - 1, values[-1] + 1, 50)
    assert sturm_count(diagonal, off, shifts).tolist() == [(values < s).sum() for s in shifts]
    assert np.allclose(leading_values(diagonal, off, 30), values[::-1])
