import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidewatch.llm.queries import QUERIES
from tidewatch.llm.whitening import above, deviations, inertia, leading, whitened

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 9), st.integers(0, 10_000))
@settings(max_examples=150, deadline=None)
def test_inertia_counts_signs_of_eigenvalues(d, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (d, d)).astype(float)
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    if np.abs(values).min() > 1e-9:
        assert inertia(a) == ((values < 0).sum(), (values > 0).sum())
    assert above(a, 0.1234567) == (values > 0.1234567).sum()


@pytest.mark.parametrize("kind", ["random", "close", "equal", "low rank", "diagonal", "graded"])
def test_leading_components(kind):
    rng = np.random.default_rng(5)
    d = 24
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = {
        "random": rng.random(d) * 10, "close": 5 + np.arange(d) * 1e-9, "equal": np.repeat([4.0, 2.0, 1.0], d // 3),
        "low rank": np.concatenate([rng.random(5) + 1, np.zeros(d - 5)]), "diagonal": np.arange(d) + 1.0,
        "graded": 10.0 ** -np.arange(d),
    }[kind]
    a = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = leading(a, 16)
    want = np.sort(e)[::-1][:16]
    want = want[want > 1e-12]
    assert abs(len(values) - len(want)) <= 2 * (kind == "graded")  # where zero begins is a matter of rounding
    k = min(len(values), len(want))
    assert np.allclose(values[:k], want[:k], atol=1e-12 * want[0], rtol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * np.abs(a).sum()
    assert leading(np.zeros((3, 3)), 16)[0].size == 0


def brute(rows, components=16):
    """From (id, vector): n, {id: deviation}, {id: projections}, explained, by whole numbers and numpy."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.append((i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), c @ q / np.sqrt(e)))
    return n, out, e / np.trace(v)


def compared(found, rows, components):
    n, want, share = brute(rows, components)
    assert len(found) == len(want) * components
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    signs = np.sign([by[want[0][0]][k + 1].whitened * want[0][2][k] for k in range(components)])
    for i, deviation, parts in want:
        assert {r.deviation for r in by[i].values()} == {deviation}
        got = np.array([by[i][k + 1].whitened for k in range(components)])
        assert np.allclose(got * signs, parts, atol=1e-7)


def test_query_equals_whole_numbers(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(QUERIES["op12_embedding_whitening"](spark, SF).collect(), rows, 16)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=3).round(3).tolist()) for k in range(40)]
    same = [(100 + k, good[0][1]) for k in range(60)]  # copies count once
    nan, inf = float("nan"), float("inf")
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [nan, 0.0, 0.0]), (203, [inf, 0.0, 0.0]), (204, []), (205, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, id string, v string, x string, n string, line string"
    docs = spark.createDataFrame([(i, v, *["c"] * 5) for i, v in good + same + bad], schema).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in docs.collect() if r.vec_id < 200]
    found = whitened(docs).collect()
    assert {r.vec_id for r in found} == {i for i, _ in good + same}
    compared(found, rows, 3)
    repeated = docs.selectExpr("CAST(NULL AS long) AS vec_id", "embedding")
    assert whitened(repeated, components=2).count() == 2 * len(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitened(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])], "vec_id long, embedding array<double>")
    assert whitened(one).count() == 0 and whitened(one.where("vec_id = 3")).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitened(flat).collect()} == {1}


def test_large_numbers():
    x = np.array([[1 << 40, 3], [5, 1 << 41]])
    n, sums = 1000, [12345, -77]
    want = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
    assert deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    x = np.array([[1_000_001, 999_999], [1_000_000, 1_000_003]])
    assert deviations(x, 2, [2_000_001, 2_000_002]) == [sum((2 * a - s) ** 2 for a, s in zip(r, (2_000_001, 2_000_002))) for r in x.tolist()]
