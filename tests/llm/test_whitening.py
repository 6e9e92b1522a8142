"""Whitening against exact integers and library eigenvectors."""

from __future__ import annotations

import numpy as np
import pytest

from dqimpact.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int, `n.n` int"


def _orthogonal(rng, d: int) -> np.ndarray:
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - q.T @ q / 2)
    return q


@pytest.mark.parametrize(
    "values",
    [
        list(np.linspace(1, 2, 64)),
        [1 + 1e-9 * i for i in range(32)] + list(np.linspace(2, 3, 16)),
        [1 + 1e-13 * i for i in range(10)] + [5, 5 + 1e-10, 7, 8],
        [1.0] * 10 + [2.0] * 10 + [3.0],
        [0.0] * 5 + [1.0, 2.0],
        [10.0**-k for k in range(16)],
        [3.0],
    ],
    ids=["spread", "near", "nearer", "equal", "flat", "steep", "one"],
)
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(5)
    d = len(values)
    q = _orthogonal(rng, d)
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined_eigenvectors(a)
    wide = x.astype(np.longdouble)
    assert np.allclose(found, sorted(values, reverse=True), rtol=1e-14, atol=1e-15 * max(values))
    assert np.abs(wide.T @ wide - np.eye(d)).max() < 1e-14
    assert np.abs(a @ wide - wide * found).max() < 1e-15 * max(values)


def test_single_precision_alone_would_not_do():
    rng = np.random.default_rng(6)
    q = _orthogonal(rng, 40)
    a = q @ np.diag(np.linspace(1, 2, 40).astype(np.longdouble)) @ q.T
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    assert np.abs(rough.T @ rough - np.eye(40)).max() > 1e-8
    fine = whitening.refined_eigenvectors(a)[1]
    assert np.abs(np.abs(np.sum(fine * q[:, ::-1], axis=0)) - 1).max() < 1e-15


def _check(rows, vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, d = x.shape
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    shares = values / values.sum()
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * min(components, d)
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for k in range(min(components, d)):
        mine = np.array([got[i, k + 1]["whitened"] for i in range(n)])
        plain = centred @ axes[:, k] / np.sqrt(values[k])
        assert np.allclose(mine, plain, atol=1e-6) or np.allclose(mine, -plain, atol=1e-6)
        assert abs(got[0, k + 1]["explained"] - shares[k]) <= 1e-12
    assert [got[i, 1]["deviation"] for i in range(n)] == deviation.tolist()
    assert {r["n"] for r in rows} == {n} and {r["identity_error"] for r in rows} == {rows[0]["identity_error"]}
    assert rows[0]["identity_error"] < 1e-9


def test_query_on_all_vectors(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in table] == list(range(len(table)))
    _check(registry.QUERIES["op13_whitening"](spark, folder).collect(), [r["embedding"] for r in table])


def test_narrow_vectors_far_from_zero(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 5)) * [1, 1, 8, 3, 20] + 50_000).astype(np.float32).tolist()
    rows = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in enumerate(vectors)], SCHEMA)
    _check(whitening.whiten(rows).collect(), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [1e30, 0.0, 0.0]),
        (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (None, [2.0, 5.0, 3.0]), (9, [0.0, 1.0, 3.0]),
    ]
    rows = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in odd], SCHEMA)
    got = whitening.whiten(rows).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["8"] * 6 + ["9"] * 3 + ["None"] * 3
    # The third dimension never changes, so one component has no variance.
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert {r["n"] for r in got} == {4} and all(r["identity_error"] < 1e-12 for r in got)
    assert whitening.whiten(rows.filter("vec_id < 3")).count() == 0
    alone = whitening.whiten(rows.filter("vec_id = 9")).collect()
    assert [r["whitened"] for r in alone] == [None] * 3 and {r["deviation"] for r in alone} == {0}
    same = whitening.whiten(rows.filter("vec_id = 8")).collect()
    assert {r["deviation"] for r in same} == {0} and len(same) == 6


def test_deviations_beyond_64_bits_are_null(spark):
    far = [(0, [2.0**50, 0.0]), (1, [-(2.0**50), 1.0]), (2, [0.0, 2.0])]
    rows = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in far], SCHEMA.replace("float", "double"))
    got = {r["vec_id"]: r for r in whitening.whiten(rows).collect() if r["component"] == 1}
    assert got[0]["deviation"] is None and got[2]["deviation"] == (3 * 2 * 64 - 3 * 64) ** 2
