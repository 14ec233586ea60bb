"""Whitening against an eigenvalue solver on whole covariance matrices."""

import numpy as np
import pytest

from footfall.llm import bidiagonal, whitening
from tests.llm.test_vectors import ODD, vectors_of


def covariance_parts(vectors):
    x = np.floor(1024.0 * np.array(vectors, dtype="f4").astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    return n, ((n * x - sums) ** 2).sum(axis=1), centred, centred.T @ centred / n


def check_rows(rows, ids, vectors, most=8):
    n, deviations, centred, cov = covariance_parts(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    found = sorted(rows, key=lambda r: r["component"])
    count = min(most, int((values > 1e-9 * values[0]).sum()))
    assert {r["component"] for r in rows} == set(range(1, count + 1))
    assert len(rows) == n * count and {r["n"] for r in rows} == {n}
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    for i, d in zip(ids, deviations, strict=True):
        assert {int(r["deviation"]) for r in by_id[i]} == {int(d)}
    white = np.array([[r["whitened"] for r in by_id[i][:: len(by_id[i]) // count]][:count] for i in ids])
    directions = np.linalg.lstsq(centred, white * np.sqrt(values[:count]), rcond=None)[0]
    assert np.abs(cov @ directions - directions * values[:count]).max() < 1e-8 * values[0]
    assert np.abs(white.T @ white / n - np.eye(count)).max() < 1e-9
    share = np.array([r["explained"] for r in by_id[ids[0]]][:: len(by_id[ids[0]]) // count])
    assert np.allclose(share, values[:count] / values.sum(), rtol=1e-9)
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_whitening_equals_plain_covariance(spark):
    rng = np.random.default_rng(3)
    values = (rng.standard_normal((700, 12)) @ np.diag(np.arange(1.0, 13.0)) / 10 + 5).tolist()
    rows = [(i, v) for i, v in enumerate(values)] + [r for r in ODD if r[1] is None or len(r[1]) == 0]
    rows += [(9040, [float("nan")] * 12), (9041, [float("inf")] + [0.0] * 11), (9042, [None] + [0.0] * 11)]
    df = vectors_of(spark, rows).repartition(40)
    check_rows(whitening.whiten(df).collect(), list(range(700)), values)


def test_few_directions_equal_variances_and_lengths(spark):
    corners = [(i, v) for i, v in enumerate(np.vstack([np.eye(4), -np.eye(4)]).tolist())]
    flat = [(100 + i, [float(i), 2.0 * i, 1.0, 7.0, 0.0]) for i in range(6)]
    same = [(200, [1.0, 2.0]), (201, [1.0, 2.0]), (300, [5.0])]
    rows = whitening.whiten(vectors_of(spark, [*corners, *flat, *same, *ODD])).collect()
    of = lambda low, high: [r for r in rows if r["vec_id"] is not None and low <= r["vec_id"] < high]
    assert {r["component"] for r in of(100, 200)} == {1}
    assert of(200, 400) == []
    # ODD holds a zero vector and one without an id, of four entries like the corners.
    fours = [r for r in rows if r["vec_id"] is None or r["vec_id"] < 100 or r["vec_id"] == 9100]
    assert {r["n"] for r in fours} == {10} and len(fours) == 40
    check_rows(of(100, 200), list(range(100, 106)), [v for _, v in flat])


def test_repeated_rows_count_and_all_come_back(spark):
    rng = np.random.default_rng(4)
    values = rng.standard_normal((30, 3)).tolist()
    rows = whitening.whiten(vectors_of(spark, [(i % 10, values[i % 10]) for i in range(30)])).collect()
    assert len(rows) == 90 and {r["n"] for r in rows} == {30}
    check_rows(rows, [i % 10 for i in range(30)], [values[i % 10] for i in range(30)])


def test_large_entries_stay_exact_and_too_large_ones_raise(spark):
    vectors = [[2.0**30, 1.0], [-(2.0**30), 2.0], [2.0**29, 3.0]]
    rows = whitening.whiten(vectors_of(spark, list(enumerate(vectors)))).collect()
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == want and max(want.values()) > 2**63
    with pytest.raises(Exception, match="vector 7 has a component beyond"):
        whitening.whiten(vectors_of(spark, [(6, [1.0]), (7, [1e30])])).collect()


def test_no_vectors(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, ODD[:5])).count() == 0


def triangle(matrix):
    r = np.linalg.qr(matrix, mode="r")
    return np.vstack([r, np.zeros((matrix.shape[1] - r.shape[0], matrix.shape[1]))])


@pytest.mark.parametrize("kind", ["plain", "graded", "ties", "close", "no_column", "few_rows", "copies"])
def test_solver_on_hard_matrices(kind):
    rng = np.random.default_rng(6)
    q, p = np.linalg.qr(rng.standard_normal((90, 30)))[0], np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = {
        "plain": rng.standard_normal((90, 30)),
        "graded": rng.standard_normal((90, 30)) * np.logspace(0, -9, 30),
        "ties": np.vstack([np.eye(30)] * 3),
        "close": q @ np.diag(np.r_[np.ones(10), 1 + 1e-12 * np.arange(10), 1 + 1e-4 * np.arange(10)]) @ p.T,
        "no_column": rng.standard_normal((90, 30)) * (np.arange(30) % 7 != 0),
        "few_rows": rng.standard_normal((9, 30)),
        "copies": np.tile(rng.standard_normal((90, 15)), 2),
    }[kind]
    squares, vectors = bidiagonal.leading_directions(triangle(a), 30)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    want = want[want > 1e-28 * want[0]]
    assert len(squares) == len(want)
    assert np.allclose(squares, want, rtol=1e-12 if kind != "graded" else 1e-8)
    assert np.abs(a.T @ a @ vectors - vectors * squares).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(squares))).max() < 1e-11


def test_solver_without_variance():
    assert bidiagonal.leading_directions(np.zeros((3, 3)), 8)[0].size == 0
    squares, vectors = bidiagonal.leading_directions(np.array([[-2.0]]), 8)
    assert squares.tolist() == [4.0] and vectors.tolist() == [[1.0]]
