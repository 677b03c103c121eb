"""Whitening against numpy's own eigendecomposition and Python's integers."""

import math

import numpy as np
import pytest

from panelkit.llm import op12_whitening as op
from panelkit.llm.op12_whitening import Spectrum, rank_one, secular_roots, whiten


def plain(rows, components):
    """(by id: deviation, whitened, explained) by one eigh over the distinct rows."""
    kept = [(i, [math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    total = [sum(x[k] for x in fit) for k in range(len(fit[0]))]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        y = np.array([(n * a - s) / n for a, s in zip(x, total)])
        out.append((i, sum((n * a - s) ** 2 for a, s in zip(x, total)), y @ v / np.sqrt(e)))
    return n, e / np.trace(centred.T @ centred / n), out


def held(spark, rows, components=16, parts=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    return whiten(df, components).collect()


@pytest.mark.parametrize("fit_rows,fan_in", [(op.FIT_ROWS, op.FAN_IN), (20, 2)])
def test_equals_one_eigendecomposition(spark, monkeypatch, fit_rows, fan_in):
    monkeypatch.setattr(op, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(op, "FAN_IN", fan_in)
    rng = np.random.default_rng(3)
    spread = np.linspace(0.2, 3, 20)
    rows = [(k, (rng.normal(size=20) * spread + 1).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]          # copies count once
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [1.0] * 19 + [float("inf")]),
             (None, rows[5][1]), (7, rows[7][1])]
    n, explained, expect = plain(rows, 16)
    got = held(spark, rows)
    assert len(got) == 16 * len(expect) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-10
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    sign = None
    for i, deviation, w in expect:
        mine = by[i]
        assert {r["deviation"] for r in mine.values()} == {deviation}
        have = np.array([mine[k]["whitened"] for k in range(1, 17)])
        sign = np.sign(have * w) if sign is None else sign
        np.testing.assert_allclose(have, sign * w, atol=1e-9)
        np.testing.assert_allclose([mine[k]["explained"] for k in range(1, 17)], explained, rtol=1e-10)


def test_test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    n, explained, expect = plain(rows, 16)
    got = {(r["vec_id"], r["component"]): r for r in held(spark, rows)}
    assert len(got) == 16 * len(rows)
    for i, deviation, w in expect[:50]:
        assert got[i, 1]["deviation"] == deviation and got[i, 1]["n"] == n
        np.testing.assert_allclose([abs(got[i, k]["whitened"]) for k in range(1, 17)], np.abs(w), atol=1e-8)


def test_few_vectors_and_low_rank(spark):
    assert held(spark, []) == []
    assert held(spark, [(1, None), (2, [])]) == []
    assert held(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []             # no variance
    line = held(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(4)])     # rank one
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    mixed = held(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, [3.0, 3.0])])
    assert {r["vec_id"] for r in mixed} == {1, 2, 4}                         # the odd length goes
    assert held(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])])[0]["n"] == 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0 + k * k], k, k) for k in range(6)],
                               "vec_id long, embedding array<float>, x long, component long")
    assert whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_raises():
    x = np.array([[1 << 40, 0]], dtype=np.int64)
    with pytest.raises(ValueError):
        op.deviations(x, 1 << 20, np.zeros(2, dtype=np.int64))
    big = op.deviations(np.array([[1 << 20, 3]]), 1 << 10, np.array([1, 2]))
    assert big[0] == ((1 << 30) - 1) ** 2 + (3 * 1024 - 2) ** 2


def test_updates_keep_the_decomposition():
    rng = np.random.default_rng(11)
    d, z2 = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 50.0]), np.array([1e-12, 3.0, 1e-5, 2.0, 1e-3])
    roots, diff = secular_roots(d, z2)
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    np.testing.assert_allclose((1 + (z2[:, None] / diff).sum(axis=0)), 0, atol=1e-6 * np.abs(z2[:, None] / diff).sum(axis=0).max())
    whole, values, basis = np.zeros((12, 12)), np.zeros(12), np.eye(12)
    for k in range(400):
        v = rng.normal(size=12) * (10.0 ** rng.integers(-4, 3))
        if k % 7 == 0:
            v[rng.integers(0, 12, 6)] = 0
        whole += np.outer(v, v)
        values, basis = rank_one(values, basis, v)
    np.testing.assert_allclose(basis @ np.diag(values) @ basis.T, whole, atol=1e-11 * values[-1])
    np.testing.assert_allclose(basis.T @ basis, np.eye(12), atol=1e-11)


def test_merged_spectra_equal_the_whole():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 8)) @ rng.normal(size=(8, 8)) + 3
    parts = [Spectrum(8) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 3].add(row)
    total = parts[0]
    for p in parts[1:]:
        total.merge(p)
    away = x - x.mean(axis=0)
    np.testing.assert_allclose(total.basis @ np.diag(total.values) @ total.basis.T, away.T @ away, atol=1e-9)
