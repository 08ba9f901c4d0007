"""Whitening against numpy on the whole table."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string, n long, label int"


def brute(rows, k):
    keep = [(i, e) for i, e in rows if e is not None and len(e) and all(c is not None and np.isfinite(c) for c in e)]
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in e] for _, e in keep])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = (fit * n - s) / n
    v = y.T @ y / n
    e, a = np.linalg.eigh(v)
    e, a = e[::-1][:k], a[:, ::-1][:, :k]
    return [i for i, _ in keep], n, ((x * n - s) ** 2).sum(1), ((x * n - s) / n) @ a / np.sqrt(e), e / np.trace(v)


def rows_of(seed, n, dim):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.linspace(1, 4, dim)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(n, dim)) @ mix)]
    hot = rows[3][1]
    rows += [(10_000 + i, list(hot)) for i in range(n // 2)]       # a third of all rows hold one vector
    return rows


def check(spark, rows, k=16, parts=5):
    df = spark.createDataFrame([(i, e, "c", 7, 1) for i, e in rows], SCHEMA).repartition(parts)
    got = W.whiten(df, k).toPandas().sort_values(["vec_id", "component"])
    ids, n, dev, z, share = brute(rows, k)
    k = z.shape[1]
    order = np.argsort(ids, kind="stable")
    assert got.vec_id.tolist() == [i for i in np.array(ids)[order] for _ in range(k)]
    assert got.component.tolist() == list(range(1, k + 1)) * len(ids)
    assert (got.n == n).all() and (got.deviation.to_numpy().reshape(-1, k) == dev[order][:, None]).all()
    mine = got.whitened.to_numpy().reshape(-1, k)
    z = z[order]
    assert np.allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), share, rtol=1e-6)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_equals_numpy(spark):
    check(spark, rows_of(1, 240, 24))


def test_fewer_dimensions_than_components(spark):
    check(spark, rows_of(2, 60, 5))


def test_several_blocks_and_slabs(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 16)
    monkeypatch.setattr(W, "SLAB_BLOCKS", 7)
    monkeypatch.setattr(W, "TASK_BLOCKS", 2)
    check(spark, rows_of(3, 200, 18), k=6, parts=3)


def test_rows_that_are_dropped_or_have_no_id(spark):
    rows = rows_of(4, 50, 4) + [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 0.0, 0.0]),
                                (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [])]
    check(spark, rows)
    df = spark.createDataFrame([(i if i < 40 else None, e, "c", 7, 1) for i, e in rows_of(4, 50, 4)], SCHEMA)
    got = W.whiten(df).toPandas()
    assert len(got) == 75 * 4 and got.vec_id.isna().sum() == 35 * 4


def test_lengths_are_apart_and_flat_directions_left_out(spark):
    rows = [(i, [float(i), float(i % 7), 2.0]) for i in range(40)] + [(100 + i, [float(i * i), 1.0]) for i in range(9)]
    got = W.whiten(spark.createDataFrame([(i, e, "c", 7, 1) for i, e in rows], SCHEMA)).toPandas()
    three, two = got[got.vec_id < 100], got[got.vec_id >= 100]
    assert sorted(three.component.unique()) == [1, 2] and three.n.unique().tolist() == [40]
    assert sorted(two.component.unique()) == [1] and two.n.unique().tolist() == [9]


def test_tables_without_a_component(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [2.0, 3.0], "", 0, 0), (2, [2.0, 3.0], "", 0, 0)], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [5, 1 << 40])
def test_deviations_stay_exact_for_any_count(n):
    x = np.array([[1_000_000, 1_000_003], [999_999, 1 << 51]])
    sums = [n * 1_000_001, n * 1_000_002 + 1]
    d = W.deviations(x, n, sums)
    want = [[n * int(v) - s for v, s in zip(r, sums)] for r in x]
    assert [[int(v) for v in r] for r in d] == want
    squares = [sum(v * v for v in r) for r in want]
    assert W.square_sums(d) == [s if s < 1 << 63 else None for s in squares]


def test_huge_entries_do_not_stop_the_run(spark):
    rows = [(i, [1e300 * (i % 2), float(i)]) for i in range(12)]
    got = W.whiten(spark.createDataFrame([(i, e, "c", 7, 1) for i, e in rows], SCHEMA)).toPandas()
    assert set(got.vec_id) == set(range(12))
