"""Exact nearest neighbours against all pairs."""

import numpy as np
import pytest

from cohortlens.operators import neighbours
from cohortlens.operators.models import standardised_neighbours


def _brute(x, k):
    out = {}
    for i, row in enumerate(x):
        d = np.sqrt(((x - row) ** 2).sum(1))
        d[i] = np.inf
        out[i] = np.lexsort((np.arange(len(x)), d))[: min(k, len(x) - 1)].tolist()
    return out


def _data(kind, n, rng):
    if kind == "uniform":
        return rng.random((n, 3))
    if kind == "clusters":  # half of the rows in one dense spot
        x = rng.normal(size=(n, 4)) * 5
        x[: n // 2] = rng.normal(size=(n // 2, 4)) * 0.01
        return x
    return rng.integers(0, 3, (n, 4)).astype(float)  # many equal rows and ties


def _found(spark, x, k, block):
    names = [f"c{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, " + ", ".join(f"{c} double" for c in names))
    got, work = neighbours.neighbours_and_work(df.repartition(4), names, "id", k, block)
    out = {}
    for r in got.orderBy("_a", "_j").collect():
        out.setdefault(r["_a"], []).append(r["_b"])
    return out, work


@pytest.mark.parametrize("kind", ["uniform", "clusters", "ties"])
def test_five_thousand_rows(spark, kind):
    x = _data(kind, 5000, np.random.default_rng(6))
    got, work = _found(spark, x, 5, 128)
    assert got == _brute(x, 5)
    assert work["blocks"] >= 39
    if kind != "ties":
        assert work["visits"] < 0.35 * 5000 * work["blocks"]  # most blocks are ruled out


@pytest.mark.parametrize("n", [1, 2, 4, 40])
def test_few_rows(spark, n):
    x = _data("uniform", n, np.random.default_rng(n))
    got, _ = _found(spark, x, 5, 8)
    assert got == {i: b for i, b in _brute(x, 5).items() if b}


def test_visitors_of_a_block_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VISITORS", 16)
    x = _data("clusters", 600, np.random.default_rng(1))
    assert _found(spark, x, 3, 32)[0] == _brute(x, 3)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id bigint, c double")
    assert neighbours.nearest_neighbours(df, ["c"], "id", 3).count() == 0


def test_standardised(spark):
    x = np.random.default_rng(3).normal(size=(300, 3)) * [1, 100, 0.01]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, c double")
    rows = standardised_neighbours(df, ["a", "b", "c"], "id", 5).orderBy("_a", "_j").collect()
    want = _brute((x - x.mean(0)) / x.std(0, ddof=1), 5)
    assert {i: [r["_b"] for r in rows if r["_a"] == i] for i in range(300)} == want


def test_nearest_of_a_block_breaks_ties_by_id():
    from cohortlens.operators import neighbours as nb

    rng = np.random.default_rng(5)
    for trial in range(60):
        n, m, k = rng.integers(1, 12), rng.integers(1, 12), int(rng.integers(1, 6))
        d = rng.integers(0, 4, size=(n, m)).astype(float)  # many equal distances
        d[rng.random((n, m)) < 0.2] = np.inf
        ids = rng.permutation(m)
        rows, cols = nb._nearest(ids, d, k)
        wanted = [(i, j) for i in range(n) for j in sorted(range(m), key=lambda j: (d[i, j], ids[j]))[:k] if np.isfinite(d[i, j])]
        assert list(zip(rows.tolist(), cols.tolist())) == wanted
        x, y = rng.normal(size=(n, 9)), rng.normal(size=(m, 9))
        np.testing.assert_allclose(nb._distances(x, y), np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2)), rtol=1e-12)


def test_visits_are_few_and_not_stored(spark, monkeypatch):
    """Nine columns, where a row's ball touches a large part of all blocks: it is sent to
    shelves of them, and no table of more rows than there are points is written."""
    stored, real = [], neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df: (lambda out: (stored.append(out.count()), out)[1])(real(df)))
    monkeypatch.setattr(neighbours, "VISITORS", 64)
    x = np.random.default_rng(8).normal(size=(4000, 9))
    got, work = _found(spark, x, 5, 16)
    assert got == _brute(x, 5)
    assert work["rows"] == 4000 and work["blocks"] >= 250
    assert 0 < work["visits"] < 0.25 * 4000 * work["blocks"]
    assert max(stored) <= 4000


def test_equal_rows_and_far_from_the_origin(spark):
    x = np.random.default_rng(2).integers(0, 2, (900, 2)).astype(float)  # four places
    assert _found(spark, x, 4, 16)[0] == _brute(x, 4)
    y = np.random.default_rng(3).random((900, 3)) * 1e-3 + 1e6
    assert _found(spark, y, 4, 16)[0] == _brute(y, 4)


def test_cells_of_the_tree():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(600, 3)), rng.integers(0, 2, (600, 2)).astype(float), np.zeros((9, 2)), rng.random((1, 2))):
        tree = neighbours._tree(x, 40)
        cells = tree.cells(x)
        assert len(tree.along) <= 40 and set(cells) <= set(range(len(tree.along)))
        assert len(set(cells)) == min(40, len(np.unique(x, axis=0)))
