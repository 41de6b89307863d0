"""Cross-polytope links against all pairs in double precision."""

import numpy as np
import pytest

from cohortlens.llm.vector_links import hadamard, link_vectors


def _brute(rows, threshold=0.98):
    good = {}
    for i, e, lab in rows:
        if e is None or lab is None or not len(e) or any(v is None for v in e):
            continue
        v = np.array(e, float)
        if np.isfinite(v).all() and np.any(v):
            v = v / np.abs(v).max()
            good[i] = (lab, v / np.linalg.norm(v))
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    ids = sorted(good)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


def _got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def test_hadamard_is_orthonormal():
    m = hadamard(np.eye(16))
    assert np.allclose(m @ m.T, np.eye(16))


@pytest.mark.parametrize("block", [512, 4])
def test_against_all_pairs(spark, block):
    rnd = np.random.default_rng(1)
    rows = []
    for g in range(25):
        base = rnd.normal(size=24)
        for _ in range(rnd.integers(1, 14)):
            rows.append((len(rows) * 3, (base + rnd.normal(size=24) * rnd.choice([0, 0.05, 0.14, 0.2])).tolist(), int(g % 3)))
    rows += [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [1.0, None], 1), (9004, [], 1)]
    rows += [(9005, rows[0][1], None), (9006, [float("inf")] + [1.0] * 23, 1), (9007, [1.0], 1), (9008, [2.0], 1), (9009, [-1.0], 1)]
    rows += [(9010 + i, rows[3][1], rows[3][2]) for i in range(9)]
    rows += [(9100, [v * 1e200 for v in rows[3][1]], rows[3][2]), (9101, [v * 1e-200 for v in rows[3][1]], rows[3][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, code string")
    assert _got(link_vectors(df, block=block)) == _brute(rows)


def test_embeddings(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert _got(link_vectors(df)) == _brute(rows)


def test_no_rows(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, None, 1)], "vec_id bigint, embedding array<float>, label int")
    assert _got(link_vectors(nulls)) == {1: (0, 1), 2: (0, 2)}
