"""Runs against a comparison of every word with the words of all distances."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cohortlens.llm.periodic_runs import SquareCatcher, crc_places, kept_words, periodic_runs, run_digest, runs_of
from cohortlens.llm.queries import QUERIES


def brute_runs(words, least=24, periods=3):
    """All maximal stretches of each period, the smallest period of each."""
    w, n, out = np.asarray(words), len(words), {}
    for q in range(1, n // periods + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[: n - q] == w[q:]).astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b + q - a >= max(least, periods * q):
                out.setdefault((a, b + q), q)
    return sorted((a, e - a, q) for (a, e), q in out.items())


def brute_row(doc_id, text):
    """The registered query's row of one document, from its contract."""
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = brute_runs([ids[w] for w in words])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def _sequence(rng):
    n, k = rng.randint(1, 300), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        a = rng.randrange(n)
        p, length = rng.randint(1, max(1, (n - a) // 3)), rng.randint(0, n - a)
        for i in range(a, a + length):
            w[i] = w[a + (i - a) % p]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = rng.randrange(k + 1)
    return np.array(w)


def test_any_number_of_words_at_a_time():
    rng = random.Random(2)
    for _ in range(400):
        w = _sequence(rng)
        want = brute_runs(w)
        for chunk in (1, 5, 64, 10**6) if len(w) < 120 else (17, 10**6):
            assert runs_of(w, chunk=chunk) == want


def test_runs_of_the_words_so_far():
    w = _sequence(random.Random(9)).repeat(2)
    catcher = SquareCatcher()
    for i in range(len(w)):
        catcher.append(w[i : i + 1])
        if i % 7 == 0:
            assert catcher.runs() == brute_runs(w[: i + 1])


def test_long_sequences():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 5000, 60_000)
    w[30_000:50_000] = np.resize(w[30_000:36_000], 20_000)
    w[100:200] = 7
    assert runs_of(w) == brute_runs_of_known(w, [(100, 200, 1), (30_000, 50_000, 6_000)])


def brute_runs_of_known(w, stretches):
    """The stretches grown to both sides."""
    out = []
    for a, e, q in stretches:
        while a > 0 and w[a - 1] == w[a - 1 + q]:
            a -= 1
        while e < len(w) and w[e] == w[e - q]:
            e += 1
        out.append((a, e - a, q))
    return sorted(out)


def test_least_sizes():
    assert runs_of(np.array([1] * 23)) == [] and runs_of(np.array([1] * 24)) == [(0, 24, 1)]
    assert runs_of(np.arange(30) % 10) == [(0, 30, 10)] and runs_of(np.arange(29) % 10) == []
    with pytest.raises(ValueError):
        SquareCatcher(min_periods=2)
    assert kept_words(30, [(0, 30, 10)]).sum() == 10


def _key(row):
    return str(tuple(row))


CASES = [(i, t) for i, t in enumerate(["", None, "a " * 40, "x", "la li lu " * 30 + "end", "  é b " * 30, " \t\n\x0b\x0c\r "])]


def test_edge_rows(spark):
    rows = [(i, t, "runs", 1) for i, t in CASES + [CASES[2], (None, "b " * 30), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int")
    got = run_digest(periodic_runs(docs, places=crc_places)).drop("n_words").collect()
    want = [brute_row(i, t) for i, t, *_ in rows if i is not None]
    assert sorted((r for r in got if r[0] is not None), key=_key) == sorted(want, key=_key)
    assert sorted(r["n_runs"] for r in got if r[0] is None) == [0, 1]
    assert run_digest(periodic_runs(docs.limit(0))).count() == 0


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, sf_small).drop("n_words").collect()
    want = [brute_row(*r) for r in docs]
    assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key)
    assert sum(r[1] for r in want) > 10
