"""PPM scores against a direct dictionary implementation, and the base by hand."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm.ppm import _assembled, build_trie, cached_levels, code_lengths, context_levels, score_documents, symbol_codes, tokens


def _direct(train, texts, order):
    """PPM-D with exclusion, symbol by symbol."""
    after = defaultdict(Counter)
    stream = lambda d: b"\n" * order + b" ".join(d) + b"\n"
    for d in train:
        s = stream(d)
        for i in range(order, len(s)):
            for k in range(order + 1):
                after[s[i - k : i]][s[i]] += 1
    unseen = 256 - len(after[b""])
    out = []
    for d in texts:
        s, total = stream(d), 0.0
        for i in range(order, len(s)):
            barred: set = set()
            for k in range(order, -1, -1):
                seen = after.get(s[i - k : i])
                if seen is None:
                    continue
                free = {x: c for x, c in seen.items() if x not in barred}
                if not free:
                    continue
                t = sum(free.values())
                if s[i] in free:
                    total += math.log10((free[s[i]] - 0.5) / t)
                    break
                total += math.log10(0.5 * len(free) / t)
                barred |= set(seen)
            else:
                total -= math.log10(unseen)
        out.append(total)
    return out


TEXTS = ["the cat sat on the mat", "The  cat\tate\nthe rat", "", "été à la plage", "zzz qqq \x00 the the the cat", "the cat sat on the hat " * 30]


@pytest.mark.parametrize("order", [1, 3, 5])
def test_code_lengths_equal_direct_ppm(order):
    train, test = [tokens(t) for t in TEXTS[:4]], [tokens(t) for t in TEXTS]
    codes, n = np.unique(symbol_codes(train, order)[0], return_counts=True)
    trie = build_trie(codes, n.astype(float), order)
    c, ends = symbol_codes(test, order)
    logs = code_lengths(trie, c)
    got = [part.sum() for part in np.split(logs, ends[:-1])]
    assert np.allclose(got, _direct(train, test, order), rtol=1e-5)


def test_probabilities_sum_to_one():
    train = [tokens(t) for t in TEXTS]
    codes, n = np.unique(symbol_codes(train, 3)[0], return_counts=True)
    trie = build_trie(codes, n.astype(float), 3)
    for context in (b"the", b"cat", b"xyz", b"\n\n\n", b" ca"):
        q = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert abs((10 ** code_lengths(trie, q)).sum() - 1) < 1e-4


def _expected(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words = {i: [w.decode() for w in tokens(t)] + ["<end>"] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


@pytest.mark.parametrize("frequent", [2, 1000])
def test_base_and_counts(spark, frequent):
    docs = dict(enumerate(TEXTS * 3)) | {100: None, 101: "A B c", 1007: "\x0b \x0c"}
    df = spark.createDataFrame([(*r, 1, "w") for r in docs.items()], "doc_id bigint, text string, n long, word string")
    got = {r["doc_id"]: r for r in score_documents(df, frequent=frequent).collect()}
    want = _expected(docs)
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    train = [tokens(docs[i]) for i in docs if not want[i][0]]
    assert [got[i]["score"] for i in docs] == pytest.approx(_direct(train, [tokens(t) for t in docs.values()], 5), rel=1e-4)


def test_model_beats_the_base_on_held_out_documents(spark, sf_small):
    docs = spark.read.parquet(sf_small.replace("sf0.001", "sf0.1") + "/documents.parquet")
    rows = [r for r in score_documents(docs).collect() if r["held_out"]]
    assert len(rows) > 50 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("max_entries", [0, 3000, 60_000])
def test_scores_dont_depend_on_the_cache(spark, sf_small, max_entries):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = {r["doc_id"]: r for r in score_documents(docs).collect()}
    got = {r["doc_id"]: r for r in score_documents(docs, max_entries=max_entries).collect()}
    assert set(got) == set(want) and len(got) == docs.count()
    for i, r in got.items():
        assert r["score"] == pytest.approx(want[i]["score"], rel=1e-7, abs=1e-6)
        assert r[:6] == want[i][:6]


def test_cache_holds_whole_contexts(spark):
    grams = spark.createDataFrame([(int(c), int(n)) for c, n in zip(*np.unique(symbol_codes([tokens(t) for t in TEXTS], 3)[0], return_counts=True))], "code bigint, n bigint")
    parts, unseen, whole = cached_levels(context_levels(grams, 3), 25)
    assert whole[0] and not whole[3] and 0 < unseen < 256
    codes = np.array([r["code"] for r in grams.collect()], np.uint64)
    n = np.array([r["n"] for r in grams.collect()], float)
    full, cache = build_trie(codes, n, 3), _assembled(3, parts, unseen, whole)
    asked, _ = symbol_codes([tokens(t) for t in [*TEXTS, "a new text xyz"]], 3)
    a, b = code_lengths(full, asked), code_lengths(cache, asked)
    known = ~np.isnan(b)
    assert (a[known] == b[known]).all() and 0.02 < known.mean() < 1 and not np.isnan(a).any()


def test_one_id_with_different_texts(spark):
    rows = [(0, "alpha beta beta"), (0, "gamma"), (3, "alpha gamma gamma delta")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not any(zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows)
    want = sorted((len(t.split()) + 1, len(t.split()) + 1) for _, t in rows)
    got = score_documents(df, frequent=1).collect()
    assert sorted((r["n_tokens"], r["n_known"]) for r in got) == want


@pytest.mark.parametrize("rows", [[], [(None, "x")], [(2, None)] * 2, [(9, "only held out"), (13, "here")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert score_documents(df).count() == sum(i is not None for i, _ in rows)
