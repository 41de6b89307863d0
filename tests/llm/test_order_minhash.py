"""Order MinHash against all-pairs alignment, and connected components against union-find."""

import random
import re

import numpy as np
import pytest

from cohortlens.llm.components import connected_components
from cohortlens.llm.order_minhash import _sequences, aligned, near_duplicates


def _roots(vertices, links):
    up = {v: v for v in vertices}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in up}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_components(spark):
    rnd = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    some = [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(220)]
    links = chain + star + some + [(5, 5), (None, 7)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == _roots({v for e in real for v in e}, real)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(5)
    for _ in range(60):
        a = rnd.sample(range(90), 60)
        b = a[:]
        for _ in range(rnd.randrange(0, 14)):
            i = rnd.randrange(len(b))
            b = rnd.choice([b[:i] + b[i + 1 :], b[:i] + [rnd.randrange(1000, 99999)] + b[i:], b[i:] + b[:i]])
        want = _lcs(a, b)
        least = int(np.ceil(0.8 * max(len(a), len(b))))
        got = aligned(np.array(a, np.uint64), np.array(b, np.uint64), least)
        assert got == want if want >= least else got < least


def _brute(texts, threshold=0.8):
    seq = _sequences({i: t or "" for i, t in texts.items()})
    links = []
    for a in texts:
        for b in texts:
            if a < b and len(seq[a]) and len(seq[b]):
                longer = max(len(seq[a]), len(seq[b]))
                if min(len(seq[a]), len(seq[b])) >= threshold * longer and _lcs(seq[a].tolist(), seq[b].tolist()) >= threshold * longer - 1e-9:
                    links.append((a, b))
    return _roots(texts, links)


def _edited(rnd, words, edits):
    out = words[:]
    for _ in range(edits):
        i = rnd.randrange(len(out))
        out[i : i + 1] = rnd.choice([[], ["new" + str(rnd.random())], [out[i], "more"]])
    return " ".join(out)


def test_against_all_pairs(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = {}
    shared = [rnd.choice(vocabulary) for _ in range(60)]
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 90, 150]))]
        if g % 3 == 0:
            base = shared + base
        for _ in range(rnd.choice([1, 2, 6])):
            texts[len(texts) * 7 % 1009] = _edited(rnd, base, rnd.randrange(0, 1 + len(base) // 60))
        if g % 4 == 0:
            texts[5000 + g] = " ".join(base[len(base) // 2 :] + base[: len(base) // 2])  # same words, other order
    texts |= {900_000: "", 900_001: None, 900_002: "one two", 900_003: "One, two!", 900_004: "--- ...", 900_005: "Été à Paris"}
    texts |= {900_006 + i: "the same line of text again " * 30 for i in range(5)}
    rows = [(i, t, "clash", i) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rep string, n bigint")
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    want = _brute(texts)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert got[900_003]["class_id"] == 900_002 and got[900_001]["class_id"] == 900_001
    assert got[900_009]["class_size"] == 5


def test_documents_recall(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(re.findall(r"\w+", r["text"] or "")) < 1200}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs.where(docs["doc_id"].isin(list(texts)))).collect()}
    want = _brute(texts)
    together = [i for i in want if want[i] != i]
    assert together and sum(got[i] == want[i] for i in together) >= 0.97 * len(together)
    assert all(want[i] == want[got[i]] for i in got)  # nothing joined that all pairs keep apart


@pytest.mark.parametrize("rows", [[], [(1, "just one text with some words in it")], [(3, "a b c d e f g")] * 4])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_duplicates(docs).count() == len(rows)


def test_common_passages_and_near_copies_in_large_buckets(spark, monkeypatch):
    """The sieve loses no link that all pairs of a bucket would give."""
    import cohortlens.llm.order_minhash as m

    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(45)]
    texts = {}
    for i in range(40):  # strangers that share a passage, more or less of the text
        own = [f"o{rnd.randrange(10**6)}" for _ in range(rnd.choice([4, 9, 20, 60]))]
        texts[i] = " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])
    base = [f"b{i}" for i in range(120)]
    for i in range(30):
        texts[100 + i] = _edited(rnd, base, rnd.randrange(0, 9))
    want = _brute(texts)
    monkeypatch.setattr(m, "FEW", 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(docs, sketches=48).collect()}
    assert len(set(want.values())) > 5 and got == want
