"""Toxicity: pairwise interactions, held-out accuracy, edge rows."""

import random
import zlib

import numpy as np
import pytest

from cohortlens.llm.toxicity import FactorizationMachine, fit, interacting, log_likelihood_ratio, score_documents, terms, train


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = FactorizationMachine(0.3, rng.normal(size=32), rng.normal(size=(32, 3)), np.ones(32, bool))
    rows = [np.array([1, 4, 9, 30]), np.array([], int), np.array([7])]
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    want = [0.3 + m.w[r].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(r) for b in r[i + 1 :]) for r in rows]
    assert np.allclose(m.margin(np.concatenate(rows), start), want)


def test_learns_an_interaction_that_no_linear_weights_can():
    """Either term alone is harmless or harmful at random; alike or not decides."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([0 + a, 2 + b]))
        labels.append(float(a == b))
    m = fit(rows, np.array(labels), np.ones(8, bool), epochs=40)
    start = np.arange(0, 2 * len(rows) + 1, 2)
    assert ((m.margin(np.concatenate(rows), start) > 0) == np.array(labels)).mean() > 0.95


@pytest.mark.parametrize("other", [("", ""), ("meadow", "window")])
def test_interaction_of_ordinary_words_is_learnt(spark, other):
    """Each word is as common in either class; only their meeting tells (half the rows hold each)."""
    rnd = random.Random(5)
    filler = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, truth = [], {}
    for i in range(4000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = [rnd.choice(filler) for _ in range(rnd.randrange(5, 40))] + ["river" if a else other[0], "stone" if b else other[1]]
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        truth[i] = int(a != b)
    labels = spark.createDataFrame(list(truth.items()), "doc_id bigint, toxic int")
    got = score_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), labels).where("held_out").collect()
    assert len(got) > 700 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) >= 0.9


@pytest.mark.parametrize("block", [2, 5, 64])
def test_pairs_that_tell_more_than_their_terms(block):
    rng = np.random.default_rng(3)
    held = rng.random((3000, 12)) < 0.4
    held[:, 7] = held[:, 6]  # a term's stem
    y = np.where(rng.random(3000) < 0.05, 1 - (held[:, 2] ^ held[:, 9]), held[:, 2] ^ held[:, 9])
    among = np.arange(12) * 10
    rows = [np.concatenate((among[h], [5, 33])) for h in held]
    assert np.flatnonzero(interacting(rows, y.astype(float), among, block)).tolist() == [2, 9]
    additive = (held[:, 2].astype(int) + held[:, 9] + rng.normal(0, 0.7, 3000)) > 0.9
    assert not interacting(rows, additive.astype(float), among, block).any()
    assert not interacting(rows, np.zeros(3000), among, block).any() and not len(interacting([], np.zeros(0), among[:0], block))


def test_the_sample_is_drawn_by_label(spark):
    """A rare label isn't thinned out by the bound, and the bias keeps the labels' shares."""
    rows = [(i, "rude word" if i % 50 == 0 else f"fine day{i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i, _ in rows], "doc_id bigint, label int")
    few, full = train(docs, labels, sample_rows=2000), train(docs, labels)
    hit = [m.margin(*terms(["rude word", "fine day", ""])) for m in (few, full)]
    assert all(x[0] > 0 > x[1] and x[2] < 0 for x in hit)
    again = train(docs.repartition(5), labels, sample_rows=2000)
    assert again.bias == few.bias and (again.w == few.w).all()


def test_terms_are_distinct_and_per_text():
    t, s = terms(["Stupid stupid STUPIDLY", "", None, "été 12"])
    assert list(np.diff(s)) == [len(set(t[s[0] : s[1]].tolist())), 0, 0, len(set(t[s[3] : s[4]].tolist()))]
    assert set(terms(["stupid"])[0].tolist()) < set(t[: s[1]].tolist())
    only = np.zeros(1 << 18, bool)
    only[t[0]] = True
    assert terms(["Stupid stupid STUPIDLY"], only=only)[0].tolist() == [t[0]]


def test_ratio_is_zero_without_a_difference():
    g = log_likelihood_ratio(np.array([5.0, 50.0]), np.array([10.0, 0.0]), 100.0, 200.0)
    assert abs(g[0]) < 1e-9 and g[1] > 50


def test_held_out_accuracy(spark, sf_small):
    folder = sf_small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in score_documents(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    held = [i for i in truth if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and all(0 <= r["score"] <= 1 for r in got.values())
    hit = [got[i]["predicted"] == truth[i] for i in held]
    toxic = [got[i]["predicted"] for i in held if truth[i]]
    assert sum(hit) >= 0.97 * len(hit) and sum(toxic) >= 0.8 * len(toxic)


def test_edge_rows(spark):
    rows = [(i, "you total idiot" if i % 2 else "a nice day") for i in range(200)]
    rows += [(500, None), (501, ""), (502, "12 --"), (503, "idiot " * 30_000), (None, "idiot"), (1, "you total idiot")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id bigint, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    got = score_documents(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["predicted"] == 1 and by[2]["predicted"] == 0 and by[503]["predicted"] == 1 and by[None]["held_out"] is False
    assert by[500]["score"] == by[501]["score"] == by[502]["score"]


@pytest.mark.parametrize("rows", [[], [(1, "some text")]])
def test_without_labels(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = score_documents(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert [r["score"] for r in got] == [0.5] * len(rows)
