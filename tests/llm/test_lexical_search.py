"""Search against a score of every document for every item, and against SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import lexical_search
from cohortlens.llm.lexical_search import Items, class_scores, search, terms
from cohortlens.llm.queries import ORACLE, QUERIES

DOC, ITEM = "doc_id bigint, text string, score double, h string", "item_id bigint, text string, rank int"


def brute_terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=50):
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    df = Counter(t for _, b in bags for t in b)
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            score = 0
            for t in set(brute_terms(text)) & set(b):
                m = 100 - 50 + (50 * b.total() * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def _corpus(seed=1, n=500):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "ß", "10", "x2"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 8, 30]))) for _ in range(40)]
    docs = [(i, rng.choice(texts) if rng.random() < 0.7 else " ".join(rng.choices(words, k=12)).upper()) for i in range(n)]
    docs += [(1000 + i, texts[0] + "!") for i in range(150)]  # one class of a quarter of the rows
    docs += [(2000, None), (2001, ""), (2002, " .,;\n\t"), docs[0], docs[0], (None, texts[0]), (None, None)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)]
    items += [(100, None), (101, "..."), (102, "absent terms"), (103, texts[0]), (103, texts[0]), (None, "w1 w2")]
    return docs, items


def _frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 0.5, "h") for r in docs], DOC).repartition(6)
    return d, spark.createDataFrame([(*r, 1) for r in items], ITEM)


@pytest.mark.parametrize("postings", [1_000_000, 20])
def test_against_all_scores(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)  # 20: several blocks
    docs, items = _corpus()
    got = search(*_frames(spark, docs, items)).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_few_results_wanted(spark):
    docs, items = _corpus(seed=3, n=80)
    got = search(*_frames(spark, docs, items), k=3).collect()
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = _frames(spark, *_corpus(n=20))
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(docs.where("text IS NULL"), items).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_terms():
    text = "Ab-c1 É\x80x_y\x7fZ[q]`r{s} t\x00u"
    assert [t.decode() for t in terms(text.encode())] == brute_terms(text)
    assert terms(None) == []


def test_sums_of_many_terms():
    rng = np.random.default_rng(0)
    items = Items([{"item_id": 1, "terms": [b"%d" % i for i in range(200)]}, {"item_id": 2, "terms": [b"5", b"9"]}])
    held = [np.sort(rng.choice(200, 50, replace=False)) for _ in range(9)]
    bags = [h.astype("<u4").tobytes() + rng.integers(1, 9, 50).astype("<u4").tobytes() for h in held]
    m, w = rng.integers(50, 900, 9), rng.integers(0, 40_000, 200)
    exact = class_scores(bags, m, items, w)
    items.most = 10**9
    assert (exact == class_scores(bags, m, items, w)).all() and exact[:, 0].min() > 0


def test_query_against_sql(spark, sf_small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE['op13_lexical_search']})").fetchall()
    got = QUERIES["op13_lexical_search"](spark, sf_small).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500
