"""Token counts and packing against the tokenizer library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm.packing import best_fit, pack
from cohortlens.llm.pretokens import pretokenizer
from cohortlens.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, it's 12 o'clock: we'll see!",
    "",
    None,
    "a" * 5000 + " _under_score_ --- ''s 'll'd",
    "İstanbul ſ Σας ΣΑΣ é ﬁ ½ ² ª  x y\x85z\x1cw",
    "<|endoftext|> and <|startoftext|>x <|EndOfText|>",
    "日本語 テスト 한국어 \U0001f600 café Ça Ñandú groß ÀÉÎ×÷",
    "tab\tnew\nline\r\nvt\x0bff\x0c end  ",
    "Plain words, it's 12 o'clock: we'll see!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _docs(spark, texts=TEXTS):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, length int")


def test_pretokens_equal_library(library):
    tok = pretokenizer(PATH)
    for t in [t for t in TEXTS if t]:
        parts = tok.split(t)
        ids = tok.whole(t) if parts is None else [i for p in parts for i in tok.ids(p)]
        assert ids == library.encode(t, add_special_tokens=False).ids


def test_counts(spark, library):
    got = {r["doc_id"]: r for r in token_counts(_docs(spark), PATH, table_size=3, cache_size=4).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)


def test_counts_of_documents(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PATH).collect()} == want


def test_counts_of_nothing(spark):
    assert token_counts(_docs(spark, []), PATH).count() == 0


def _check_packing(rows, docs, library, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for key, t in docs.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ps = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(-(-len(ids) // capacity)))
        for p in ps:
            part = ids[p["start"] : p["start"] + capacity]
            assert (p["start"], p["length"], p["ids_crc32"]) == (p["piece"] * capacity, len(part), zlib.crc32(part.tobytes()))
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("partitions,capacity", [(1, 4096), (7, 4096), (40, 64)])
def test_packing(spark, sf_small, library, partitions, capacity):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").repartition(partitions, "doc_id")
    rows = pack(docs, PATH, capacity=capacity, fan_in=3).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = _check_packing(rows, texts, library, capacity)
    total = sum(r["length"] for r in rows)
    one_task = best_fit(np.array([r["length"] for r in rows]), capacity)[2]
    assert -(-total // capacity) <= n <= len(one_task) * 1.03 + 1


def test_packing_edge_rows(spark, library):
    rows = pack(_docs(spark), PATH, capacity=16).collect()
    _check_packing(rows, dict(enumerate(TEXTS)), library, 16)
    assert pack(_docs(spark, []), PATH).count() == 0


def test_many_bins_that_cannot_merge(spark, library):
    texts = ["word " * 39] * 200 + ["word " * 9] * 3
    rows = pack(_docs(spark, texts).repartition(20), PATH, capacity=64, fan_in=4).collect()
    assert _check_packing(rows, dict(enumerate(texts)), library, 64) == 200
