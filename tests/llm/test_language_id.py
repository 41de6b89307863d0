"""Language identification: held-out accuracy, each kind of evidence, fusion against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import cohortlens.llm.language_id as language_id
from cohortlens.llm.language_id import document_rows, fit_text_model, identify, page_rows, sampled

ROWS = "id bigint, text string, declared string, suffix string, host string, domain string"
EN, FR = "the cat and the dog were in the house with the children", "le chat et le chien sont dans la maison avec les enfants"


@pytest.fixture(scope="module")
def small_model(spark):
    rows = [(EN, "en"), (FR, "fr")] * 20
    return fit_text_model(spark.createDataFrame(rows, "text string, lang string"))


def _run(spark, model, rows):
    return {r["id"]: r for r in identify(spark.createDataFrame(rows, ROWS), model).collect()}


def test_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet(sf_small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = fit_text_model(docs.where(~held))
    test = document_rows(docs.where(held)).withColumns({"declared": F.lit(None).cast("string"), "host": F.lit(None).cast("string")})
    got = {r["id"]: r for r in identify(test, model).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.where(held).select("doc_id", "lang").collect()}
    assert len(want) > 100 and sum(got[i]["language"] == want[i] for i in want) >= 0.97 * len(want)
    assert sum(got[i]["accepted"] for i in want) >= 0.99 * len(want)


def test_pages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    rows = page_rows(pages).collect()
    by_id = {r["id"]: r for r in rows}
    for r in pages.limit(20).collect():
        e = by_id[r["page_id"]]
        assert e["host"] in r["url"] and e["host"].endswith(e["domain"]) and e["domain"].endswith(e["suffix"])
        assert "<" not in e["text"].replace("< ", "") and "track(" not in e["text"]
    assert identify(page_rows(pages), fit_text_model(docs)).count() == pages.count()


def test_evidence_is_weighed(spark, small_model):
    plain = [(i, EN if i % 2 else FR, "en" if i % 2 else "fr", "uk" if i % 2 else "fr", f"h{i % 2}.x", "x") for i in range(200)]
    rows = [
        (1000, "zoo", "fr", "fr", "h0.x", "x"),  # hardly any text: the rest decides
        (1001, "zoo", "en", "uk", "h1.x", "x"),
        (1002, EN * 20, "fr", "fr", "h0.x", "x"),  # plenty of text: it decides
        (1003, None, "fr", "fr", "h0.x", "x"),
        (1004, "", None, None, None, None),
        (1005, "12 34 -- !!", "en", None, "h1.x", None),
        (1006, "漢字仮名交じり文" * 40, None, None, None, None),
        (1007, EN, "tlh", "zz", "new.host", "host"),
        (1008, EN, "EN-us", None, None, None),
        (1009, "the " * 50_000, None, None, None, None),
        (None, EN, None, None, None, None),
    ]
    got = _run(spark, small_model, plain + rows + rows[:1])
    want = {1000: "fr", 1001: "en", 1002: "en", 1003: "und", 1004: "und", 1005: "und", 1006: "und", 1007: "en", 1008: "en", 1009: "en", None: "en"}
    assert {i: got[i]["language"] for i in want} == want
    assert {i for i in want if not got[i]["accepted"]} == {1003, 1004, 1005, 1006}
    assert got[1008]["declared"] == "en" and got[1007]["declared"] is None


def test_priors_leave_the_row_itself_out(spark, small_model):
    """A lone odd page doesn't vote for itself through its own host."""
    rows = [(i, EN, None, None, "one.host", "host") for i in range(50)] + [(99, FR[:9], None, None, "one.host", "host")]
    alone = _run(spark, small_model, [(99, FR[:9], None, None, None, None)])
    assert _run(spark, small_model, rows)[99]["posterior"] != alone[99]["posterior"]


def test_no_rows(spark, small_model):
    assert _run(spark, small_model, []) == {}
    empty = spark.createDataFrame([], "text string, lang string")
    assert identify(spark.createDataFrame([(1, EN, "en", None, None, None)], ROWS), fit_text_model(empty)).first()["language"] == "und"


def test_a_rare_language_is_in_the_model(spark):
    """The labels come from all documents; a sample is only drawn within each."""
    rows = [(i, EN, "en") for i in range(4000)] + [(9001, FR, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit_text_model(docs, sample_docs=50)
    assert model.languages == ["en", "fr", "und"]
    got = _run(spark, model, [(1, FR, "fr", None, None, None)])[1]
    assert (got["language"], got["declared"], got["accepted"]) == ("fr", "fr", True)
    again = fit_text_model(docs.repartition(7), sample_docs=50)
    assert (model.log_p == again.log_p).all() and 20 <= sampled(docs, "text", "lang", "doc_id", 50).where("label = 'en'").count() <= 90


def _brute_likelihoods(text, model):
    """Log-likelihoods of a text, trigram by trigram, and their number."""
    letters = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + (text or "").lower().encode() + b" ")
    bits = 64 - (len(model.log_p) - 1).bit_length()
    grams = [int.from_bytes(letters[i : i + 3], "big") * 0x9E3779B97F4A7C15 % 2**64 >> bits for i in range(len(letters) - 2)]
    ll = [sum(model.log_p[g, k] for g in grams) for k in range(len(model.languages))]
    weight = min(len(grams) / 3.0, 200.0) / max(len(grams), 1)
    return [x * weight for x in ll], len(grams)


def _brute(rows, model):
    """language and posterior of each row: every sum over the other rows anew."""
    n, known = len(model.languages), set(model.languages[:-1])
    said = [(r[2] or "").strip(" ").replace("_", "-").split("-")[0].lower() for r in rows]
    keys = [dict(declared=s if s in known else None, suffix=r[3], host=r[4], domain=r[5]) for s, r in zip(said, rows)]
    ll, grams = zip(*[_brute_likelihoods(r[1], model) for r in rows])
    p = [[math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) if g else 0.0 for x in v] for v, g in zip(ll, grams)]
    total = [sum(v[k] for v in p) + 1 for k in range(n)]
    overall = [t / sum(total) for t in total]

    def others(i, key):
        """Posteriors of the other rows of the same value; None without a row that has text."""
        same = [j for j in range(len(rows)) if keys[j][key] == keys[i][key] and grams[j]] if keys[i][key] is not None else []
        return [sum(p[j][k] for j in same if j != i) for k in range(n)] if same else None

    def smoothed(counts, wider):
        mixed = [c + 10 * w for c, w in zip(counts, wider)] if counts else wider
        return [m / sum(mixed) for m in mixed]

    out = []
    for i in range(len(rows)):
        prior = smoothed(others(i, "host"), smoothed(others(i, "domain"), overall))
        score = [x + math.log(q) for x, q in zip(ll[i], prior)]
        for key in ("declared", "suffix"):
            counts = others(i, key)
            if counts:
                score = [s + math.log((c + 1) / (t + n)) for s, c, t in zip(score, counts, total)]
        best = max(range(n), key=lambda k: (score[k], -k))
        out.append((model.languages[best], 1 / sum(math.exp(s - score[best]) for s in score)) if grams[i] else ("und", 1.0))
    return out


def test_fusion_against_brute_force(spark, small_model):
    rnd = random.Random(8)
    words = EN.split() + FR.split() + ["zoo", "été", "12", "--"]
    rows = []
    for i in range(150):
        text = rnd.choice([None, "", "12 -- !", *[" ".join(rnd.choices(words, k=k)) for k in (1, 2, 3, 5, 60)]])
        host = rnd.choice([None, "a.one.uk", "b.one.uk", "c.two.fr"])
        domain = host and host[2:]
        rows.append((i, text, rnd.choice([None, "en", "fr-FR", " EN_us", "tlh", ""]), domain and domain[4:], host, domain))
    rows += [(200 + i, EN if i % 2 else FR, "fr", None, "hot.host", "host") for i in range(60)]  # a hot, mixed host
    got, want = _run(spark, small_model, rows), _brute(rows, small_model)
    for r, (language, posterior) in zip(rows, want):
        assert got[r[0]]["language"] == language and np.isclose(got[r[0]]["posterior"], posterior, rtol=1e-9), r
        assert got[r[0]]["accepted"] == (language != "und" and posterior >= 0.5)
    assert {w[0] for w in want} == {"en", "fr", "und"} and any(w[1] < 0.7 for w in want)


def test_clashing_columns_and_too_many_labels(spark, small_model, monkeypatch):
    docs = spark.createDataFrame(
        [(i, EN if i % 2 else FR, "en" if i % 2 else "fr", "s", 0.5, "x", i, 1) for i in range(20)],
        "doc_id bigint, text string, lang string, source string, share double, label string, drawn int, id int",
    )
    model = fit_text_model(docs)
    assert model.languages == ["en", "fr", "und"]
    got = {r["id"]: r["language"] for r in identify(document_rows(docs), model).collect()}
    assert got == {i: "en" if i % 2 else "fr" for i in range(20)}
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="2 different labels"):
        fit_text_model(docs)
