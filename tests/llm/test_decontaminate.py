"""Template decontamination on planted questions."""

import pytest

from cohortlens.llm.decontaminate import contaminated

ITEMS = [
    (1, "A train travels 120 km in 3 hours while Alice waits at the station in Paris. How far does the train travel in 5 hours, asks Alice?"),
    (2, "the quick brown fox jumps over the lazy dog and then sleeps under the old oak tree until morning comes"),
    (3, "too short here"),
    (4, None),
    (5, ""),
]
CHANGED = "A train travels 450.5 km in 9 hours while Robert waits at the station in Berlin. How far does the train travel in 7 hours, asks Robert?"
MIXED = "A train travels 450 km in 9 hours while Robert waits at the station in Berlin. How far does the train travel in 7 hours, asks Susan?"
DOCS = {
    1: "Some words before. " + ITEMS[0][1] + " And some words after it.",
    2: "intro text here " + CHANGED + " more text",
    3: "THE QUICK BROWN FOX jumps over the lazy dog -- and then sleeps under the old oak tree, until morning comes!",
    4: "the quick brown fox jumps over the fence and runs away into the dark green forest before morning comes",
    5: None,
    6: "",
    7: "too short here",
    8: "word " * 6000 + ITEMS[1][1] + " word" * 6000,
    9: "1 2 3 4 5 6 7 8 9 10 " * 50,
    10: "the quick brown fox jumps over the lazy dog " + "x y z w v " * 400 + "and then sleeps under the old oak tree until morning comes",
}


def _run(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*r, "c", 1) for r in docs.items()], "doc_id bigint, text string, item_id string, h int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(d, i).collect()}


def test_planted_questions(spark):
    got = _run(spark)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (8, 2)}
    assert got[1, 1]["kind"] == "verbatim" and got[1, 1]["coverage"] >= 0.95
    assert got[2, 1]["kind"] == "reparameterised" and got[2, 1]["slot_consistency"] == 1.0 and got[2, 1]["slots"] > 0


def test_inconsistent_slots_are_told_apart(spark):
    swapped = {1: CHANGED, 2: MIXED}
    got = _run(spark, swapped)
    assert got[1, 1]["slot_consistency"] == 1.0
    assert (2, 1) not in got or got[2, 1]["slot_consistency"] < 1.0


def test_against_windows_in_python(spark, sf_small):
    """Without slots the result is plain window containment."""
    import re

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet")

    def windows(t):
        w = re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower().strip(" \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    of = {r["item_id"]: windows(r["text"]) for r in items.collect()}
    want = set()
    for r in docs.collect():
        mine = windows(r["text"])
        want |= {(r["doc_id"], i) for i, w in of.items() if w and len(w & mine) >= 0.8 * len(w)}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert want and got == want


@pytest.mark.parametrize("docs,items", [({}, ITEMS), (DOCS, []), ({}, [])])
def test_empty_tables(spark, docs, items):
    assert _run(spark, docs, items) == {}


def test_names_at_sentence_starts_and_changed_case(spark):
    item = "Tom buys nine red apples at the market near home. Tom gives two of them to his sister. Tom eats one apple. How many are left over now?"
    named = "She said in May that Bob and Eve met Carol near Lyon while Dave and Frank walked from Paris to Rome with Grace and Heidi"
    docs = {
        1: "some words " + item.replace("Tom", "Ann") + " and more",
        2: named.lower(),
        3: named.upper(),
        4: "intro: \"" + item.replace("Tom", "ANN") + "\"",
        5: "nobody buys nine green pears at the shop and then walks all the way home again to his sister",
    }
    got = _run(spark, docs, [(1, item), (2, named)])
    assert set(got) == {(1, 1), (4, 1), (2, 2), (3, 2)}
    assert got[1, 1]["kind"] == "reparameterised" and got[2, 2]["kind"] == "verbatim"
