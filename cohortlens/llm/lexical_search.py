"""Ranked lexical search of a stated set of items over all documents, by bag
deduplication.

A document counts for a search only by how often it holds the items' terms and by
its length factor m.  So texts are read once and restricted to the items'
vocabulary: what is left is a bag, the ascending term numbers and their
frequencies.  Documents of one bag and one m are a class: classes are formed by
hash, with the bags themselves compared, and each class is scored once, whatever
the number of its members.  Each task keeps the best classes of each item; then
the best classes of all are expanded into members by ascending id.

The result is exact.  At most k classes of an item can hold its k best documents:
ordered by score and least member, a class comes after k others only if k
documents come before all of its own.  A class hands on its k least ids; these
are taken before the exchange, so a class of a third of all documents costs no
more than another.

Items are searched in blocks of at most ``BLOCK_POSTINGS`` (term, item) pairs (and
one item more), so the vocabulary and the matrix that tasks hold are bounded; the
documents are read once a block.  Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship, stored
from cohortlens.sources.prepare import running_sums

#: Documents an item gets, (term, item) pairs of a block, cells of a score matrix, rows a slice of texts has.
TOP, BLOCK_POSTINGS, CELLS, _SLICE = 50, 1_000_000, 2_000_000, 512
#: Terms of an item up to which sums of scores are exact in doubles (each term gives less than 2**36).
EXACT_TERMS = 1 << 17
_LAST = np.iinfo(np.int64).max

#: Bytes of a term (digits, letters, all beyond ASCII) stay, A-Z in lower case; the others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``row, item_id, terms, size, block`` of each row of ``items`` that has a term."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
            columns = {
                "item_id": batch.column("item_id"),
                "terms": pa.array(found, pa.list_(pa.binary())),
                "size": pa.array(map(len, found), pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    ids = F.col(item_id).cast("bigint").alias("item_id")
    read = items.select(ids, F.col(text).cast("string").cast("binary").alias("text"))
    split_items = read.mapInArrow(split, "item_id bigint, terms array<binary>, size bigint").where("size > 0")
    rows = stored(split_items.withColumn("row", F.monotonically_increasing_id()))
    before = running_sums(rows.select("row", "size"), ["row"], ["size"], inclusive=False)
    block = F.floor(F.col("cum_size") / F.lit(BLOCK_POSTINGS)).cast("bigint").alias("block")
    return stored(rows.join(before.select("row", block), "row"))


class Items:
    """The items of a block: their terms numbered, and per term the items that hold it."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(bytes(t), len(self.number)), i) for i, r in enumerate(rows) for t in r["terms"]]
        pairs.sort()
        self.holder = np.array([i for _, i in pairs], np.int64)
        self.edge = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.number) + 1))
        self.most = max(len(r["terms"]) for r in rows)


def bags(docs: DataFrame, items, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, bag`` of each document with a term; ``bag`` is empty or holds
    the numbers of its item terms, ascending, then their frequencies (both as
    little-endian 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.number.get
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                n, found = [], []
                for t in batch.column("text").to_pylist():
                    words = terms(t)
                    held = [i for i in map(number, words) if i is not None]
                    n.append(len(words))
                    found.append(b"".join(x.astype("<u4").tobytes() for x in np.unique(held, return_counts=True)) if held else b"")
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "bag": pa.array(found, pa.binary())}
                )

    columns = F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")
    return docs.select(*columns).mapInArrow(read, "doc_id bigint, n bigint, bag binary").where("n > 0")


def document_frequencies(bagged: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms; a task hands on one row a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            held = [np.frombuffer(b, "<u4", len(b) // 8) for b in batch.column("bag").to_pylist()]
            if held:
                df += np.bincount(np.concatenate(held), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term), "df": pa.array(df[term])})

    out = np.zeros(size, np.int64)
    counted = bagged.select("bag").mapInArrow(count, "term bigint, df bigint")
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class _Best:
    """The best classes of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.bar = k, np.ones(items, np.int64)  # least score that can still count
        self.rows = np.zeros((4, 0), np.int64)  # item, score, least member, class

    def add(self, scores: np.ndarray, first: np.ndarray, classes: np.ndarray) -> None:
        c, i = np.nonzero(scores >= self.bar)
        if not len(c):
            return
        rows = np.concatenate([self.rows, np.stack([i, scores[c, i], first[c], classes[c]])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        start = np.searchsorted(rows[0], np.arange(len(self.bar)))
        place = np.arange(rows.shape[1]) - start[rows[0]]
        last = rows[:, place == self.k - 1]
        self.bar[last[0]] = last[1]
        self.rows = rows[:, place < self.k]


def class_scores(bag_list: list[bytes], m: np.ndarray, items: Items, weight: np.ndarray) -> np.ndarray:
    """Scores of each class (row) for each item of the block."""
    sizes = np.array([len(b) // 8 for b in bag_list], np.int64)
    term = np.concatenate([np.frombuffer(b, "<u4", len(b) // 8) for b in bag_list]).astype(np.int64)
    tf = np.concatenate([np.frombuffer(b, "<u4", offset=len(b) // 2) for b in bag_list]).astype(np.int64)
    cls = np.repeat(np.arange(len(bag_list)), sizes)
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[cls]))
    reach = items.edge[term + 1] - items.edge[term]
    place = np.arange(reach.sum()) + np.repeat(items.edge[term] - (np.cumsum(reach) - reach), reach)
    cell = np.repeat(cls * len(items.ids), reach) + items.holder[place]
    value, cells = np.repeat(value, reach), len(bag_list) * len(items.ids)
    if items.most <= EXACT_TERMS:
        total = np.bincount(cell, value, cells).astype(np.int64)
    else:
        total = np.zeros(cells, np.int64)
        np.add.at(total, cell, value)
    return total.reshape(len(bag_list), len(items.ids))


def best_classes(classes: DataFrame, items, weight, k: int) -> DataFrame:
    """``item, score, first, class``: at most k classes of each item from each task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        best, step = _Best(len(block.ids), k), max(1, min(256, CELLS // len(block.ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                m, cls = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("m", "class"))
                first = np.array([_LAST if f is None else f for f in batch.column("first").to_pylist()], np.int64)
                best.add(class_scores(batch.column("bag").to_pylist(), m, block, weight.value), first, cls)
        item, points, first, cls = best.rows
        yield pa.RecordBatch.from_pydict({"item": item, "score": points, "first": first, "class": cls})

    return classes.select("class", "m", "bag", "first").mapInArrow(score, "item bigint, score bigint, first bigint, class bigint")


def _search_block(docs: DataFrame, rows: list, doc_id: str, text: str, k: int) -> DataFrame | None:
    """``item_id, rank, doc_id, score`` for the items of one block."""
    spark = docs.sparkSession
    block = Items(rows)
    items = spark.sparkContext.broadcast(block)
    bagged = stored(bags(docs, items, doc_id, text))
    total = bagged.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    weight = spark.sparkContext.broadcast(weights(document_frequencies(bagged, len(block.number)), total["docs"]))
    m = F.expr(f"100 - 50 + ((50 * n * {total['docs']}L) div {total['terms']}L)").alias("m")
    held = bagged.where("length(bag) > 0").select("doc_id", m, "bag")
    held = held.withColumn("h", F.xxhash64("bag", "m"))
    classes = held.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()))

    order = [F.desc("score"), F.asc("first"), F.asc("class")]
    chosen = best_classes(classes, items, weight, k)
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= k)
    chosen = stored(chosen.select("item", "score", "class"))
    keys = stored(classes.join(chosen.select("class").distinct(), "class", "left_semi").select("class", "h", "m", "bag"))
    near = held.join(F.broadcast(keys.select("h").distinct()), "h", "left_semi")  # k hashes an item of the block at most
    within = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = near.withColumn("place", F.row_number().over(within)).where(F.col("place") <= k).join(keys, ["h", "m", "bag"])
    ranked = chosen.join(members.select("class", "doc_id"), "class")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item bigint, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest score above
    0 for each row of ``items``, equal scores by ascending id.

    Terms are maximal stretches of ASCII letters, digits and all characters
    beyond ASCII, A-Z in lower case.  A null text has none, and neither a document
    nor an item without terms is in the result.  A null document id ranks last
    among equal scores; repeated document rows rank one by one; repeated item rows
    give repeated results.  Other columns are ignored whatever their names; an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    listed = item_terms(items, item_id, item_text)
    found = None
    for r in listed.select("block").distinct().orderBy("block").collect():  # one row a block of the stated items
        rows = listed.where(F.col("block") == r["block"]).orderBy("row").collect()
        part = _search_block(docs, rows, doc_id, text, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
