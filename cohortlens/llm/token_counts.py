"""Token counts by a map-side two-tier lookup.

Tier one is a table of frequent pre-tokens and their token counts, taken from a
bounded sample of documents and broadcast (at most ``table_size`` entries).
Tier two is a cache in each Python worker, which encodes a miss once.  The
documents themselves are read in one narrow pass: no exchange, no join.

The table only saves encoding work; counts come out the same whatever it holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.pretokens import WorkerCache, pretokenizer
from cohortlens.llm.scratch import ship

#: Entries of the broadcast table, documents it is taken from, entries of a worker's cache.
TABLE_SIZE, SAMPLE_DOCS, CACHE_SIZE = 65_536, 20_000, 400_000
_SLICE = 512

_CACHES: dict[str, WorkerCache] = {}


def _lengths(path: str, cache_size: int) -> WorkerCache:
    if path not in _CACHES:
        tok = pretokenizer(path)
        _CACHES[path] = WorkerCache(lambda p: len(tok.ids(p)), cache_size)
    return _CACHES[path]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, list[str]]]:
    col = batch.column(name)
    for at in range(0, len(col), _SLICE):
        yield at, [t or "" for t in col.slice(at, _SLICE).to_pylist()]


def frequent_pretokens(
    docs: DataFrame, path: str, text: str = "text", table_size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS
) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about ``sample_docs``
    documents, sampled evenly over the table; each task hands on at most
    ``table_size`` of them."""
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = pretokenizer(path), Counter()
        for batch in batches:
            for _, texts in _texts(batch, text):
                for t in texts:
                    seen.update(tok.split(t) or ())
                if len(seen) > 8 * table_size:
                    seen = Counter(dict(seen.most_common(table_size)))
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"p": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    sample = docs.select(text).sample(fraction=share, seed=7).mapInArrow(count, "p string, n bigint")
    top = sample.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(table_size).collect()
    tok = pretokenizer(path)
    return {r["p"]: len(tok.ids(r["p"])) for r in top}


def token_counts(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 2048,
    table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (n_tokens > limit).

    Null texts count as empty (0 bytes, 0 tokens); a null id is passed on;
    repeated rows give repeated rows; an empty table gives no rows; other
    columns of ``docs`` are ignored whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_pretokens(docs, path, text, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, misses = pretokenizer(path), _lengths(path, cache_size)
        frequent = table.value
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in _texts(batch, "text"):
                for t in texts:
                    parts = tok.split(t)
                    if parts is None:
                        n = len(tok.whole(t))
                    else:
                        n = sum([frequent[p] if p in frequent else misses[p] for p in parts])
                    n_tokens.append(n)
                    n_bytes.append(len(t) if t.isascii() else len(t.encode()))
            out = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(out)

    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
