"""Best-fit packing of token sequences by hierarchical residual packing.

Level 0: every input partition tokenizes its documents, cuts those longer than
the capacity, and packs the pieces best-fit decreasing.  Bins that are nearly
full are final; the others rise a level as items of their own size.  Each level
merges the bins of ``fan_in`` neighbouring groups best-fit, until one group is
left.

Only piece descriptors (about 50 bytes) leave the tokenizing pass, never texts
or ids.  What rises is bounded by the number of partitions, not by the rows:
after a best-fit round a group holds at most one bin of half the capacity or
less (two would have been merged), and every such bin can join at most one
larger bin, so a group passes on its small bin and at most as many of its
emptiest larger bins as there are partitions.  No bin is lost: the rest is
simply final as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.pretokens import WorkerCache, pretokenizer
from cohortlens.llm.scratch import ship, stored

#: Tokens of a sequence, id that ends a document, fill from which a bin is final, groups merged a level, cached pre-tokens.
CAPACITY, END_ID, NEARLY_FULL, FAN_IN, CACHE_SIZE = 4096, 1, 0.999, 16, 300_000
_SHIFT = 40  # bin ids: partition << 40 | number
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint"

_CACHES: dict[str, WorkerCache] = {}


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each size goes to the fullest bin that takes it.
    Returns bin and offset of each size, and the fill of each bin.  The bins are
    kept by residual, with one bit per residual in use, so a step costs the same
    however many bins there are."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = used >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = at[left].pop()
            if not at[left]:
                used ^= 1 << left
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - left
        fill[b] += size
        at[left - size].append(b)
        used |= 1 << (left - size)
    return bins, offsets, np.array(fill, np.int64)


def _id_bytes(path: str) -> WorkerCache:
    if path not in _CACHES:
        tok = pretokenizer(path)
        _CACHES[path] = WorkerCache(lambda p: np.array(tok.ids(p), "<u4").tobytes(), CACHE_SIZE)
    return _CACHES[path]


def pack_partitions(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """Level 0: pieces of each partition with their local bins."""
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = pretokenizer(path), _id_bytes(path)
        ids, nos, starts, lengths, crcs = [], [], [], [], []
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            col = batch.column("text")
            for i, key in enumerate(keys):
                t = col[i].as_py() or ""
                parts = tok.split(t)
                if parts is None:
                    raw = np.array(tok.whole(t), "<u4").tobytes() + end
                else:
                    raw = b"".join(map(known.__getitem__, parts)) + end
                for no, start in enumerate(range(0, len(raw) // 4, capacity)):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    ids.append(key)
                    nos.append(no)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
        bins, offsets, _ = best_fit(np.array(lengths, np.int64), capacity)
        first = TaskContext.get().partitionId() << _SHIFT
        cols = (
            pa.array(ids, pa.int64()),
            pa.array(nos, pa.int32()),
            pa.array(starts, pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array(crcs, pa.int64()),
            pa.array(bins + first),
            pa.array(offsets),
        )
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
        yield pa.RecordBatch.from_arrays(list(cols), names)

    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(pack, _PIECES)


def _merge_level(open_bins: DataFrame, divisor: int, capacity: int, groups: int) -> DataFrame:
    """One level: ``open_bins`` (leaf, bin, shift, size, grp) -> the same with
    ``bin``/``shift`` of the merged bin and its size; ``rises`` marks bins that
    go on."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        units = pdf.drop_duplicates("bin")
        where, offset, fill = best_fit(units["size"].to_numpy(), capacity)
        head = {}
        for b, name in zip(where.tolist(), units["bin"].tolist(), strict=True):
            head.setdefault(b, name)  # a merged bin takes the name of one of its own
        to = dict(zip(units["bin"].tolist(), zip(where.tolist(), offset.tolist(), strict=True), strict=True))
        small = fill <= capacity // 2
        order = np.argsort(fill, kind="stable")
        hosts = [b for b in order.tolist() if not small[b] and fill[b] < NEARLY_FULL * capacity][:groups]
        goes = set(hosts) | set(np.flatnonzero(small).tolist())
        new = [to[b] for b in pdf["bin"].tolist()]
        return pd.DataFrame(
            {
                "leaf": pdf["leaf"],
                "bin": [head[b] for b, _ in new],
                "shift": pdf["shift"] + [s for _, s in new],
                "size": [int(fill[b]) for b, _ in new],
                "part": pdf["part"],
                "rises": [b in goes for b, _ in new],
            }
        )

    keyed = open_bins.withColumn("grp", F.floor(F.col("part") / F.lit(divisor)).cast("bigint"))
    return keyed.groupBy("grp").applyInPandas(merge, "leaf bigint, bin bigint, shift bigint, size bigint, part bigint, rises boolean")


def pack(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``; the pieces of a sequence fill it without gaps from
    offset 0.  A document is its ids followed by ``end_id``; only one longer
    than ``capacity`` is cut, into pieces of ``capacity`` and a rest.

    Null and empty texts are the end id alone (one piece of length 1); null ids
    are passed on; repeated rows are packed as often as they occur; an empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    ship(docs.sparkSession)
    pieces = stored(pack_partitions(docs, path, doc_id, text, capacity, end_id))
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("size"))
    parts = F.shiftright("bin", _SHIFT)
    last = pieces.agg(F.max(parts).alias("p")).first()["p"]
    groups = 0 if last is None else last + 1
    rising = fills.where(F.col("size") < NEARLY_FULL * capacity).select(
        F.col("bin").alias("leaf"), "bin", F.lit(0).cast("bigint").alias("shift"), "size", parts.alias("part")
    )
    # what rises from a partition: its small bin and its emptiest larger ones, at most `groups`
    by_part = F.row_number().over(_emptiest_first())
    rising = rising.withColumn("_no", by_part).where(F.col("_no") <= groups + 1).drop("_no")
    moved, divisor = None, fan_in
    while groups > 1:
        level = stored(_merge_level(rising, divisor, capacity, groups))
        done = level.where(~F.col("rises") | F.lit(divisor >= groups)).select("leaf", F.col("bin").alias("to"), "shift")
        moved = done if moved is None else moved.unionByName(done)
        if divisor >= groups:
            break
        rising = level.where("rises").drop("rises")
        divisor *= fan_in
    if moved is None:
        return pieces.withColumnRenamed("bin", "sequence_id").select(*_OUT)
    joined = pieces.join(moved, pieces["bin"] == moved["leaf"], "left")
    return joined.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


_OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _emptiest_first():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("size", "leaf")
