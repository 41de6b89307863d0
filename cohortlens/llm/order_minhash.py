"""Near-duplicate documents by Order MinHash (Marcais et al. 2019).

A document is the sequence of its five-word shingles, each labelled with its
occurrence number.  A sketch takes the ``ell`` labelled shingles that are least
under a seeded hash and keeps them in text order; documents sharing a sketch
value are candidates.  Unlike plain MinHash, a reordered text gives other
sketches.  A candidate pair is verified by a banded alignment of the two
shingle sequences: similarity = aligned shingles / shingles of the longer text.
The band is as wide as the threshold allows, so it loses nothing.

Work on groups of near copies is linear, not quadratic: a bucket's documents
are first compared with its smallest one; those that did not end up in its
component are compared with a few more, and only those still apart with all others.  Buckets of documents that merely share
a common passage are sieved by the prefix principle first: two documents can
only be similar if the rarest fifth of their shingles meet.  Components are the
same as if all candidate pairs had been verified.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.components import connected_components
from cohortlens.llm.scratch import ship, stored
from cohortlens.llm.shingles import chunks, label_occurrences, mix, shingles, words

#: Words of a shingle, shingles of a sketch, sketches of a document, least similarity of a link.
SHINGLE, ELL, SKETCHES, THRESHOLD = 5, 3, 16, 0.8
#: Members of a bucket up to which its pairs need no sieve, further heads of larger ones.
FEW, HEADS = 8, 8
#: Most ids that are broadcast to pick the texts to verify (16 MB).
BROADCAST_IDS = 2_000_000

_U = np.uint64
_SKETCHED = "doc_id bigint, n bigint, c1 bigint, c2 bigint, keys array<bigint>"


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xE7037ED1A0B428DB)) | _U(1)


def order_sketches(labelled: np.ndarray, start: np.ndarray, sketches: int, ell: int) -> np.ndarray:
    """One row per text with shingles: its sketch values (uint64)."""
    starts = start[:-1]
    place_bits = _U(max(1, int(len(labelled) - 1).bit_length()))
    place_mask = (_U(1) << place_bits) - _U(1)
    places = np.arange(len(labelled), dtype=_U)
    out = np.zeros((len(starts), sketches), _U)
    top = _U(0xFFFFFFFFFFFFFFFF)
    for t, seed in enumerate(_seeds(sketches)):
        key = labelled * seed
        key ^= key >> _U(32)
        key *= _U(0x9FB21C651E98DF25)
        key = (key & ~place_mask) | places  # ties of the upper bits go by place
        picked = np.empty((ell, len(starts)), np.int64)
        for i in range(ell):
            least = np.minimum.reduceat(key, starts)
            at = (least & place_mask).astype(np.int64)
            none = least == top  # texts with fewer shingles
            picked[i] = np.where(none, -1, at)
            key[np.where(none, starts, at)] = top
        picked.sort(axis=0)  # text order
        value = np.full(len(starts), seed, _U)
        for row in picked:
            value = mix(value * _U(0x9E3779B97F4A7C15) + np.where(row >= 0, labelled[np.maximum(row, 0)], _U(0)))
        out[:, t] = value
    return out


def sketch_documents(docs: DataFrame, sketches: int, ell: int) -> DataFrame:
    """Per document: number of shingles, a 128-bit hash of its words (equal for
    equal word sequences) and its sketch values; zero and null without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(col), 1024):
                for at, run in chunks(col.slice(lo, 1024).to_pylist()):
                    w = words(run)
                    has = np.flatnonzero(np.diff(w.start) > 0)
                    n, c1, c2 = np.zeros((3, len(run)), np.int64)
                    keys: list = [None] * len(run)
                    if len(has):
                        h, start = shingles(w, SHINGLE)
                        bounds = np.append(start[has], start[-1])
                        found = order_sketches(label_occurrences(h, start), bounds, sketches, ell).view(np.int64)
                        for i, row in zip(has.tolist(), found, strict=True):
                            keys[i] = row
                        nth = np.arange(len(w.hashes), dtype=_U) - np.repeat(w.start[:-1], np.diff(w.start)).astype(_U)
                        n = np.diff(start)
                        for c, m in ((c1, 3), (c2, 0xD6E8FEB86659FD93)):
                            c[has] = np.add.reduceat(mix(w.hashes * _U(m) + nth), w.start[has]).view(np.int64)
                    cols = [ids.slice(lo + at, len(run)), pa.array(n), pa.array(c1), pa.array(c2), pa.array(keys, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "c1", "c2", "keys"])

    return docs.mapInArrow(sketch, _SKETCHED)


def _sequences(texts: dict[int, str]) -> dict[int, np.ndarray]:
    """Labelled shingle sequences by id."""
    out, ids = {}, list(texts)
    for at, run in chunks([texts[i] for i in ids]):
        h, start = shingles(words(run), SHINGLE)
        labelled = label_occurrences(h, start)
        for i in range(len(run)):
            out[ids[at + i]] = labelled[start[i] : start[i + 1]]
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence of two labelled sequences if it
    is ``least`` or more, else something smaller.  Values are unique in each, so
    it is the longest increasing run of places in ``b``; cells further from the
    diagonal than ``least`` allows can't lie on such an alignment."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    drift = j - i
    # an alignment with `least` matches skips at most len(a)-least of a and len(b)-least of b
    near = (drift <= len(b) - least) & (drift >= least - len(a))
    i, j = i[near], j[near]
    if len(i) < least:
        return len(i)
    places = j[np.argsort(i)]
    if np.all(places[1:] > places[:-1]):
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails)


def _texts_of(ids: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The documents whose ids occur in ``columns`` of ``ids``.  These are
    broadcast if at most ``BROADCAST_IDS``; beyond that documents are shuffled."""
    each = [ids.select(F.col(c).alias("doc_id")) for c in columns]
    wanted = stored((each[0] if len(each) == 1 else each[0].unionByName(each[1])).distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verify_pairs(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ids whose texts align: ``a, b, similarity``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                x, y = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                texts = dict(zip(x, batch.column("ta").to_pylist(), strict=True)) | dict(zip(y, batch.column("tb").to_pylist(), strict=True))
                seq = _sequences(texts)
                sim = np.zeros(len(x))
                for r, (left, right) in enumerate(zip(x, y, strict=True)):
                    longer = max(len(seq[left]), len(seq[right]))
                    least = int(np.ceil(threshold * longer - 1e-9))
                    n = aligned(seq[left], seq[right], least)
                    sim[r] = n / longer if n >= least else -1
                out = batch.select(["a", "b"]).append_column("similarity", pa.array(sim))
                yield out.filter(pa.array(sim >= 0))

    pairs = stored(pairs)
    texts = _texts_of(pairs, docs, "a", "b")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "ta", "b", "tb").mapInArrow(verify, "a bigint, b bigint, similarity double")


def _lengths_fit(x: str, y: str, threshold: float):
    return F.least(x, y) >= F.ceil(F.greatest(x, y) * threshold - 1e-9)


def candidate_links(buckets: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Verified links that connect what all candidate pairs of ``buckets``
    (key, rep, n) would connect."""
    size = F.count(F.lit(1)).alias("members")
    heads = stored(buckets.groupBy("key").agg(F.min("rep").alias("head"), size).where("members > 1"))
    members = stored(buckets.join(heads, "key").select("key", "rep", "n", "head", "members"))
    head_n = members.where("rep = head").select("key", F.col("n").alias("head_n"))
    spokes = members.where("rep <> head").join(head_n, "key").where(_lengths_fit("n", "head_n", threshold))
    star = stored(verify_pairs(spokes.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), docs, threshold))
    placed = _placed(members, star)
    mixed = _mixed(placed)
    if mixed.limit(1).count():
        pairs = _further_heads(mixed, threshold)
        star = stored(star.unionByName(verify_pairs(pairs, docs, threshold)))
        placed = _placed(members, star)
        mixed = _mixed(placed)
    few = placed.where(F.col("members") <= FEW)
    pairs = _loose_pairs(few, few, "key", threshold)
    each = stored(mixed.groupBy("rep", "n", "component").agg(F.max("loose").alias("loose")))
    if each.limit(1).count():
        pairs = pairs.unionByName(_sieved_pairs(each, docs, threshold))
    return star.unionByName(verify_pairs(pairs.distinct(), docs, threshold))


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets but for the heads, with their component and whether
    they are loose: not in the component of the bucket's head."""
    comp = stored(connected_components(links)).select(F.col("vertex").alias("rep"), "component")
    placed = members.where("members > 2 AND rep <> head").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = placed.join(comp.select(F.col("rep").alias("head"), F.col("component").alias("hc")), "head", "left")
    return stored(placed.withColumn("loose", F.col("component") != F.coalesce("hc", "head")).drop("hc"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of larger buckets that have loose ones."""
    keys = placed.where("loose").select("key").distinct()
    return stored(placed.where(F.col("members") > FEW).join(keys, "key", "left_semi"))


def _further_heads(mixed: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the loose members and a few more heads of their bucket: those
    with the least hashes, so that buckets of the same documents share them.  In
    a group of near copies nearly every member is similar to one of them."""
    heads = mixed.groupBy("key").agg(*[F.min_by("rep", F.xxhash64("rep", F.lit(s))).alias(f"h{s}") for s in range(HEADS)])
    heads = heads.select("key", F.explode(F.array_distinct(F.array(*[F.col(f"h{s}") for s in range(HEADS)]))).alias("o"))
    known = mixed.select(F.col("rep").alias("o"), F.col("n").alias("on"), F.col("component").alias("oc")).distinct()
    pair = mixed.where("loose").select("key", "rep", "n", "component").join(heads, "key").join(known, "o")
    pair = pair.where((F.col("component") != F.col("oc")) & _lengths_fit("n", "on", threshold))
    return pair.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b")).distinct()


def _loose_pairs(x: DataFrame, y: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pairs (a, b) of a loose member of ``x`` and a member of ``y`` with the
    same key, of different components and fitting lengths."""
    other = y.select(key, F.col("rep").alias("o"), F.col("n").alias("on"), F.col("component").alias("oc"))
    pair = x.where("loose").select(key, "rep", "n", "component").join(other, key)
    pair = pair.where((F.col("component") != F.col("oc")) & _lengths_fit("n", "on", threshold))
    return pair.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b"))


def _sieved_pairs(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``members`` (rep, n, component, loose) that can be similar.

    Similar documents share at least ceil(threshold * n) shingles, so they meet
    in the n - ceil(threshold * n) + 1 rarest of each.  Shingles of one member
    only meet nothing; they fill the prefix first and then drop out, so what is
    left are members nearly all of whose shingles occur elsewhere too."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                seq = _sequences(dict(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)))
                reps = np.repeat(np.array(list(seq), np.int64), [len(v) for v in seq.values()])
                all_ = np.concatenate(list(seq.values())) if seq else np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(all_.view(np.int64))], names=["rep", "shingle"])

    texts = _texts_of(members.select("rep"), docs, "rep").select("doc_id", "text")
    each = stored(texts.mapInArrow(explode, "rep bigint, shingle bigint"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = stored(each.join(often, "shingle"))
    need = F.ceil(F.col("n") * threshold - 1e-9)
    room = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("in_common")).join(members, "rep")
    room = room.withColumn("room", F.col("in_common") - need + 1).where("room > 0")
    rarest = Window.partitionBy("rep").orderBy("df", "shingle")
    prefix = shared.join(room, "rep").withColumn("_no", F.row_number().over(rarest)).where("_no <= room")
    prefix = stored(prefix.select("shingle", "rep", "n", "component", "loose"))
    return _loose_pairs(prefix, prefix, "shingle", threshold)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    sketches: int = SKETCHES,
    ell: int = ELL,
) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest id with
    the same words), ``component_id`` (smallest id reachable by links),
    ``n_shingles, class_size, kept`` (doc_id = component_id).

    Texts that are null, empty or without words duplicate nothing: their class
    and component are their own id.  Rows with a null id are left out; repeated
    rows give repeated result rows.  An empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    sketched = stored(sketch_documents(read, sketches, ell))
    worded = sketched.where("n > 0")
    classes = stored(worded.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")))
    reps = worded.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    buckets = reps.select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key"))
    links = stored(candidate_links(stored(buckets), read, threshold))
    comp = connected_components(links).withColumnRenamed("vertex", "rep")
    of_class = stored(classes.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    found = worded.select("doc_id", "c1", "c2", "n").join(of_class, ["c1", "c2", "n"]).select(
        "doc_id", F.col("rep").alias("class_id"), F.col("component").alias("component_id"), F.col("n").alias("n_shingles"), "class_size"
    )
    bare = sketched.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.col("n").alias("n_shingles"), F.lit(1).cast("bigint").alias("class_size")
    )
    return found.unionByName(bare).withColumn("kept", F.col("doc_id") == F.col("component_id"))
