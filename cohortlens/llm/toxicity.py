"""Toxicity by a factorization machine over hashed terms (Rendle 2010).

A text's terms are its distinct words and their beginnings (so that inflected
forms of an insult share a term), hashed into ``BUCKETS``.  The score is

    sigmoid(w0 + sum w[i] + sum over pairs <v[i], v[j]>)

whose pair part learns that two terms mean more together than apart.  It is
computed in linear time as half of |sum v|^2 - sum |v|^2, over whole texts, in
one narrow pass.  The model is fitted on a bounded sample of labelled rows, drawn
by label.  A term gets weights if it tells the classes apart there, alone or by
its meeting another term (two log-likelihood ratio tests: of terms, and of pairs
beyond their terms), so that long texts don't add up the noise of thousands of
ordinary words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship, stored
from cohortlens.llm.shingles import BASE, INVERSE, chunks, mix, powers

#: Labelled rows the model is fitted on at most, hash buckets, factors, passes over the sample, and steps at least (more passes if few rows).
SAMPLE_ROWS, BUCKETS, FACTORS, EPOCHS, LEAST_STEPS = 40_000, 1 << 18, 4, 20, 600
#: Least log-likelihood ratio of a term that gets a weight (chance exceeds it once in 100,000), and rows it must occur in.
LEAST_RATIO, LEAST_ROWS = 19.5, 3
#: Share of the sample's rows that a term of a tested pair occurs in; least chi-square of the difference of a term's log odds
#: ratios with and without the other (one pair in 4 billion exceeds it by chance); share of the label's entropy that a pair
#: tells beyond its terms; spread of the first factors of such terms and of others.
PAIR_SHARE, LEAST_PAIR_RATIO, PAIR_GAIN, PAIR_SPREAD, SPREAD = 0.05, 40.0, 0.06, 0.2, 0.01
#: Terms by terms whose meetings are counted at a time.
PAIR_BLOCK = 2048
#: Bytes of a word's beginnings that are terms, step, penalties of weights and factors, rows of a step.
STEMS, STEP, L2, L2_FACTORS, BATCH = (4, 5, 6), 0.08, 1e-5, 1e-4, 256

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: list[str | None], buckets: int = BUCKETS, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, text by text, and their starts; with
    ``only`` (a mask of buckets) those of its buckets."""
    raw = [(t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edge = np.flatnonzero(np.diff(_LETTER[data].astype(np.int8), prepend=0))
    first, last = edge[0::2], edge[1::2]
    length = last - first
    owner = np.searchsorted(np.cumsum([len(r) for r in raw]), first, side="right")
    total = np.concatenate(([_U(0)], np.cumsum((data.astype(_U) + _U(1)) * powers(BASE, len(data)), dtype=_U)))
    back = powers(INVERSE, len(data))
    bits = _U(int(buckets - 1).bit_length())
    codes = []
    for kind, most in enumerate((None, *STEMS)):  # whole words, then beginnings of longer ones
        use = slice(None) if most is None else length > most
        at = first[use]
        end = last if most is None else at + most
        term = mix((total[end] - total[at]) * back[at] + _U(kind)) >> (_U(64) - bits)
        of = owner[use]
        if only is not None:
            hit = only[term.astype(np.int64)]
            term, of = term[hit], of[hit]
        codes.append((of.astype(_U) << bits) | term)
    both = np.unique(np.concatenate(codes))
    start = np.searchsorted(both, np.arange(len(texts) + 1, dtype=_U) << bits)
    return (both & _U(buckets - 1)).astype(np.int64), start


@dataclass
class FactorizationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    telling: np.ndarray  # mask of the buckets that have weights

    def margin(self, term: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Margins of texts given by their terms."""
        n = np.diff(start)
        full = np.flatnonzero(n)
        out = np.full(len(n), self.bias)
        if len(full):
            at = start[:-1][full]
            v = self.v[term]
            s = np.add.reduceat(v, at, axis=0)
            out[full] += np.add.reduceat(self.w[term], at)
            out[full] += 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def log_likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """G-test of presence against label from the numbers of rows of each class
    that hold a term."""
    both, total, g = pos + neg, max(n1 + n0, 1.0), np.zeros(len(pos))
    for have, all_with, n in ((pos, both, n1), (n1 - pos, total - both, n1), (neg, both, n0), (n0 - neg, total - both, n0)):
        expect = np.maximum(all_with * n / total, 1e-12)
        g += 2 * np.where(have > 0, have * np.log(np.maximum(have, 1e-12) / expect), 0.0)
    return g


def _meetings(rows: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of either label that hold both a term of ``left`` and one of ``right``
    (both ascending)."""
    out = np.zeros((2, len(left), len(right)), np.float32)
    for lo in range(0, len(labels), 1024):
        part = rows[lo : lo + 1024]
        term, row = np.concatenate(part), np.repeat(np.arange(len(part)), [len(r) for r in part])
        held = []
        for some in (left, right):
            at = np.minimum(np.searchsorted(some, term), len(some) - 1)
            hit = some[at] == term
            x = np.zeros((len(part), len(some)), np.float32)
            x[row[hit], at[hit]] = 1
            held.append(x)
        for y in (0, 1):
            mine = labels[lo : lo + 1024] == y
            out[y] += held[0][mine].T @ held[1][mine]
    return out


def interacting(rows: list[np.ndarray], labels: np.ndarray, among: np.ndarray, block: int = PAIR_BLOCK) -> np.ndarray:
    """Which of the terms ``among`` (ascending) make a pair with another of them
    whose meeting tells what neither tells alone: the log odds ratio of one with
    the label differs by the other's presence (Woolf's test), and the four cells
    of the pair tell more (G-test) than its terms' own sum by a share of the
    label's entropy.  All pairs are tested, a block of terms against a block."""
    k, n = len(among), len(labels)
    found = np.zeros(k, bool)
    per = np.array([(labels == y).sum() for y in (0, 1)], float)
    if not k or not per.all():
        return found
    alone = np.zeros((2, k))
    for row, y in zip(rows, labels):
        alone[int(y), np.searchsorted(among, row[np.isin(row, among)])] += 1
    single = log_likelihood_ratio(alone[1], alone[0], per[1], per[0])
    least = PAIR_GAIN * -2 * (per * np.log(per / n)).sum()
    blocks = [np.arange(lo, min(lo + block, k)) for lo in range(0, k, block)]
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            both = _meetings(rows, labels, among[left], among[right])
            for lo in range(0, len(left), 128):
                mine = left[lo : lo + 128]
                cells = _cells(both[:, lo : lo + 128].astype(float), alone[:, mine], alone[:, right], per)
                hit = _g_test(cells, per) - single[mine, None] - single[None, right] >= least
                hit &= _odds_differ(cells, LEAST_PAIR_RATIO)
                found[mine] |= hit.any(1)
                found[right] |= hit.any(0)
    return found


def _cells(x: np.ndarray, a: np.ndarray, b: np.ndarray, per: np.ndarray) -> list[np.ndarray]:
    """Rows by label that hold both, only the first, only the second, or neither."""
    a, b = a[:, :, None], b[:, None, :]
    return [x, a - x, b - x, per[:, None, None] - a - b + x]


def _g_test(cells: list[np.ndarray], per: np.ndarray) -> np.ndarray:
    """G-test of the cells against the label."""
    g = np.zeros(cells[0].shape[1:])
    for cell in cells:
        total = cell.sum(0)
        for y in (0, 1):
            expect = np.maximum(total * per[y] / per.sum(), 1e-12)
            g += 2 * np.where(cell[y] > 0, cell[y] * np.log(np.maximum(cell[y], 1e-12) / expect), 0.0)
    return g


def _odds_differ(cells: list[np.ndarray], ratio: float) -> np.ndarray:
    """Whether the odds ratio of a term with the label differs by the other's presence."""
    differ, spread = np.zeros(cells[0].shape[1:]), np.zeros(cells[0].shape[1:])
    for sign, cell in zip((1, -1, -1, 1), cells):
        for y in (0, 1):
            differ += sign * (2 * y - 1) * np.log(cell[y] + 0.5)
            spread += 1 / (cell[y] + 0.5)
    return differ * differ >= ratio * spread


def fit(
    rows: list[np.ndarray], labels: np.ndarray, telling: np.ndarray, paired: np.ndarray | None = None, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7
) -> FactorizationMachine:
    """Adagrad on the logistic loss; ``rows`` hold telling terms only.  Terms that
    tell by pairs (mask ``paired``) start from wider factors."""
    rng = np.random.default_rng(seed)
    buckets = len(telling)
    spread = SPREAD * telling if paired is None else np.where(paired, PAIR_SPREAD, SPREAD * telling)
    w, v = np.zeros(buckets), rng.normal(0, 1, (buckets, factors)) * spread[:, None]
    gw, gv, gb = np.full(buckets, 1e-3), np.full((buckets, factors), 1e-3), 1e-3
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    model = FactorizationMachine(bias, w, v, telling)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(rows) // BATCH))) if len(rows) else 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            term = np.concatenate([rows[i] for i in pick])
            n = np.array([len(rows[i]) for i in pick])
            start = np.concatenate(([0], np.cumsum(n)))
            error = _sigmoid(model.margin(term, start)) - labels[pick]
            row = np.repeat(np.arange(len(pick)), n)
            x = v[term]
            sums = np.zeros((len(pick), factors))
            np.add.at(sums, row, x)
            e = error[row]
            by = np.argsort(term, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], term[by][1:] != term[by][:-1]))) if len(term) else np.zeros(0, np.int64)
            if len(first):
                u = term[by][first]
                dw = np.add.reduceat(e[by], first) / len(pick) + L2 * w[u]
                dv = np.add.reduceat((e[:, None] * (sums[row] - x))[by], first, axis=0) / len(pick) + L2_FACTORS * v[u]
                gw[u] += dw * dw
                gv[u] += dv * dv
                w[u] -= STEP * dw / np.sqrt(gw[u])
                v[u] -= 0.2 * STEP * dv / np.sqrt(gv[u])
            db = float(error.mean()) if len(error) else 0.0
            gb += db * db
            model.bias -= STEP * db / np.sqrt(gb)
    return model


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for lo in range(0, batch.num_rows, 512):
        part = batch.slice(lo, 512)
        for at, run in chunks(part.column("text").to_pylist()):
            yield part.slice(at, len(run)), run


def _term_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, pos, neg``: rows of either label that hold a term; bucket -1 has
    the numbers of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets + 1), np.int64)
        for batch in batches:
            for part, run in _runs(batch):
                term, start = terms(run, buckets)
                label = part.column("label").to_numpy()
                of = np.repeat(label, np.diff(start))
                for y in (0, 1):
                    seen[y, :-1] += np.bincount(term[of == y], minlength=buckets)
                    seen[y, -1] += (label == y).sum()
        at = np.flatnonzero(seen.any(0))
        names = ["bucket", "pos", "neg"]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == buckets, -1, at)), pa.array(seen[1, at]), pa.array(seen[0, at])], names=names)

    rows = docs.mapInArrow(count, "bucket bigint, pos bigint, neg bigint")
    return rows.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _telling_rows(docs: DataFrame, telling: np.ndarray) -> DataFrame:
    """``label, terms`` of documents, with their telling terms only."""
    mask = docs.sparkSession.sparkContext.broadcast(telling)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, run in _runs(batch):
                term, start = terms(run, len(mask.value), mask.value)
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "terms"])

    return docs.mapInArrow(hash_rows, "label int, terms array<int>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> FactorizationMachine:
    """Fit on at most ``sample_rows`` labelled documents (doc_id, text / doc_id,
    label) outside the held-out fold: of each label the first in the order of a
    hash of the id, half of the rows or what the other label leaves.  The bias is
    set back to the labels' shares among all.  What reaches the driver: a row per
    bucket, and of the sample's terms those that tell or may do so in pairs."""
    known = labels.where(F.col("label").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = sample_rows // 2
    part = {y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id") for y in (0, 1)}
    part = {y: part[y].limit(max(half, sample_rows - min(half, size.get(1 - y, 0)))) for y in part}
    picked = stored(part[0].unionByName(part[1]))
    sample = docs.join(F.broadcast(picked), "doc_id").select(F.col("label").cast("int"), "text")
    counts = _term_rows(sample, buckets).toArrow()
    bucket, pos, neg = (counts.column(c).to_numpy() for c in ("bucket", "pos", "neg"))
    per = np.zeros((2, buckets + 1))
    per[0, bucket], per[1, bucket] = neg, pos  # -1 is the last place
    (n0, n1), (neg, pos) = per[:, -1], per[:, :-1]
    telling = (log_likelihood_ratio(pos, neg, n1, n0) >= LEAST_RATIO) & (pos + neg >= LEAST_ROWS)
    often = pos + neg >= max(LEAST_ROWS, PAIR_SHARE * (n0 + n1))
    rows = _telling_rows(sample, telling | often).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = [r.values.to_numpy() for r in rows.column("terms")] if len(y) else []
    among = np.flatnonzero(often)
    paired = np.zeros(buckets, bool)
    paired[among] = interacting(x, y, among)
    telling |= paired
    x = [r[telling[r]].astype(np.int64) for r in x]
    by = sorted(range(len(x)), key=lambda i: (len(x[i]), x[i].tobytes(), y[i]))  # rows come in any order
    model = fit([x[i] for i in by], y[by] if len(y) else y, telling, paired)
    if n0 and n1 and (n0 < size.get(0, 0) or n1 < size.get(1, 0)):
        model.bias += float(np.log(size[1] / size[0]) - np.log(n1 / n0))
    return model


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out`` (crc32 of the id as text
    mod ``folds`` is 0), ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5).

    Only the text decides.  Null, empty and letterless texts get the score of
    the bias alone.  Rows with a null id are scored and not held out; repeated
    rows come back as often as they occur; documents labelled twice count as the
    larger label.  Without any label every score is 0.5 and so predicted 1;
    an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(train(read, known, folds, sample_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = model.value
        for batch in batches:
            for part, run in _runs(batch):
                p = _sigmoid(fm.margin(*terms(run, len(fm.w), fm.telling)))
                yield part.drop_columns(["text"]).append_column("score", pa.array(p))

    scored = read.mapInArrow(score, "doc_id bigint, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
