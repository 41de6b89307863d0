"""Language-model scores by prediction with partial matching (PPM, method D).

The model is a byte-context trie of depth ``ORDER``, pretrained on the corpus: a
symbol seen after the longest matching context costs -log((c - 1/2) / T); one
that is not costs the escape D/2 / T (T: symbols counted after the context, D:
distinct ones) and is looked up after the next shorter context, where the
symbols of the longer one are excluded from T and D.  Below order 0 every byte
that was never seen is alike.

A text is scored as its token sequence: A-Z lower-cased, words parted by one
blank, then an end symbol.  Beside the model's code length stands a base: add-one
unigram probabilities of the same tokens.

All counts are grouped aggregations over every training document.  Each Python
worker builds a trie of broadcast counts once.  While the corpus has at most
``MAX_ENTRIES`` sequences that trie is the model.  Beyond, it is a cache of whole
contexts, the commonest of each order with all their symbols and full counts: a
symbol whose contexts it holds costs exactly what the model says, and the others
are joined with the distributed tables of all contexts (``context_levels``), so
the model grows with the corpus and the scores don't depend on the cache.  Word
counts stay distributed alike: the ``FREQUENT`` commonest words are broadcast,
each other word of a document is joined with its count.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship, stored

#: Bytes of the longest context, trie entries and words broadcast at most.
ORDER, MAX_ENTRIES, FREQUENT = 5, 4_000_000, 300_000
_END = 10  # a line feed: it can't occur inside a normalised text
_SYMBOLS = 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64
_CHUNK = 500_000


def is_held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, without the end token."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and tokens, some rows at a time, so that arrays over the bytes stay small."""
    ids, col = batch.column("doc_id").to_pylist(), batch.column("text")
    at, run, size = 0, [], 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        if run and size + len(t) > _CHUNK:
            yield ids[at : at + len(run)], run
            at, run, size = i, [], 0
        run.append(tokens(t))
        size += len(t) + 2
    if run:
        yield ids[at : at + len(run)], run


def symbol_codes(docs: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every text the ``order`` bytes before it and itself,
    as one number (the symbol lowest), and the ends of the texts.  Before a text
    stand end symbols."""
    end = bytes([_END])
    parts = [end * order + b" ".join(d) + end for d in docs]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(_U)
    sizes = np.array([len(p) for p in parts])
    code = np.zeros(len(data), _U)
    for back in range(order, -1, -1):
        code <<= _U(8)
        code[back:] |= data[: len(data) - back]
    keep = np.ones(len(data), bool)
    starts = np.cumsum(sizes) - sizes
    for i in range(order):
        keep[starts + i] = False
    return code[keep], np.cumsum(sizes - order)


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``code, n`` over all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, _U), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            c = np.concatenate([codes, *(h[0] for h in held)])
            w = np.concatenate([n, *(h[1] for h in held)])
            by = np.argsort(c, kind="stable")
            c, w = c[by], w[by]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
            return c[first], np.add.reduceat(w, first) if len(c) else w

        for batch in batches:
            for _, run in _runs(batch):
                held.append(np.unique(symbol_codes(run, order)[0], return_counts=True))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    codes, n = merged()
                    held.clear()
                    if len(codes) > 2_000_000:  # hand on what is counted so far
                        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])
                        codes, n = codes[:0], n[:0]
        codes, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])

    return docs.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``docs``, without the end token."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, run in _runs(batch):
                for d in run:
                    seen.update(d)
                if len(seen) > 500_000:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return docs.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class HashTable:
    """uint64 -> place in the table, by linear probing; no key is 2**64 - 1."""

    keys: np.ndarray
    shift: int
    most: int

    @staticmethod
    def of(keys: np.ndarray) -> tuple[HashTable, np.ndarray]:
        """The table, and the place of each key in it."""
        bits = max(4, int(1.4 * len(keys)).bit_length())
        shift = 64 - bits
        home = (keys * _U(0x9E3779B97F4A7C15) >> _U(shift)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        nth = np.arange(len(keys))
        place = np.maximum.accumulate(home[by] - nth) + nth if len(keys) else nth
        slots = np.full((1 << bits) + len(keys) + 1 if not len(keys) else max(1 << bits, int(place[-1]) + 1) + 1, ~_U(0))
        slots[place] = keys[by]
        where = np.empty(len(keys), np.int64)
        where[by] = place
        return HashTable(slots, shift, int((place - home[by]).max()) if len(keys) else 0), where

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        at = (keys * _U(0x9E3779B97F4A7C15) >> _U(self.shift)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, at, -1)
        open_ = np.flatnonzero((there != keys) & (there != ~_U(0)))
        for step in range(1, self.most + 1):
            if not len(open_):
                break
            there = self.keys[at[open_] + step]
            hit = there == keys[open_]
            out[open_[hit]] = at[open_[hit]] + step
            open_ = open_[~hit & (there != ~_U(0))]
        return out


@dataclass
class Trie:
    """All (context, symbol) entries and contexts of every order, with their
    logarithms to base 10.  Keys of both tables: code * 8 + order."""

    order: int
    entries: HashTable
    log_p: np.ndarray  # of the symbol after this context
    log_count: np.ndarray  # log(c - 1/2)
    contexts: HashTable
    log_escape: np.ndarray  # after this context
    log_rest: np.ndarray  # log T of the next shorter context without this one's symbols
    log_rest_escape: np.ndarray  # escape of that
    log_unseen: float  # of each byte never seen
    whole: tuple[bool, ...]  # per order: whether every context of the corpus is in the trie


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    k, w = keys[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(w, first)


def build_trie(codes: np.ndarray, n: np.ndarray, order: int) -> Trie:
    """From the counts of all sequences of ``order + 1`` symbols."""
    levels, ctx = [], []
    for k in range(order, -1, -1):
        mask = _U((1 << (8 * (k + 1))) - 1)
        codes, n = _grouped(codes & mask, n)
        levels.append((k, codes, n))
    parts = []
    for (k, code, count), shorter in zip(levels, [*levels[1:], None], strict=True):
        context = code >> _U(8)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        total, kinds = np.add.reduceat(count, first), np.diff(np.append(first, len(code)))
        owner = np.repeat(np.arange(len(first)), kinds)
        t, d = np.zeros(len(first)), np.zeros(len(first))
        if shorter is None:
            unseen = _SYMBOLS - len(code)
        else:
            _, code1, count1 = shorter
            at = np.searchsorted(code1, code & _U((1 << (8 * k)) - 1))
            taken = np.add.reduceat(count1[at], first)
            context1 = code1 >> _U(8)
            first1 = np.flatnonzero(np.concatenate(([True], context1[1:] != context1[:-1])))
            total1, kinds1 = np.add.reduceat(count1, first1), np.diff(np.append(first1, len(code1)))
            up = np.searchsorted(context1[first1], context[first] & _U((1 << (8 * (k - 1))) - 1) if k > 0 else context[first])
            t, d = total1[up] - taken, kinds1[up] - kinds
        parts.append((k, code, count, total[owner], context[first], total, kinds, t, d))
    return _assembled(order, parts, unseen, (True,) * (order + 1))


def _assembled(order: int, parts: list[tuple], unseen: int, whole: tuple[bool, ...]) -> Trie:
    """From, per order: entries with their counts and their contexts' totals; and
    contexts with totals, kinds, and both of the next shorter one less their own symbols."""
    keys, log_p, log_count, c_keys, esc, rest, rest_esc = [], [], [], [], [], [], []
    for k, code, count, total, context, t, d, rt, rd in parts:
        keys.append(code * _U(8) + _U(k))
        log_p.append(np.log10((count - 0.5) / total))
        log_count.append(np.log10(count - 0.5))
        c_keys.append(context * _U(8) + _U(k))
        esc.append(np.log10(0.5 * d / t))
        some = rd > 0
        rest.append(np.where(some, np.log10(np.maximum(rt, 1)), 0.0))
        rest_esc.append(np.where(some, np.log10(0.5 * np.maximum(rd, 1) / np.maximum(rt, 1)), 0.0))
    entries, where = HashTable.of(np.concatenate(keys))
    contexts, c_where = HashTable.of(np.concatenate(c_keys))

    def placed(values: list[np.ndarray], where: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size, np.float32)
        out[where] = np.concatenate(values)
        return out

    m, c = len(entries.keys), len(contexts.keys)
    return Trie(
        order,
        entries,
        placed(log_p, where, m),
        placed(log_count, where, m),
        contexts,
        placed(esc, c_where, c),
        placed(rest, c_where, c),
        placed(rest_esc, c_where, c),
        -float(np.log10(unseen)) if unseen > 0 else 0.0,
        whole,
    )


def code_lengths(trie: Trie, codes: np.ndarray) -> np.ndarray:
    """log10 probability of every symbol of ``symbol_codes``; NaN where the trie
    doesn't hold a context that decides it."""
    out = np.zeros(len(codes))
    open_ = np.arange(len(codes))
    rest = rest_escape = None  # of the open symbols, once a longer context was left by an escape
    left = np.zeros(len(codes), bool)
    for k in range(trie.order, -1, -1):
        code = codes[open_] & _U((1 << (8 * (k + 1))) - 1)
        at = trie.entries.find(code * _U(8) + _U(k))
        hit = at >= 0
        if rest is None:
            rest, rest_escape = np.zeros(len(open_)), np.zeros(len(open_))
        out[open_[hit]] += np.where(left[hit], trie.log_count[at[hit]] - rest[hit], trie.log_p[at[hit]])
        miss = ~hit
        open_, code, left, rest, rest_escape = open_[miss], code[miss], left[miss], rest[miss], rest_escape[miss]
        if not len(open_):
            return out
        c = trie.contexts.find((code >> _U(8)) * _U(8) + _U(k))
        known = c >= 0
        if not trie.whole[k] and not known.all():
            out[open_[~known]] = np.nan
            open_, left, rest_escape, c, known = open_[known], left[known], rest_escape[known], c[known], known[known]
        out[open_] += np.where(known, np.where(left, rest_escape, trie.log_escape[c]), 0.0)
        rest, rest_escape = np.where(known, trie.log_rest[c], 0.0), np.where(known, trie.log_rest_escape[c], 0.0)
        left = known
    out[open_] += trie.log_unseen
    return out


@dataclass
class Level:
    """The distributed tables of one order: ``entries`` (code, n) and ``contexts``
    (context, t, d, rt, rd): symbols counted after the context and distinct ones,
    and those of the next shorter context without this one's symbols."""

    order: int
    entries: DataFrame
    contexts: DataFrame


def _low(column: str, n_bytes: int):
    return F.col(column).bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1))


def context_levels(grams: DataFrame, order: int) -> list[Level]:
    """Levels ``order`` to 0 of all sequences counted.  An aggregate and two joins
    an order; no key of these joins has more than 256 rows."""
    entries = {order: grams.select("code", "n")}
    for k in range(order - 1, -1, -1):
        entries[k] = stored(entries[k + 1].groupBy(_low("code", k + 1).alias("code")).agg(F.sum("n").alias("n")))
    sums = {
        k: stored(e.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"))) for k, e in entries.items()
    }
    out = []
    for k in range(order, -1, -1):
        if k == 0:
            full = sums[0].withColumns({"rt": F.lit(0).cast("bigint"), "rd": F.lit(0).cast("bigint")})
        else:
            mine = entries[k].select(F.shiftright("code", 8).alias("context"), _low("code", k).alias("short"))
            short = entries[k - 1].select(F.col("code").alias("short"), F.col("n").alias("n1"))
            taken = mine.join(short, "short").groupBy("context").agg(F.sum("n1").alias("taken"))
            above = sums[k - 1].select(F.col("context").alias("up"), F.col("t").alias("t1"), F.col("d").alias("d1"))
            full = sums[k].join(taken, "context").withColumn("up", _low("context", k - 1)).join(above, "up")
            full = full.select("context", "t", "d", (F.col("t1") - F.col("taken")).alias("rt"), (F.col("d1") - F.col("d")).alias("rd"))
        out.append(Level(k, entries[k], stored(full)))
    return out


def cached_levels(levels: list[Level], max_entries: int) -> tuple[list[tuple], int, tuple[bool, ...]]:
    """Of each order the commonest contexts that have at most ``max_entries``
    symbols in all, for ``_assembled``; the bytes never seen; which orders are whole."""
    parts, whole, unseen = [], {}, _SYMBOLS
    for level in levels:
        # a context's symbols are at most 256, so quarter powers of two cut finely enough
        band = F.floor(F.log2("t") * 4).cast("int")
        bands = level.contexts.groupBy(band.alias("b")).agg(F.sum("d").alias("d")).collect()  # some 250 rows at most
        least, room = None, max_entries
        for r in sorted(bands, key=lambda r: -r["b"]):
            if r["d"] > room:
                break
            least, room = r["b"], room - r["d"]
        whole[level.order] = least is not None and least == min(r["b"] for r in bands)
        kept = level.contexts.where(band >= least) if least is not None else level.contexts.limit(0)
        kept = stored(kept)
        rows = level.entries.withColumn("context", F.shiftright("code", 8)).join(kept.select("context", "t"), "context").select("code", "n", "t").toArrow()
        ctx = kept.toArrow()
        code, context = (t.column(c).to_numpy().astype(np.int64).view(_U) for t, c in ((rows, "code"), (ctx, "context")))
        n, t = (rows.column(c).to_numpy().astype(np.float64) for c in ("n", "t"))
        parts.append((level.order, code, n, t, context, *(ctx.column(c).to_numpy().astype(np.float64) for c in ("t", "d", "rt", "rd"))))
        if level.order == 0:
            unseen = _SYMBOLS - level.entries.count()
    return parts, unseen, tuple(whole[k] for k in range(levels[0].order + 1))


def distributed_lengths(codes: DataFrame, levels: list[Level]) -> DataFrame:
    """``code, log`` of distinct codes from the tables of all contexts: the same
    steps as ``code_lengths``, a join with entries and contexts an order."""
    single = lambda c: c.cast("float").cast("double")  # noqa: E731 - the trie holds single precision
    zero = F.lit(0.0)
    state = codes.select("code", zero.alias("out"), F.lit(False).alias("done"), F.lit(False).alias("left"), zero.alias("rest"), zero.alias("esc"))
    for level in levels:
        k = level.order
        e = level.entries.select(F.col("code").alias("_code"), F.col("n").alias("_n"))
        c = level.contexts.select(F.col("context").alias("_ctx"), "t", "d", "rt", "rd")
        j = state.withColumns({"_code": _low("code", k + 1), "_ctx": F.shiftright(_low("code", k + 1), 8)})
        j = j.join(e, "_code", "left").join(c, "_ctx", "left")
        hit, known, some = F.col("_n").isNotNull(), F.col("t").isNotNull(), F.col("rd") > 0
        found = F.when(F.col("left"), single(F.log10(F.col("_n") - 0.5)) - F.col("rest")).otherwise(single(F.log10((F.col("_n") - 0.5) / F.col("t"))))
        escape = F.when(~known, zero).when(F.col("left"), F.col("esc")).otherwise(single(F.log10(F.lit(0.5) * F.col("d") / F.col("t"))))
        rest = F.when(known & some, single(F.log10(F.greatest(F.col("rt"), F.lit(1)).cast("double")))).otherwise(zero)
        esc = F.when(known & some, single(F.log10(F.lit(0.5) * F.col("rd") / F.greatest(F.col("rt"), F.lit(1))))).otherwise(zero)
        state = stored(
            j.select(
                "code",
                F.when(F.col("done"), F.col("out")).when(hit, F.col("out") + found).otherwise(F.col("out") + escape).alias("out"),
                (F.col("done") | hit).alias("done"),
                known.alias("left"),
                rest.alias("rest"),
                esc.alias("esc"),
            )
        )
    unseen = _SYMBOLS - levels[-1].entries.count()
    never = F.lit(-float(np.log10(unseen)) if unseen > 0 else 0.0)
    return state.select("code", F.when(F.col("done"), F.col("out")).otherwise(F.col("out") + never).alias("log"))


@dataclass
class Model:
    """What the workers build the trie of, and the levels where it isn't whole."""

    grams: tuple[np.ndarray, np.ndarray] | None
    cached: tuple[list[tuple], int, tuple[bool, ...]] | None
    levels: list[Level] | None


def train(docs: DataFrame, order: int = ORDER, max_entries: int = MAX_ENTRIES) -> Model:
    """The model of all sequences of ``order + 1`` symbols of ``docs`` (doc_id, text)."""
    grams = stored(gram_counts(docs, order))
    if grams.count() <= max_entries:
        table = grams.toArrow()
        return Model((table.column("code").to_numpy().astype(np.int64).view(_U), table.column("n").to_numpy().astype(np.int64)), None, None)
    levels = context_levels(grams, order)
    return Model(None, cached_levels(levels, max_entries), levels)


_MODEL: dict[str, tuple[Trie | None, dict[bytes, float]]] = {}


def _model(name: str, grams: tuple | None, cached: tuple | None, words: tuple, order: int) -> tuple[Trie | None, dict[bytes, float]]:
    """The worker's trie and log counts of frequent words, made once."""
    if name not in _MODEL:
        _MODEL.clear()
        trie = None
        if cached is not None:
            trie = _assembled(order, *cached)
        elif len(grams[0]):
            trie = build_trie(grams[0], grams[1].astype(np.float64), order)
        _MODEL[name] = trie, dict(zip(words[0].to_pylist(), np.log10(words[1] + 1).tolist(), strict=True))
    return _MODEL[name]


def score_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    max_entries: int = MAX_ENTRIES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out`` (crc32 of the id as text
    mod 7 is 2), ``n_tokens, n_known, train_tokens, base_score, score``.

    The model and the base learn from the rows that aren't held out.  Null texts
    are empty: one token, the end.  Ids are expected to be unique and not null;
    rows with a null id are left out, repeated rows count and come back as often
    as they occur.  An empty table gives no rows; if every row is held out, all
    bytes are alike to the model.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    training = read.where(~held)
    model = train(training, order, max_entries)
    words = stored(word_counts(training))
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = training.count()
    big_n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    common = top.column("word").combine_chunks(), top.column("n").to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model.grams, model.cached, common, order))
    per_token, end_log = float(np.log10(big_n + v + 1)), float(np.log10(ends + 1))
    uniform = -float(np.log10(_SYMBOLS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _model(*shared.value)
        for batch in batches:
            for ids, run in _runs(batch):
                codes, stops = symbol_codes(run, order)
                logs = code_lengths(trie, codes) if trie else np.full(len(codes), uniform)
                sums = np.diff(np.concatenate(([0.0], np.cumsum(np.nan_to_num(logs))))[np.concatenate(([0], stops))])
                away = [np.unique(c[np.isnan(x)].view(np.int64), return_counts=True) for c, x in zip(np.split(codes, stops[:-1]), np.split(logs, stops[:-1]), strict=True)]
                n, found, base, misses = [], [], [], []
                for d in run:
                    hits = [known[w] for w in d if w in known]
                    n.append(len(d) + 1)
                    found.append(len(hits) + (ends > 0))
                    base.append(sum(hits) + end_log - per_token * (len(d) + 1))
                    misses.append([w for w in d if w not in known] if len(hits) < len(d) else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([is_held_out(i) for i in ids], pa.bool_()),
                        pa.array(n, pa.int64()),
                        pa.array(found, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(sums),
                        pa.array(misses, pa.list_(pa.binary())),
                        pa.array([c for c, _ in away], pa.list_(pa.int64())),
                        pa.array([t for _, t in away], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "misses", "codes", "times"],
                )

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, misses array<binary>, codes array<bigint>, times array<bigint>"
    scored = stored(read.mapInArrow(score, kinds).withColumn("row", F.monotonically_increasing_id()))
    if model.levels is not None:
        away = stored(scored.where(F.size("codes") > 0).select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", "x.*"))
        lengths = distributed_lengths(away.select(F.col("codes").alias("code")).distinct(), model.levels).withColumnRenamed("code", "codes")
        far = away.join(lengths, "codes").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("far"))
        scored = stored(scored.join(far, "row", "left").withColumn("score", F.col("score") + F.coalesce("far", F.lit(0.0))).drop("far"))
    rare = scored.where(F.size("misses") > 0).select("row", F.explode("misses").alias("word")).join(words, "word")
    of_rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("add"))
    return scored.join(of_rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(big_n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        "score",
    )
