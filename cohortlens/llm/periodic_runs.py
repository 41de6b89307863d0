"""Periodic runs of words in whole texts, by online dyadic square catching.

A run is a stretch of consecutive words of smallest period q (words q apart are
identical) that no neighbouring word extends and that is long enough.  A
document's words are appended to a ``SquareCatcher`` in order.  Every completed
block of a power of two of words has a catcher: as words are appended, the hash
of the newest suffix of that length is compared with the block that lies one to
two block lengths back (each suffix with one block a level, so a word costs one
comparison a level).  A hit is a repeat of the block q words later; it is
verified word by word and grown to both sides.  A repeat that reaches the end of
the text so far stays open and grows with the words to come; squares of the same
period that touch are one region, and a long enough region is a run.

No run is missed: in a run of period q at least ``max(24, 3 q) - q`` words equal
the word q later, which holds a whole aligned block of the level of q.
Hashes only propose; words decide.

Texts are handled one at a time inside the tasks of a single narrow pass: no
exchange, and a task holds one text and its runs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship

#: Least words of a run, least periods in it, words appended at a time, words a worker keeps numbers of.
MIN_WORDS, MIN_PERIODS, CHUNK, KNOWN_WORDS = 24, 3, 16_384, 2_000_000
#: Words of the shortest blocks; their catchers see all shorter periods too.
BLOCK = 8
_SLICE = 256
_OUT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Powers:
    """Powers of an odd number modulo 2**64, as many as asked for so far."""

    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) <= n:
            steps = np.full(max(n + 1, 2 * len(self.table)), 0x9E3779B97F4A7C15, np.uint64)
            steps[0] = 1
            self.table = np.cumprod(steps)
        return self.table


_POWERS = _Powers()


def _spread(ids: np.ndarray) -> np.ndarray:
    """64 random-looking bits for each number."""
    x = ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SquareCatcher:
    """Runs of a growing sequence of word numbers (see the module docstring).

    ``append`` takes the next words, any number at a time; ``runs`` gives the
    runs of the words so far as sorted ``(start, length, period)``.  The order of
    calls doesn't change the result."""

    def __init__(self, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS):
        if min_periods < 3 or min_words < 3 * BLOCK:
            raise ValueError("catchers need runs of three periods and three shortest blocks at least")
        self.min_words, self.min_periods = min_words, min_periods
        self.words = np.empty(0, np.int64)
        self.sums = np.zeros(1, np.uint64)  # of spread(word) * power(place), before each place
        self.after: dict[int, int] = {}  # per block length: first suffix start not compared yet
        self.open: list[tuple[int, int, int]] = []  # regions (start, end, period) that reach the end
        self.closed: list[tuple[int, int, int]] = []  # regions that are long enough and can't grow

    def append(self, words: np.ndarray) -> None:
        old = len(self.words)
        self.words = np.concatenate([self.words, words]) if old else np.asarray(words, np.int64)
        n = len(self.words)
        power = _POWERS.upto(n)
        added = np.cumsum(_spread(self.words[old:]) * power[old:n]) + self.sums[-1]
        self.sums = np.concatenate([self.sums, added])
        grown, self.open = self.open, []
        for start, end, q in grown:
            self._file(start, self._right(end - q, q) + q, q)
        length = BLOCK
        while length * self.min_periods <= n or length == BLOCK:
            self._level(length, n)
            length *= 2

    def _file(self, start: int, end: int, q: int) -> None:
        if end == len(self.words):
            self.open.append((start, end, q))
        elif self._enough(start, end, q):
            self.closed.append((start, end, q))

    def _enough(self, start: int, end: int, q: int) -> bool:
        return end - start >= max(self.min_words, self.min_periods * q)

    def _level(self, length: int, n: int) -> None:
        """Compare the suffixes of ``length`` words completed since the last call."""
        lo = self.after.get(length, 0)
        hi = n - length + 1
        if hi <= lo:
            return
        self.after[length] = hi
        power, sums = _POWERS.table, self.sums
        b = np.arange(lo, hi)
        suffix = sums[lo + length : n + 1] - sums[lo:hi]
        m = b // length
        found_s, found_q = [], []
        for back in (0, 1) if length == BLOCK else (1,):
            s = (m - back) * length
            live = (s >= 0) & (s < b)
            s0 = np.where(live, s, 0)
            q = b - s0
            hit = np.flatnonzero(live & ((sums[s0 + length] - sums[s0]) * power[q] == suffix))
            found_s.append(s0[hit])
            found_q.append(q[hit])
        s, q = np.concatenate(found_s), np.concatenate(found_q)
        if not len(s):
            return
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        for start, end, p in self.open + self.closed:
            s, q = self._outside(s, q, length, start, end, p)
        while len(s):
            at, period = int(s[0]), int(q[0])
            right = self._right(at, period)
            if right - at < length:  # equal hashes of different words
                s, q = s[1:], q[1:]
                continue
            start, end = self._left(at, period), right + period
            self._file(start, end, period)
            s, q = self._outside(s, q, length, start, end, period)

    @staticmethod
    def _outside(s: np.ndarray, q: np.ndarray, length: int, start: int, end: int, p: int):
        """Repeats that region (start, end, p) doesn't account for.  One inside
        it is the region itself if q = p; if p < q and both periods reach over
        p + q - gcd words, q isn't the smallest period of anything there."""
        inside = (s >= start) & (s + q + length <= end) & (q >= p)
        if not inside.any():
            return s, q
        known = inside & ((q == p) | (length >= p - np.gcd(q, p)))
        return s[~known], q[~known]

    def _right(self, i: int, q: int) -> int:
        """First place from ``i`` on whose word differs from the one q later."""
        w, n, step = self.words, len(self.words) - q, 32
        while i < n:
            j = min(n, i + step)
            differs = w[i:j] != w[i + q : j + q]
            k = int(differs.argmax())
            if differs[k]:
                return i + k
            i, step = j, min(4 * step, 65_536)
        return n

    def _left(self, i: int, q: int) -> int:
        """Least place from which on up to ``i`` all words equal those q later."""
        w, step = self.words, 32
        while i > 0:
            j = max(0, i - step)
            differs = (w[j:i] != w[j + q : i + q])[::-1]
            k = int(differs.argmax())
            if differs[k]:
                return i - k
            i, step = j, min(4 * step, 65_536)
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        smallest: dict[tuple[int, int], int] = {}
        for start, end, q in self.closed + [r for r in self.open if self._enough(*r)]:
            smallest[start, end] = min(q, smallest.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in smallest.items())


def numbered(words: list[bytes], known: defaultdict) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    if len(ids) < min_words:
        return []
    catcher = SquareCatcher(min_words, min_periods)
    for at in range(0, len(ids), chunk):
        catcher.append(ids[at : at + chunk])
    return catcher.runs()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: what a run holds after its first period goes."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_periods: int = MIN_PERIODS,
    places: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs`` (all of them, by
    start, then period) and ``collapsed``: the text's words without those that a
    run holds after its first period, joined by one blank.

    Words are what ASCII blanks separate.  ``places(doc_id, n)`` may give, for a
    text of n words, the numbers of the words to read in their stead (None: as
    they are).  Null texts have no words, no runs and an empty ``collapsed``; null
    ids are passed on; repeated rows give repeated rows; an empty table gives no
    rows; other columns are ignored whatever their names.
    """
    ship(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = defaultdict(count().__next__)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                n_words, found, collapsed = [], [], []
                for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = (t or b"").split()
                    if len(known) > KNOWN_WORDS:
                        known = defaultdict(count().__next__)
                    ids = numbered(words, known)
                    read = places(key, len(words)) if places else None
                    if read is not None:
                        ids, words = ids[read], [words[i] for i in read.tolist()]
                    runs = runs_of(ids, min_words, min_periods)
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                    n_words.append(len(ids))
                    found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_words": pa.array(n_words, pa.int64()),
                        "runs": pa.array(found, pa.list_(_RUN)),
                        "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
                    }
                )

    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(find, _OUT)


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the run of the greatest
    length a period (ties: least start, then period; nulls without a run), and
    SHA-256 digests of all runs and of the collapsed text."""

    def before(x, y):
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(left != right, F.when(left > right, -1).otherwise(1)).otherwise(
            F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1))
            .otherwise(0)
        )

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("best.length * 1000 div best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def crc_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """``places`` of the registered query: one document in ten, by the CRC-32 of
    its decimal id, is read with a period from some word on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    read = np.arange(n)
    read[a:] = a + np.arange(n - a) % p
    return read
