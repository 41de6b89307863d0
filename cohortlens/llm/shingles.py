"""Word and shingle hashes of many texts at once, with numpy.

Words are runs of ASCII letters and digits and of non-ASCII characters in the
lower-cased text.  All texts of a chunk are hashed together: a word's hash is a
polynomial over its bytes, read off two prefix sums, so no Python code runs per
word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), _U(base), _U)
        p[0] = _U(1)
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


@dataclass
class Words:
    """Word hashes of a chunk of texts; text i owns words start[i]:start[i+1]."""

    hashes: np.ndarray
    start: np.ndarray


def words(texts: Sequence[str | None]) -> Words:
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    first, last = edge[0::2], edge[1::2]  # every text ends with a blank, so each word ends
    total = np.concatenate(([_U(0)], np.cumsum((data.astype(_U) + _U(1)) * powers(BASE, len(data)), dtype=_U)))
    hashes = mix((total[last] - total[first]) * powers(INVERSE, len(data))[first] + (last - first).astype(_U))
    start = np.concatenate(([0], np.searchsorted(first, ends)))
    return Words(hashes, start.astype(np.int64))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` successive words, in text order, and their starts by text.
    A text of fewer words has one shingle of them all; one without words, none."""
    n = np.diff(w.start)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(w.start[:-1] - start[:-1], count) + np.arange(start[-1])
    ends = np.repeat(w.start[1:], count)
    padded = np.concatenate((w.hashes, np.zeros(k, _U)))
    out = np.zeros(len(at), _U)
    for i in range(k):
        word = np.where(at + i < ends, padded[at + i], _U(0))
        out = mix(out * _U(BASE) + word)
    return out, start


def label_occurrences(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of a shingle in
    its text, so that no value occurs twice in a text."""
    if not len(hashes):
        return hashes
    text = np.repeat(np.arange(len(start) - 1), np.diff(start)).astype(_U)
    key = mix(hashes + text * _U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    run = key[order]
    new = np.concatenate(([True], run[1:] != run[:-1]))
    at = np.arange(len(run))
    occurrence = np.empty(len(run), _U)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
    return mix(hashes + occurrence * _U(0xA0761D6478BD642F))


def chunks(texts: Sequence[str | None], most: int = 800_000) -> Iterator[tuple[int, Sequence[str | None]]]:
    """Runs of texts of about ``most`` characters (a longer text is its own run)."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield at, texts[at:]
