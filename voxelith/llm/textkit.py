"""Vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def _table(word_byte) -> bytes:
    """Bytes to lower-case word bytes; all others become a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if word_byte(b) else 32 for b in range(256))


#: Letters and digits of ASCII and every byte of other characters.
ALNUM = _table(lambda b: b >= 128 or chr(b).isalnum())
#: Everything that is no ASCII white space.
NON_SPACE = _table(lambda b: b not in (32, 9, 10, 11, 12, 13))

_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, size, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], b != 32, [False]])))
    return edge[::2], edge[1::2]


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span's bytes, ``sum (byte + 1) * BASE**(offset)`` mixed with its length.

    The sums are differences of one running sum, divided by the power at the span's start.
    ``step`` bytes are done at a time (more for a longer span), so a long text needs little memory.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + step, "right")))
        size = int(ends[end - 1]) - low
        up, down = powers(size + 1)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum((b[low : low + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=run[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        at = end
    return out


class Words:
    """The words of several texts in one buffer: their places, hashes and texts.

    ``plain`` holds the bytes as they are and ``first[i]`` where text i starts; texts are
    one byte apart.
    """

    def __init__(self, raws: list[bytes | None], table: bytes, fold: bool):
        joined = b" ".join([r or b"" for r in raws])
        self.plain = np.frombuffer(joined, np.uint8)
        mapped = np.frombuffer(joined.translate(table), np.uint8)
        sizes = np.fromiter((len(r or b"") for r in raws), np.int64, len(raws))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.starts, self.ends = spans(mapped)
        self.hashes = hash_spans(mapped if fold else self.plain, self.starts, self.ends)
        self.cuts = np.searchsorted(self.starts, self.first)
        self.text = np.repeat(np.arange(len(raws)), np.diff(self.cuts))


def batches(raws: list[bytes | None], size: int = 1 << 18):
    """Runs of texts of about ``size`` bytes (a longer text is alone), with the place of the first."""
    at, total = 0, 0
    for i, r in enumerate(raws):
        total += len(r or b"")
        if total >= size or i == len(raws) - 1:
            yield at, raws[at : i + 1]
            at, total = i + 1, 0


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
        return mix(out)


def sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of w neighbours."""
    n = len(a) - w + 1
    out = a[:n].copy()
    for i in range(1, w):
        op(out, a[i : i + n], out=out)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of all hashes that are the minimum of some window (all of them, where they tie)."""
    if len(grams) < window:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    low = sliding(np.minimum, grams, window)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    best = sliding(np.maximum, padded, window)
    return np.flatnonzero(best == grams)
