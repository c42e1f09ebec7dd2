"""Vectorised 64-bit hashes of the words and word shingles of Arrow text batches."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _byte_codes() -> np.ndarray:
    lowered = np.arange(256, dtype=np.uint64)
    lowered[65:91] += U(32)
    return mix64(lowered + U(0x1234567))


@functools.cache
def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return white


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(radix: int) -> np.ndarray:
        out = np.full(n, radix, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_RADIX), row(pow(_RADIX, -1, 1 << 64))


def _piece_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in ``data``; ``first`` marks the texts' first bytes."""
    size = 1 << max(18, int(len(data)).bit_length())
    up, down = _powers(size)
    white = _white()[data]
    before = np.empty_like(white)
    before[0] = True
    before[1:] = white[:-1]
    before |= first
    starts = np.flatnonzero(~white & before)
    after = np.empty_like(white)
    after[-1] = True
    after[:-1] = white[1:] | first[1:]
    ends = np.flatnonzero(~white & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * up[: len(data)], out=sums[1:])
    code = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix64(code + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) of ``texts``.

    Returns the hashes in order and, per text, the index of its first word
    (``len(texts) + 1`` entries). A null text has no words.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base: base + total]
    offsets = offsets - base
    first = np.zeros(total, bool)
    first[offsets[:-1][offsets[:-1] < total]] = True
    starts, hashes, at = [], [], 0
    while at < total:
        to = min(total, at + _PIECE)
        if to < total:  # cut where no word goes on
            cuts = np.flatnonzero(_white()[data[at:to]] | first[at:to])
            while not len(cuts) or not cuts[-1]:
                more = min(total, to + _PIECE)
                cuts = np.flatnonzero(_white()[data[at:more]] | first[at:more])
                to = more
                if more == total:
                    break
            to = at + int(cuts[-1]) if len(cuts) and cuts[-1] and to < total else to
        s, h = _piece_words(data[at:to], first[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words.

    A shorter text with at least one word has one shingle, its whole sequence.
    """
    codes, at = word_hashes(texts)
    out = []
    grams = np.zeros(0, np.uint64)
    if len(codes) >= words:
        n = len(codes) - words + 1
        grams = codes[:n].copy()
        for k in range(1, words):
            grams = mix64(grams * U(_RADIX) + codes[k: n + k])
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        if n >= words:
            out.append(np.unique(grams[a: b - words + 1]))
        elif n:
            gram = codes[a: a + 1].copy()
            for k in range(1, n):
                gram = mix64(gram * U(_RADIX) + codes[a + k: a + k + 1])
            out.append(mix64(gram + U(int(n))))
        else:
            out.append(codes[:0])
    return out
