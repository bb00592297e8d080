"""Words and shingles of many texts at once, as hash arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 20  # bytes that are worked on together, but for a longer text
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no visible order."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE, _LINKS = 0xD6E8FEB86659FD93, mixed(np.arange(1000, 1016, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, SLICE).bit_length()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p, have = np.ones(size, dtype=np.uint64), 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            out.append(p)
        if size > 4 * SLICE:
            return out  # not kept for one very long text
        _powers[:] = out
    return _powers


def slices(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) in slices of about SLICE bytes; null is empty."""
    first, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if out and size + len(b) > SLICE:
            yield first, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text), A-Z lowered, in order."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    p, inv = powers(len(raw) + 1)
    in_word = ~_BLANK[raw]
    edge = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    terms = _BYTES[raw]
    terms *= p[: len(raw)]
    np.cumsum(terms, out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(firsts, starts, side="right") - 1


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; one of all words where there are fewer than ``width``, none without words."""
    h, doc = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(count)
    joined = np.zeros(len(h), dtype=np.uint64)
    for k in range(min(width, len(h))):
        joined[: len(h) - k] += h[k:] * _LINKS[k]
    joined = mixed(joined)
    out = []
    for i, (n, e) in enumerate(zip(count.tolist(), ends.tolist(), strict=True)):
        if n >= width:
            out.append(np.unique(joined[e - n : e - width + 1]))
        elif n:
            out.append(mixed(np.array([np.sum(h[e - n : e] * _LINKS[:n]) + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
