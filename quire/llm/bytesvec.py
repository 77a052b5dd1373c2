"""Vectorised word splitting and hashing over Arrow text columns.

Texts are taken as their UTF-8 bytes. Every separator class used by the
operators is made of ASCII bytes, which never occur inside a longer UTF-8
sequence, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling hash (2^64 / golden ratio) and mixing constants (SplitMix64).
R = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RINV = pow(R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def class_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(chars, dtype=np.uint8)] = True
    return t


#: The separators of words [^\x20\x09-\x0D]+.
SPACE = class_table(b" \t\n\x0b\x0c\r")

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i mod 2^64 for i below n."""
    if len(_powers.get("r", ())) < n:
        n2 = max(n, 1 << 16)
        for k, base in (("r", R), ("i", _RINV)):
            p = np.ones(n2, dtype=np.uint64)
            done = 1
            while done < n2:  # doubling: p[done:2*done] = p[:done] * base^done
                m = min(done, n2 - done)
                p[done : done + m] = p[:m] * np.uint64(pow(base, done, 1 << 64))
                done += m
            _powers[k] = p
    return _powers["r"][:n], _powers["i"][:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 array of all texts and their n+1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pa.compute.fill_null(col, b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(col: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `limit` bytes; a longer text is a range of its own."""
    _, off = text_buffer(col)
    start, n = 0, len(off) - 1
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each maximal run without separators; texts bound runs."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~separators[raw]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last = inside[:n] & ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial mod 2^64."""
    r, ri = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * r[: len(raw)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * ri[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word_hash: np.ndarray, text_of: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct `width`-word shingles of each text, sorted by text then hash.

    A text of fewer, but not none, words has one: its whole sequence.
    """
    n = len(word_hash)
    counts = np.bincount(text_of, minlength=n_texts)
    h = np.zeros(n, dtype=np.uint64)
    left = np.arange(n) - np.concatenate(([0], np.cumsum(counts)))[text_of]  # place in its text
    room = counts[text_of] - left  # words from here to the end of the text
    keep = (room >= width) | (left == 0)
    for k in range(width):
        part = np.zeros(n, dtype=np.uint64)
        ok = room > k
        part[: n - k][ok[: n - k]] = word_hash[k:][ok[: n - k]]
        h = np.where(ok, mix(h * np.uint64(R) + part + np.uint64(k + 1)), h)
    h, t = h[keep], text_of[keep]
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[new], t[new]
    return h, t
