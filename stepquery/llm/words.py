"""Word hashes from running sums over a text's bytes: no word becomes a Python object.

Words are what stands between ASCII white space. A word's hash is a polynomial of its bytes modulo 2^64, mixed.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of a text hashed at once.
SEGMENT = 1 << 18
A, B = np.uint64(0xD1342543DE82EF95), np.uint64(0xFF51AFD7ED558CCD)
#: A fixed random number for each byte; in the folded table capitals have those of the small letters.
EXACT = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]
SPACE = np.array([c in b" \t\n\v\f\r" for c in range(256)])
_SEPARATORS = (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        t = np.full(n + 1, b, np.uint64)
        t[0] = 1
        out.append(np.cumprod(t, out=t))
    return out[0], out[1]


_UP, _DOWN = powers(SEGMENT, int(A))


def _segment(b: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.concatenate([[True], SPACE[b], [True]])
    edge = np.nonzero(gap[1:] != gap[:-1])[0]
    start, end = edge[::2], edge[1::2]
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * _UP[: len(b)], out=upto[1:])
    h = (upto[end] - upto[start]) * _DOWN[start]
    h = (h ^ (h >> np.uint64(32))) * B
    return h ^ (h >> np.uint64(29)), start, end


def split(data: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word. fold: capitals A-Z count as small letters."""
    table, parts, at = FOLDED if fold else EXACT, [], 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        if stop < len(data):  # end a segment between words
            cut = max(data.rfind(c, at, stop) for c in _SEPARATORS)
            if cut < at:  # a word longer than a segment is hashed by itself
                ends = [e for c in _SEPARATORS if (e := data.find(c, stop)) >= 0]
                stop = min(ends, default=len(data))
                word = data[at:stop]
                parts.append((np.array([xxhash.xxh3_64_intdigest(word.lower() if fold else word)], np.uint64), np.array([at]), np.array([stop])))
                at = stop
                continue
            stop = cut + 1
        h, start, end = _segment(np.frombuffer(data, np.uint8, stop - at, at), table)
        parts.append((h, start + at, end + at))
        at = stop
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
