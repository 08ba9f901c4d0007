"""Word-shingle sets of whole texts as sorted 64-bit hashes (numpy).

Words are runs outside ASCII white space, A-Z lower-cased.  A text with fewer
words than the width has its whole word sequence as one shingle; without words
the set is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CHUNK = 500_000   # bytes hashed at a time; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x + np.uint64((salt * 0x632BE59BD9B4E019 + 0x1B873593) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(256, dtype=np.uint64), 7)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per process up to the chunk size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _CHUNK // 4), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 2 * _CHUNK:
            _powers[base] = have
    return have[:n]


def _chunk_sets(part: list[bytes], width: int) -> Iterator[np.ndarray]:
    sizes = np.array([len(t) + 1 for t in part], np.int64)
    b = np.frombuffer(b"".join(t + b" " for t in part), np.uint8)
    gap = _SPACE[b]
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * _power(_BASE, len(b)), dtype=np.uint64)])
    word = mix((total[end] - total[start]) * _power(_INVERSE, len(b))[start], 1) ^ mix((end - start).astype(np.uint64), 2)
    edges = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    runs = word.copy()
    for j in range(1, width):   # runs[i] covers words i .. i+width-1
        runs = runs[:-1] * np.uint64(_BASE) + word[j:] if len(runs) > 1 else runs[:0]
    runs = mix(runs, width)
    for i in range(len(part)):
        a, z = int(edges[i]), int(edges[i + 1])
        if z - a >= width:
            yield np.unique(runs[a:z - width + 1])
        elif z > a:
            h = np.uint64(0)
            for w in word[a:z]:
                h = h * np.uint64(_BASE) + w
            yield mix(np.array([h], np.uint64), z - a + 1000)
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in the texts' order."""
    held, size = [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            data = t.encode("utf-8") if t else b""
            held.append(data)
            size += len(data)
            if size > _CHUNK:
                yield from _chunk_sets(held, width)
                held, size = [], 0
        if held:
            yield from _chunk_sets(held, width)


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed values."""
    a, b = mix(tokens, 11).sum(dtype=np.uint64), mix(tokens, 13).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
