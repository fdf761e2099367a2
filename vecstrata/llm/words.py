"""Words of many texts at once: positions and 64-bit hashes by array operations.

A word is a run of bytes that are ASCII letters or digits or part of a character
beyond ASCII; ASCII letters are lower-cased.  The hash of a word is a polynomial
of its bytes modulo 2**64, taken from running sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled together; a longer text is hashed in pieces of this size, cut between words.
CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = True
IN_WORD[128:] = True
#: Bytes that white space does not separate.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, step in enumerate((BASE, inverse)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that any of their bits may be used."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hashed_words(texts: list[bytes], in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and after the last)."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(joined):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = in_word[joined]
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    h = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK)))
        first, last = starts[at], ends[end - 1]
        up, down = _powers_to(int(last - first) + 1)
        sums = np.zeros(int(last - first) + 1, np.uint64)
        np.cumsum((LOWER[joined[first:last]].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
        s, e = starts[at:end] - first, ends[at:end] - first
        h[at:end] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, bounds)


def chunks(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """The texts, null as empty, in lists of about CHUNK bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held
