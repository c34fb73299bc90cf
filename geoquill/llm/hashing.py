"""Vectorised hashes of words, shingles and byte windows with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte and odd multipliers.
BYTE = _rng.integers(0, 2**64, 256, dtype=U)
MUL = _rng.integers(0, 2**64, 64, dtype=U) | U(1)
#: Bytes of a word that one lookup block covers, and a random value for every (place in the block, byte).
BLOCK = 64
PLACE = _rng.integers(0, 2**64, (BLOCK, 256), dtype=U)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_LOWPLACE = PLACE[:, _lower].ravel()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word: runs of bytes that are not ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, U)
    gap = np.empty(len(raw) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _space[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, U)
    return _hashed(raw, begin, end)


def _hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tabulation hashes of the byte runs [begin, end): each (place, byte) has a random value of its own.

    Two different runs of up to 64 bytes differ by random values, whatever their pattern. Longer ones are cut into
    blocks, whose sums are mixed with the block's number before they are added up.
    """
    size = end - begin
    long = size > BLOCK
    if long.any():
        pieces = np.where(long, -(-size // BLOCK), 1)
        first = np.cumsum(pieces) - pieces
        number = np.arange(pieces.sum()) - np.repeat(first, pieces)
        at = np.repeat(begin, pieces) + number * BLOCK
        stop = np.minimum(at + BLOCK, np.repeat(end, pieces))
        sums = mix(_sums(raw, at, stop) + number.astype(U) * MUL[59])
        whole = np.add.reduceat(sums, first)
    else:
        whole = mix(_sums(raw, begin, end))
    return mix(whole + size.astype(U) * MUL[60])


def _sums(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    spots = place + np.repeat(begin.astype(np.int32), size)
    return np.add.reduceat(_LOWPLACE[(place << 8) + raw[spots]], at)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; with fewer words the whole sequence is one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(k, n)
    h = np.full(n - width + 1, U(width))
    for j in range(width):
        h = h + words[j : n - width + 1 + j] * MUL[j]
    return np.unique(mix(h).view(np.int64))
