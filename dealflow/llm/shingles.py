"""Word shingles and fast similarity sketches of whole texts (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

_MASK = (1 << 64) - 1


def _numbers(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers (odd, so that multiplying by one loses nothing)."""
    out = [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "little") | 1 for i in range(n)]
    return np.array(out, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(_numbers(1, 1)[0])
_WORD, _SHORT = _numbers(1, 2)[0], _numbers(16, 3)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(n - 1, _BASE)]).astype(np.uint64)) if n > 64 else _FEW[:n]


_FEW = np.array([pow(_BASE, i, 1 << 64) for i in range(64)], np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case; blanks are space and tab to return."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    solid = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begins):
        return np.zeros(0, np.uint64)
    lengths = ends - begins
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    letters = _LOWER[raw[solid]].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * _powers(int(lengths.max()))[place], starts)
    return mixed(sums + lengths.astype(np.uint64) * _WORD)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; all words as one if there are fewer, none without words."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mixed(np.array([sum(int(w) * int(_SHORT[i]) for i, w in enumerate(words)) + n & _MASK], np.uint64))
    made = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        made = mixed(made + words[i:n - width + 1 + i] * _SHORT[i])
    return np.unique(made)


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: ``size`` coordinates that agree with probability the Jaccard similarity.

    In round i < size every item falls into a hashed bin with the value (i,
    hash); in round size + i all fall into bin i.  A coordinate is the least
    value of its bin.  Rounds go on until no bin is empty, which the last
    ``size`` rounds guarantee; sets of many items need a few rounds.
    """
    least = np.full(size, _MASK, np.uint64)
    done, step = 0, max(1, 4 * size // len(items))
    while done < 2 * size and (least == np.uint64(_MASK)).any():
        rounds = np.arange(done, min(done + step, 2 * size), dtype=np.uint64)
        seeds = mixed((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        values = mixed(items[None, :] ^ seeds[:, None])
        bins = ((values >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        bins = np.where(rounds[:, None] < size, bins, rounds[:, None] - np.uint64(size))
        # the round in the top bits, then bits of the hash that the bin doesn't use
        values = (rounds[:, None] << np.uint64(54)) | (mixed(values) >> np.uint64(10))
        np.minimum.at(least, bins.ravel().astype(np.int64), values.ravel())
        done += step
    return least


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit hash for each group of ``rows`` coordinates; the band's number is part of it."""
    groups = least.reshape(-1, rows)
    made = np.arange(1, len(groups) + 1, dtype=np.uint64)
    for i in range(rows):
        made = mixed(made * _WORD + groups[:, i])
    return made.view(np.int64)


def low_bits(least: np.ndarray) -> tuple[int, int]:
    """The lowest bit of each coordinate (at most 96), packed into two non-negative longs."""
    bits = (least & np.uint64(1)).astype(np.int64)
    half = np.int64(1) << np.arange(48, dtype=np.int64)
    padded = np.concatenate([bits, np.zeros(96 - len(bits), np.int64)])
    return int(padded[:48] @ half), int(padded[48:] @ half)


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.md5(items.tobytes()).digest()

