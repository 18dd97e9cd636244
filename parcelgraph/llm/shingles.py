"""Sets of word shingles as sorted 64-bit hashes, computed with whole-array operations.

Words are runs of bytes between ASCII white space, with A-Z lowered. A word's hash comes from the
prefix sums of a polynomial over the bytes (modulo 2**64), so that no word becomes a Python object;
a shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C55)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; longer texts are cut at white space.
_BLOCK = 1 << 20
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        size = 1 << int(n - 1).bit_length()
        table = np.empty((2, size), np.uint64)
        for k, r in enumerate((_R, _R_INVERSE)):
            table[k] = r
            table[k, 0] = 1
            table[k] = np.multiply.accumulate(table[k])
        _powers = table
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _block_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    forth, back = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words, in order."""
    raw = text.encode("utf-8", "replace").lower()
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_block_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_PLACES = [np.uint64(x | 1) for x in (0xD1B54A32D192ED03, 0xABC98388FB8FAC02, 0x8CB92BA72F3D8DD6, 0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8, 0x27D4EB2F165667C4, 0x9FB21C651E98DF24, 0xA0761D6478BD642E)]


def _place(k: int) -> np.uint64:
    return _PLACES[k] if k < len(_PLACES) else mix(np.array([k + 1], np.uint64))[0] | np.uint64(1)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    if n < width:
        total = np.uint64(n)
        for k in range(n):
            total = total + words[k : k + 1] * _place(k)
        return mix(total)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _place(k)
    return np.unique(mix(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def minhash(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each odd multiplier the least upper half of its products, as 32-bit integers."""
    out = np.full(len(multipliers), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(values), 4096):
        out = np.minimum(out, ((values[at : at + 4096, None] * multipliers) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers drawn with ``seed``."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
