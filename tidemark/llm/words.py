"""Words of texts as 64-bit hashes, in numpy, for shingles and windows of words.

A word is a run of bytes of a class; A-Z count as a-z. Texts are UTF-8, and the classes hold all
bytes from 0x80 on, so a word never ends inside a character.
"""

from __future__ import annotations

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased: digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.RandomState(7).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[_FOLD]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWER = np.zeros(0, np.uint64)
_BACK = np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse; kept up to a pass, 16 MB."""
    global _POWER, _BACK
    if len(_POWER) >= n:
        return _POWER, _BACK
    n = 1 << max(16, (n - 1).bit_length())
    power = _powers(n)
    back = np.full(n, _INVERSE, np.uint64)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    if n <= 1 << 20:
        _POWER, _BACK = power, back
    return power, back


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of each word, and the n + 1 offsets of the rows' words."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = kind[data]
    step = np.diff(inside)
    ends_here = step[:n + 1]
    starts, ends = np.flatnonzero(ends_here == 1), np.flatnonzero(ends_here == -1)
    cut = offsets[1:-1]
    # a word that runs over the end of a row is two words
    cut = cut[(cut > 0) & (cut < n)]
    if len(cut):
        cut = np.unique(cut)
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    power, back = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


_GRAM = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; len(hashes) - k + 1 values, over the ends of rows too."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for i in range(1, k):
        out *= _GRAM
        out += hashes[i : i + m]
    return mixed(out + np.uint64(k))


def gram_rows(row_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``grams`` that lie inside one row, and the rows' n + 1 offsets among them."""
    size = np.diff(row_words)
    count = np.maximum(size - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(count)])
    where = np.arange(offsets[-1]) + np.repeat(row_words[:-1] - offsets[:-1], count)
    return where, offsets


def whole_rows(hashes: np.ndarray, row_words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of all words of each of ``rows``, as grams() has it for that many words; rows are short ones."""
    out = np.zeros(len(rows), np.uint64)
    sizes = row_words[rows + 1] - row_words[rows]
    for k in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == k)
        first = row_words[rows[at]]
        h = hashes[first].copy()
        for i in range(1, int(k)):
            h *= _GRAM
            h += hashes[first + i]
        out[at] = mixed(h + np.uint64(int(k)))
    return out
