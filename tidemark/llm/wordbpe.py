"""Ids of the tokenizers library for whole passes: pieces are found by arrays of byte classes, encoded once, remembered.

The tokenizer lower-cases, drops white space and looks at one piece at a time: an English ending after an apostrophe, a
run of letters, one digit, or a run of anything else. In ASCII and the Latin letters of its first extension
pieces follow from the classes of bytes. A word with other bytes, or with what may be a special token, is one slice from
a space or line end to the next, which no piece crosses; the library parts it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from tidemark.llm.pieces import Remembered, slices

WHITE, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = LETTER
#: Endings that are pieces with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: What is one piece for certain, so that its ids have exactly one end.
_ONE = re.compile(r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+")


def _foreign(data: np.ndarray) -> np.ndarray:
    """Bytes that are neither ASCII nor a Latin letter of the first extension, and those that may begin a special token."""
    high = np.flatnonzero(data >= 0x80)
    after = data[np.minimum(high + 1, len(data) - 1)]
    lead = (data[high] == 0xC3) & (after != 0x97) & (after != 0xB7)
    known = np.zeros(len(data) + 1, bool)
    known[high[lead]] = known[high[lead] + 1] = True
    special = np.flatnonzero(data == 0x3C)
    special = special[data[np.minimum(special + 1, len(data) - 1)] == 0x7C]
    return np.sort(np.concatenate([high[~known[high]], special]))


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of pieces one after the other, where each begins among them (and the end), and the rows' offsets among pieces."""
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    start = kind == DIGIT
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    start[offsets[:-1][offsets[:-1] < n]] = True
    mark = np.flatnonzero((data == 0x27) & start)
    if len(mark):  # alone before a letter of its own row; a letter of the next row begins a piece in any case
        row = np.searchsorted(offsets, mark, "right")
        stop = offsets[np.minimum(row, len(offsets) - 1)]
        at = np.concatenate([data | 0x20, np.zeros(2, np.uint8)])
        one, two = np.where(mark + 1 < stop, at[mark + 1], 0), np.where(mark + 2 < stop, at[mark + 2], 0)
        size = np.zeros(len(mark), np.int64)
        for e in ENDINGS:
            size[(one == ord(e[0])) & (True if len(e) == 1 else two == ord(e[1]))] = len(e)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        start[after[after < n]] = True
    keep = kind != WHITE
    bad = _foreign(data)
    if len(bad):
        gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
        i, row = np.searchsorted(gaps, bad), np.searchsorted(offsets, bad, "right")
        lo = np.maximum(np.concatenate([[-1], gaps])[i] + 1, offsets[row - 1])
        hi = np.minimum(np.concatenate([gaps, [n]])[i], offsets[row])
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] != lo[:-1]
        lo, hi = lo[new], hi[new]
        run = np.concatenate([[0], np.cumsum(hi - lo)])
        own = np.arange(run[-1]) + np.repeat(lo - run[:-1], hi - lo)
        start[own], keep[own] = False, True
        start[lo] = True
    starts = np.flatnonzero(start & keep)
    left = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    return data[keep], np.append(left[starts], left[n]), np.searchsorted(starts, offsets)


class Words:
    """A tokenizer of the library with what a worker remembers of its pieces; place 0 is ``end``."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.ends = np.array([(self.own.id_to_token(i) or "").endswith("</w>") for i in range(self.own.get_vocab_size())])
        self.known = Remembered(self.learn, (np.array([end], "<u4").tobytes(),), 2.5)

    def learn(self, new: list[bytes]) -> list[bytes]:
        """Encode pieces: those of exactly one end by the thousand, spaces between, cut where words end; each other alone."""
        texts = [p.decode("utf-8", "replace") for p in new]
        out: list[bytes] = [b""] * len(new)
        one = _ONE.fullmatch
        sure = [i for i, t in enumerate(texts) if one(t) and "<|" not in t]
        left = np.ones(len(new), bool)
        left[sure] = False
        rest = np.flatnonzero(left).tolist()
        for a in range(0, len(sure), 2000):
            some = sure[a : a + 2000]
            ids = np.array(self.own.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):
                blob, at = ids.tobytes(), [0, *(stop * 4).tolist()]
                for i, x, y in zip(some, at[:-1], at[1:], strict=True):
                    out[i] = blob[x:y]
            else:  # a vocabulary that lacks some letters
                rest += some
        for a in range(0, len(rest), 2000):
            some = rest[a : a + 2000]
            for i, e in zip(some, self.own.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and the n + 1 offsets of the rows' ids."""
        body, at, rows = pieces(data, offsets)
        place = np.zeros(len(at) - 1 + len(rows) - 1, np.int64)
        ends = rows[1:] + np.arange(len(rows) - 1)
        inner = np.ones(len(place), bool)
        inner[ends] = False
        place[inner] = self.known.places(slices(body, at))
        ids, edge = self.known.gather(place)
        return ids, np.concatenate([[0], edge[ends + 1]])


@lru_cache(2)
def words(path: str, end: int) -> Words:
    return Words(path, end)
