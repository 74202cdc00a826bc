"""Ids of pieces of text: each distinct piece is encoded once and remembered, whole passes are gathered by arrays."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

import numpy as np
import pyarrow as pa

from tidemark.llm.shared import buffers

#: Pieces and bytes of pieces in a generation. A worker remembers two: when the young one is full, it becomes the old one, of
#: which only those that come again are taken over.
PIECES, ROOM = 120_000, (16 << 20) * 2 // 5


class Remembered:
    """The ids of known pieces in one line, and where those of each piece begin.

    ``learn`` turns a list of pieces into little-endian ids of each. ``first`` are pieces with places from 0 on
    that are never forgotten. ``share`` is how many times PIECES and ROOM a generation may have.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], first: tuple[bytes, ...] = (), share: float = 1):
        self.learn, self.first, self.share = learn, first, share
        self.clear()

    def clear(self) -> None:
        self.old: Remembered | None = None
        self._begin()

    def _begin(self) -> None:
        self.place: dict[bytes, int] = {}
        self.size, self.used = 0, 0
        self.flat, self.start, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._append(*_joined(list(self.first)))

    def _age(self) -> None:
        self.old = copy(self)
        self.old.old = None
        self._begin()

    def _append(self, new: np.ndarray, count: np.ndarray) -> None:
        n, held = self.size, int(self.start[self.size - 1] + self.count[self.size - 1]) if self.size else 0
        if held + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(new)), np.uint32)])
        if n + len(count) > len(self.start):
            more = np.zeros(max(n, len(count)), np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more])
        self.flat[held : held + len(new)] = new
        self.count[n : n + len(count)] = count
        self.start[n : n + len(count)] = held + np.cumsum(count) - count
        self.size = n + len(count)

    def _add(self, pieces: list[bytes]) -> None:
        """Put new pieces in their places, with the ids of the old generation where it has them."""
        if self.old:
            known = list(map(self.old.place.get, pieces))
            again = [p for p, x in zip(pieces, known, strict=True) if x is not None]
            ids, at = self.old.gather(np.array([x for x in known if x is not None], np.int64))
            self._put(again, ids, np.diff(at))
            pieces = [p for p, x in zip(pieces, known, strict=True) if x is None]
        self._put(pieces, *_joined(self.learn(pieces)))

    def _put(self, pieces: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        n = self.size
        self._append(ids, count)
        self.place.update(zip(pieces, range(n, self.size), strict=True))
        self.used += sum(map(len, pieces))

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece."""
        told = pieces.dictionary_encode()
        data, edge = buffers(told.dictionary)
        blob, at = data.tobytes(), edge.tolist()
        keys = [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        own = list(map(self.place.get, keys))
        new = [k for k, p in zip(keys, own, strict=True) if p is None]
        if new:
            if self.size + len(new) > PIECES * self.share or self.used > ROOM * self.share:
                self._age()
                new = keys
            self._add(new)
            own = list(map(self.place.__getitem__, keys))
        return np.array(own, np.int64)[told.indices.to_numpy(zero_copy_only=False)]

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces at ``places``, one after the other, and the n + 1 offsets of the pieces' ids."""
        count = self.count[places]
        at = np.zeros(len(places) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        where = np.arange(at[-1])
        where += np.repeat(self.start[places] - at[:-1], count)
        return self.flat[where], at


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes cut at ``offsets``, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
