"""Byte-level BPE: boundaries by array scans, cached pair merging, offsets kept for decoding.

The pattern that splits texts is ``public_tokenizers.PATTERN``; here it is five classes of code
points and what their neighbours make of them, computed for millions of characters at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pieces import Remembered, slices
from tidemark.llm.shared import as_list, buffers, map_texts

#: Classes of code points: others, letters, numbers, white space, and the space itself, which opens the next piece.
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
#: Code points with the property White_Space.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as a piece of its own.
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.fromiter((LETTER if k == "L" else NUMBER if k == "N" else OTHER for k in (unicodedata.category(chr(i))[0] for i in range(0x110000))), np.uint8, 0x110000)
    out[list(_WHITE)] = WHITE
    out[0x20] = SPACE
    return out


def piece_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces begin among the code points of texts one after the other; ``rows`` are where texts begin and end.

    A run of one class is a piece. Its transition functions either keep the place where the run began
    or set it to their own, so their composition over all prefixes is one running maximum. A single
    space, or the last one of a run, opens the piece after it; white space before it is a piece.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    white = kind >= WHITE
    base = np.where(white, np.uint8(WHITE), kind)
    new = np.ones(n + 1, bool)  # a run begins; the end is one, too
    new[1:n] = base[1:] != base[:-1]
    new[rows[rows <= n]] = True
    begin = np.maximum.accumulate(np.where(new[:n], np.arange(n, dtype=np.int32), np.int32(0)))
    cut = np.zeros(n + 1, bool)
    cut[rows[rows <= n]] = True
    last = new[1:] & ~cut[1:] & white  # the last of a run of white space that something follows in the same text
    start = new[:n].copy()
    start |= last  # what is before it in its run, if anything, ends here
    held = np.zeros(n, bool)
    held[1:] = last[:-1] & (kind[:-1] == SPACE)
    start &= ~held
    # an apostrophe alone between its text's start or a piece without space before it and short endings
    mark = np.flatnonzero((points == 0x27) & start)
    mark = mark[begin[mark] == mark]
    mark = mark[new[mark + 1] & ~cut[mark + 1]] if len(mark) else mark
    if len(mark):
        at = np.pad(points, (0, 2))
        left = ~np.concatenate([cut, [True, True]])
        one, two = at[mark + 1], np.where(left[mark + 2], at[mark + 2], 0)
        size = np.zeros(len(mark), np.int64)
        for s in _SHORT:
            fits = (one == ord(s[0])) & (True if len(s) == 1 else two == ord(s[-1])) & (size == 0)
            size[fits] = len(s)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Codec:
    """Ids of pieces by the ranks of a tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = dict(map(reversed, self.ranks.items()))
        self.bytes_of = pa.array([self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)], pa.large_binary())
        self.known = Remembered(lambda pieces: [np.array(self.merged(p), "<u4").tobytes() for p in pieces])

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is merged first, the leftmost among equals; n log n steps."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := p + part[k]) in ranks:
                    heapq.heappush(heap, (ranks[q], i, q))
            if (h := before[i]) >= 0 and (q := part[h] + p) in ranks:
                heapq.heappush(heap, (ranks[q], h, q))
        return [ranks[p] for p in part if p is not None]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n + 1 offsets of each text's ids. Bytes that are no UTF-8 count as U+FFFD."""
        data, offsets = valid(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(lead, offsets)
        starts = piece_starts(points, rows)
        ids, at = self.known.gather(self.known.places(slices(data, np.append(lead[starts], len(data)))))
        return ids, at[np.searchsorted(starts, rows)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids and the n + 1 offsets at which each id's bytes begin."""
        return buffers(self.bytes_of.take(pa.array(ids)))


def valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts in which what is no UTF-8 is U+FFFD; as they are if all is UTF-8."""
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return data, offsets


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "ids") -> DataFrame:
    """``keep`` and ``name`` (array of ids) for each row; null and empty texts give empty arrays, bytes that are no UTF-8 those of U+FFFD.

    ``path`` is that of the ranks, which every executor must have. A text longer than a pass is
    worked on alone; memory follows the longest text.
    """

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        ids, at = codec(path).encode(data, offsets)
        return {name: as_list(ids.view(np.int32), at)}

    types = dict(docs.dtypes)
    return map_texts(docs, text, list(keep), ", ".join(f"`{k}` {types[k]}" for k in keep) + f", {name} array<int>", work, lambda: codec(path).known.clear())


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded again.

    One row per row; a null text counts as an empty one, which has no ids. Bytes that are no UTF-8 are decoded as U+FFFD. Each
    text is cut from the decoded bytes by the offsets of its ids. Very long texts are encoded whole, in a pass of their own; rows that repeat
    or share an id stay as many as they are, and no rows give none. Other columns are not read, whatever their names.
    """

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        own = codec(path)
        ids, at = own.encode(data, offsets)
        back, places = own.decode(ids)
        tell = lambda x, edge: pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.string())
        return {"n_tokens": pa.array(np.diff(at)), "ids_sha256": tell(ids, at), "decoded_sha256": tell(back, places[at])}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, "text", ["doc_id"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work, lambda: codec(path).known.clear())
