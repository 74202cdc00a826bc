"""Compression of vectors to codes: each part of a vector becomes the number of its codebook's nearest entry.

All arithmetic is in integers. A part position has a vantage-point tree over its entries: a node has one entry and the range of
distances from it to the entries inside and outside its radius. A search goes down the nearer side first and visits the
other one unless the triangle inequality rules it out. Ranges are rounded outwards and visited
also where the bound equals the best, so neither rounding nor a tie can lose an entry; every distance that decides is an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Parts of a vector, entries of a codebook, rounds of learning; entries of a leaf of the tree.
PARTS, ENTRIES, ROUNDS, LEAF = 16, 64, 2, 6
#: Distances are square roots of integers in floats; this share of them, outwards, covers the rounding.
ROUND = 1e-9
#: Labels that hold at least 1/HOT of all rows are broadcast with their sums, at most HOT of them.
HOT = 1000


class Tree:
    """Vantage-point tree over the entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._made(np.arange(len(entries)))

    def _made(self, own: np.ndarray) -> tuple:
        if len(own) <= LEAF:
            return (own,)
        rest = own[1:]
        far = np.sqrt(_squares(self.entries[rest], self.entries[own[0]]).astype(np.float64))
        radius = np.median(far)
        inside = far <= radius
        if inside.all():  # all at one distance: nothing to tell sides apart by
            inside = np.arange(len(rest)) < len(rest) // 2
        sides = [(self._made(rest[s]), far[s].min() * (1 - ROUND), far[s].max() * (1 + ROUND)) for s in (inside, ~inside)]
        return own[0], radius, sides

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the number of the nearest entry, the smaller one among ties, and the squared distance."""
        at, best = np.zeros(len(points), np.int64), _squares(points, self.entries[0])
        if len(points):
            self._search(self.root, np.arange(len(points)), points, at, best)
        return at, best

    def _tried(self, entry: int, rows: np.ndarray, points: np.ndarray, at: np.ndarray, best: np.ndarray) -> np.ndarray:
        d = _squares(points[rows], self.entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
        at[rows[better]], best[rows[better]] = entry, d[better]
        return d

    def _search(self, tree: tuple, rows: np.ndarray, points: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        if len(tree) == 1:
            for entry in tree[0]:
                self._tried(entry, rows, points, at, best)
            return
        entry, radius, sides = tree
        d = np.sqrt(self._tried(entry, rows, points, at, best).astype(np.float64))
        near = np.where(d <= radius, 0, 1)
        for turn in 0, 1:
            for side, (child, low, high) in enumerate(sides):
                least = np.maximum(low - d * (1 + ROUND), d * (1 - ROUND) - high)
                visit = ((near == side) == (turn == 0)) & (least <= np.sqrt(best[rows].astype(np.float64)) * (1 + ROUND))
                if visit.any():
                    self._search(child, rows[visit], points, at, best)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to one of ``b``."""
    d = a - b
    return (d * d).sum(1)


def _matrix(column: pa.Array, small: bool) -> np.ndarray:
    """Vectors as rows: 64-bit integers where no sum of squares leaves them, else Python's own."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat.astype(np.int64) if small else flat.astype(object)


def _assigned(trees: list[Tree], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (rows by parts) and the sum of squared distances."""
    width = v.shape[1] // PARTS
    at, error = np.zeros((len(v), PARTS), np.int64), np.zeros(len(v), v.dtype)
    for p, tree in enumerate(trees):
        at[:, p], d = tree.nearest(v[:, p * width : (p + 1) * width])
        error = error + d
    return at, error


def _sums(vectors: DataFrame, books: np.ndarray, small: bool) -> DataFrame:
    """(part, entry, place, total, n) over all parts that an entry is nearest to; a task hands on one row for each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        total, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), small)
            at, _ = _assigned(trees, v)
            for p in range(PARTS):
                own = np.zeros(books.shape[1:], v.dtype)
                np.add.at(own, at[:, p], v[:, p * books.shape[2] : (p + 1) * books.shape[2]])
                total[p] += own
                n[p] += np.bincount(at[:, p], minlength=books.shape[1])
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        used = n[part, entry] > 0
        cols = [part[used], entry[used], place[used]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in cols], pa.array([int(x) for x in total.ravel()[used]], pa.decimal128(38, 0)), pa.array(n[part, entry][used])], names=["part", "entry", "place", "total", "n"])

    made = vectors.select("v").mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n long")
    return made.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def learned(vectors: DataFrame, rounds: int, small: bool) -> np.ndarray:
    """Codebooks (part, entry, place) from rows (vec_id, v), whose first entries are those of the smallest ids.

    What comes to the driver is one codebook's numbers, ENTRIES times a vector's length, whatever the number of rows.
    """
    first = [r.v for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()]
    if not first:
        return np.zeros((PARTS, 0, 1), np.int64)
    start = np.array(first, np.int64 if small else object)
    books = start.reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(vectors, books, small).collect():
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def vector_codes(table: DataFrame, rounds: int = ROUNDS, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector.

    Rows whose vector is null, or has a null or non-finite component, are dropped; components become floor(scale * x), which stays within
    64 bits. Vectors that are shorter than the longest, or whose length 16 does not divide, are taken as if zeros followed; an empty vector is all zeros.
    With fewer than 64 rows there are fewer entries. Rows that share an id are rows of their own, and start codebooks in the order of their
    components; null ids come last. An error beyond 64 bits is given as the largest number. An empty table gives no rows. Other columns are not read.
    """
    x = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    x = x.where("v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    x = staged(x.select("vec_id", "label", F.expr(f"transform(v, c -> cast(floor({scale} * c) as long))").alias("v")), "vectors")
    size = x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.expr("array_max(transform(v, c -> greatest(abs(cast(c as decimal(20,0))), 0)))")).alias("m")).first()
    d = max(-(-(size.d or 0) // PARTS) * PARTS, PARTS)
    x = x.withColumn("v", F.expr(f"concat(v, array_repeat(0L, {d} - size(v)))"))
    small = 4 * d * int(size.m or 0) ** 2 < 2**62
    books = learned(x, rounds, small)
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    most = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            at, error = _assigned(trees, _matrix(batch.column("v"), small))
            code = pa.array([bytes(row).hex() for row in at.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array([min(int(e), most) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = x.schema["label"].dataType.simpleString()
    coded = staged(x.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(most).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = staged(sums.withColumnRenamed("label", "of_label"), "sums")
    hot, rest = F.broadcast(sums.where(F.col("n") * HOT >= size.n)), sums.where(F.col("n") * HOT < size.n)
    same = F.col("label").eqNullSafe(F.col("of_label"))
    own = coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(rest, same))
    return own.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
