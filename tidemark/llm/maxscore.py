"""Exact top-k by inner product over integer vectors, with MaxScore.

A term is a dimension with a sign; its postings in a shard are the vectors with such a component. A
query's terms are its dimensions with its own signs: those add to a score, at most by the query's
weight times the largest posting; postings of the opposite sign only take away. Terms are ordered by
that bound. While the bounds of the smallest terms sum to less than the k-th best score so far, those
terms are non-essential: a vector that no essential posting has cannot enter the result. Vectors of
essential postings get these scores first, and are probed for the other terms only while what they
have and the bounds of the rest reach the k-th best. Ties are never cut off.

Vectors stay where they are stored. Queries come to them in blocks of a fixed size, by broadcast: a block searches the first
shard, whose k-th best is each query's floor in all others, which so prune from the start and hand on few rows. Shards are merged last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Numbers in a shard and in a block of queries, which bound what a task and the driver hold; vectors that a shard has at least
#: where there are fewer shards than cores; vectors that a traversal takes between two looks at the k-th best.
SHARD, BLOCK, LEAST, STEP = 1 << 22, 1 << 22, 4096, 4096
#: Terms that are probed between two comparisons with the k-th best.
PROBE = 16


class Shard:
    """Postings of one shard, a line of weights for each dimension, rows in ascending order of id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.lines = rows[order], ids[order], np.ascontiguousarray(vectors[order].T)
        self.top = np.maximum(self.lines.max(1), 0)
        self.bottom = np.maximum((-self.lines).max(1), 0)

    def search(self, own: int, q: np.ndarray, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but row ``own``, best first, smaller ids first among ties; none under ``least``."""
        bound = np.where(q > 0, q * self.top, -q * self.bottom)
        terms = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # of the terms from each place on
        best_ids, best = np.zeros(0, self.ids.dtype), np.zeros(0, self.lines.dtype)
        for a in range(0, len(self.ids), STEP):
            ids, names, rows = self.ids[a : a + STEP], self.rows[a : a + STEP], None
            if len(best) < k and least is None:
                score = q @ self.lines[:, a : a + STEP]
            else:
                floor = least if len(best) < k else best[k - 1] if least is None else max(least, best[k - 1])
                essential = int(np.count_nonzero(left[:-1] >= floor))
                if essential == 0:
                    break
                if essential * 2 < len(terms):  # else the union of the postings is nearly every row
                    use = terms[:essential]
                    rows = np.flatnonzero((self.lines[use, a : a + STEP] * np.sign(q[use])[:, None] > 0).any(0))
                score, at = None, 0
                while at < len(terms):
                    part = terms[at : at + PROBE]
                    more = q[part] @ (self.lines[part, a : a + STEP] if rows is None else self.lines[part[:, None], a + rows])
                    score, at = more if score is None else score + more, at + PROBE
                    keep = score + left[min(at, len(terms))] >= floor
                    n = np.count_nonzero(keep)
                    if n * 4 < len(keep):  # a few are probed one by one, many as whole lines
                        rows, score = np.flatnonzero(keep) if rows is None else rows[keep], score[keep]
                        if not n:
                            break
                keep = score >= floor
                rows, score = np.flatnonzero(keep) if rows is None else rows[keep], score[keep]
            ids, names = (ids, names) if rows is None else (ids[rows], names[rows])
            other = names != own
            if not other.all():
                ids, score = ids[other], score[other]
            if len(ids):
                best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, ids])
                if len(best) > 4 * k:
                    keep = best >= np.partition(best, -k)[-k]
                    best, best_ids = best[keep], best_ids[keep]
                order = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[order], best_ids[order]
        return best_ids, best


def _matrix(column: pa.Array, limit: int) -> np.ndarray:
    """Integers in floats where every score is exact in them, else as Python's integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat.astype(np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else object)


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _searched(vectors: DataFrame, block: Broadcast, k: int, limit: int, size: int) -> DataFrame:
    """What the queries of a block (rows, vectors, floors) find in rows (row, vec_id, v); a task takes its rows in shards of ``size`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found() -> pa.RecordBatch:
            shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows, ids, v, floors = block.value
            hits = [shard.search(r, q, k, least) for r, q, least in zip(rows, v, floors, strict=True)]
            n = [len(x) for x, _ in hits]
            cols = [np.repeat(rows, n), np.repeat(ids, n), np.concatenate([x for x, _ in hits]), np.concatenate([y for _, y in hits]).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if n + part.num_rows > size and held:
                    yield found()
                    held, n = [], 0
                held.append((part.column("row").to_numpy(), part.column("vec_id").to_numpy(), _matrix(part.column("v"), limit)))
                n += part.num_rows
        if held:
            yield found()

    return vectors.select("row", "vec_id", "v").mapInArrow(run, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shards: int, blocks: int, limit: int = 2**52) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows (row, vec_id, v: array<long>) of one length; queries are some of the rows.

    ``row`` is a number of its own of each row, ``limit`` a bound on the absolute score. ``blocks`` parts of the queries come to the driver and
    go to the tasks one after the other, and each reads the stored vectors once; no vector is shuffled. A query's own row is
    no candidate; rows that share its id, or repeat it, are. Each row with the id of a query is a query of its own.
    """
    spark = vectors.sparkSession
    homed = staged(vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).repartition(shards, "shard"), "homed")
    size = -(-homed.count() // shards) * 2  # a file has a shard or so
    asked = staged(queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int")), "asked")
    made = []
    for b in range(blocks):
        own = asked.where(F.col("block") == b).select("row", "vec_id", "v").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        rows, ids = own.column("row").to_numpy(), own.column("vec_id").to_numpy()
        v = _matrix(own.column("v").combine_chunks(), limit)
        block = spark.sparkContext.broadcast((rows, ids, v, [None] * len(rows)))
        first = staged(_searched(homed.where("shard = 0"), block, k, limit, size), "found")
        made.append(first)
        if shards > 1:
            known = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toArrow()
            floor = dict(zip(known.column("query_row").to_pylist(), known.column("least").to_pylist(), strict=True))
            again = spark.sparkContext.broadcast((rows, ids, v, [floor.get(r) for r in rows.tolist()]))
            made.append(staged(_searched(homed.where("shard > 0"), again, k, limit, size), "found"))
    if not made:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = SparkWindow.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, made).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by ``every``.

    Components become floor(scale * x). Rows with a null id, a null vector or a null or non-finite
    component take no part; vectors of other lengths than the longest are taken as if zeros
    followed. Rows that repeat, or share an id, are each a candidate, and each a query if their id makes them one.
    An empty table gives no rows. Other columns than the two named are not read.
    """
    x = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    x = x.where("vec_id is not null and v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    x = staged(x.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.expr(f"transform(v, c -> cast(floor({scale} * c) as long))").alias("v")), "vectors")
    asked = F.col("vec_id") % every == 0
    size = x.agg(F.count("*").alias("n"), F.count_if(asked).alias("q"), F.max(F.size("v")).alias("d"), F.max(F.expr("array_max(transform(v, c -> abs(c)))")).alias("m")).first()
    d = max(size.d or 0, 1)
    x = x.withColumn("v", F.expr(f"concat(v, array_repeat(0L, {d} - size(v)))"))
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-size.n * d // SHARD), min(cores, size.n // LEAST))
    return top_k(x, x.where(asked), k, shards, max(1, -(-size.q * d // BLOCK)), d * int(size.m or 0) ** 2)
