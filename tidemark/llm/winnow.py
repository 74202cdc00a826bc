"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of K consecutive words in every run of WINDOW - K + 1 such hashes.
Two texts that share WINDOW words in a row share a run, and so a kept fingerprint: the join of the
fingerprints misses no shared window. Each kept fingerprint carries the hashes of the windows around
it, by which a hit is extended and confirmed without going back to the texts.

An item of fewer than WINDOW words is one window of its own length, joined by its hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import as_list, map_texts, staged

#: Words of a window and of a fingerprint.
WINDOW, K = 10, 5
SPAN = WINDOW - K + 1
#: Bits of the filter that keeps fingerprints away from the join that no item can have: 512 KB, whatever the size of the benchmark.
FILTER_BITS = 22


def _kept(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept fingerprints among the words, with the hashes of K words from each position."""
    g = W.grams(hashes, K)
    n = len(g)
    size = np.diff(rows)
    full = np.flatnonzero(size >= WINDOW)
    if not len(full):
        return np.zeros(0, np.int64), g
    # the rightmost minimum of each run: hashes whose low bits give way to the place in the run
    run = n - SPAN + 1
    low = g[:run].copy()
    at = np.zeros(run, np.int8)
    for i in range(1, SPAN):
        less = g[i : i + run] <= low
        np.copyto(low, g[i : i + run], where=less)
        at[less] = i
    where, _ = W.gram_rows(rows, WINDOW)
    picked = np.zeros(n, bool)
    picked[where + at[where]] = True
    return np.flatnonzero(picked), g


def _around(hashes: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each position the hashes of the SPAN windows that hold its K words, first to last; 0 where a row ends."""
    row = np.searchsorted(rows, pos, "right") - 1
    out = np.zeros((len(pos), SPAN), np.uint64)
    for j in range(SPAN):
        start = pos - (SPAN - 1) + j
        ok = np.flatnonzero((start >= rows[row]) & (start + WINDOW <= rows[row + 1]))
        if len(ok):
            h = hashes[start[ok]].copy()
            for i in range(1, WINDOW):
                h *= W._GRAM
                h += hashes[start[ok] + i]
            h = W.mixed(h + np.uint64(WINDOW))
            out[ok, j] = np.where(h == 0, np.uint64(1), h)
    return out


def _prints(filter_bits: np.ndarray | None, lengths: tuple[int, ...] | None):
    """Work for map_texts: n_words and the kept fingerprints that pass the filter.

    A fingerprint is (kind, hash, pos, around): kind 0 is a winnowed one, kind m > 0 a window of m words.
    Those of ``lengths`` are taken from every position; None stands for items, which are such a window if short.
    """

    def passing(h: np.ndarray) -> np.ndarray:
        if filter_bits is None:
            return np.arange(len(h))
        bit = h >> np.uint64(64 - FILTER_BITS)
        return np.flatnonzero(filter_bits[(bit >> np.uint64(3)).astype(np.int64)] & (np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)))

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        hashes, _, _, rows = W.words(data, offsets, W.ALNUM)
        size = np.diff(rows)
        at, g = _kept(hashes, rows)
        at = at[passing(g[at])]
        parts = [(np.zeros(len(at), np.int32), g[at], at, _around(hashes, rows, at))]
        for m in range(1, WINDOW) if lengths is None else lengths:
            if lengths is not None:
                where, _ = W.gram_rows(rows, m)
            else:
                where = rows[:-1][size == m]
            g = W.grams(hashes, m)
            where = where[passing(g[where])] if len(where) else where
            parts.append((np.full(len(where), m, np.int32), g[where] if len(where) else np.zeros(0, np.uint64), where, np.zeros((len(where), SPAN), np.uint64)))
        kind, h, pos, around = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(pos, kind="stable")
        kind, h, pos, around = kind[order], h[order], pos[order], around[order]
        first = np.searchsorted(pos, rows)
        own = pos - np.repeat(rows[:-1], np.diff(first))
        flat = pa.StructArray.from_arrays(
            [pa.array(kind), pa.array(h.view(np.int64)), pa.array(own.astype(np.int64)), as_list(around.reshape(-1).view(np.int64), np.arange(len(pos) + 1) * SPAN)],
            names=["kind", "fp", "pos", "around"],
        )
        return {"n_words": pa.array(size.astype(np.int64)), "prints": as_list(flat, first)}

    return work


_PRINTS = "n_words long, prints array<struct<kind:int,fp:bigint,pos:bigint,around:array<bigint>>>"


def hit_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (row, doc_id, text) and (item_id, text): the rows with n_words, and the hits (row, first, size, item_id).

    A hit is an occurrence of an item's window in a row's text, ``size`` words from ``first`` on.
    """
    mine = map_texts(items, "text", ["item_id"], f"item_id string, {_PRINTS}", _prints(None, None))
    mine = staged(mine.select("item_id", F.explode("prints").alias("p")).select("item_id", "p.*"), "items")
    lengths = tuple(sorted(r.kind for r in mine.select("kind").where("kind > 0").distinct().collect()))
    shift = 64 - FILTER_BITS
    # at most 2 ** FILTER_BITS / 8 rows of one byte, whatever the number of items
    filled = mine.select(F.expr(f"shiftrightunsigned(fp, {shift})").alias("b")).groupBy(F.expr("b div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(b % 8 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in filled:
        bits[r.byte] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        return _prints(shared.value, lengths)(data, offsets)

    seen = staged(map_texts(docs, "text", ["row", "doc_id"], f"row long, doc_id long, {_PRINTS}", work), "prints")
    theirs = seen.select("row", F.explode("prints").alias("p")).select("row", "p.*")
    one = mine.where("kind = 0").select("item_id", "fp", F.posexplode("around").alias("j", "window")).where("window <> 0").select("fp", "j", "window", "item_id").distinct()
    two = theirs.where("kind = 0").select("row", "fp", "pos", F.posexplode("around").alias("j", "window")).where("window <> 0")
    long = two.join(one, ["fp", "j", "window"]).select("row", (F.col("pos") - (SPAN - 1) + F.col("j")).alias("first"), F.lit(WINDOW).alias("size"), "item_id")
    short = theirs.where("kind > 0").join(mine.where("kind > 0").select("kind", "fp", "item_id").distinct(), ["kind", "fp"]).select("row", F.col("pos").alias("first"), F.col("kind").alias("size"), "item_id")
    return seen.select("row", "doc_id", "n_words"), long.union(short).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and characters beyond ASCII, A-Z as a-z. n_hit counts the words
    inside any occurrence of an item's window, n_items the distinct item ids. Null and empty texts
    have no words and no hits; items without words are never found; items with a null id are hit
    but not counted; rows with the same doc_id stay apart. An empty benchmark hits nothing. A very long text is
    fingerprinted whole, by passes over its words; only what is hit of it goes on. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    seen, hits = hit_windows(rows, benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")))
    hits = staged(hits, "hits")
    w = SparkWindow.partitionBy("row").orderBy("first", "size")
    spans = hits.groupBy("row", "first").agg(F.max("size").alias("size"))
    spans = spans.withColumn("past", F.max(F.expr("first + size")).over(w.rowsBetween(SparkWindow.unboundedPreceding, -1)))
    covered = spans.groupBy("row").agg(F.sum(F.expr("greatest(0, first + size - greatest(first, coalesce(past, 0)))")).alias("n_hit"))
    named = hits.where("item_id is not null").select("row", "item_id").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("items"))
    out = seen.join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
