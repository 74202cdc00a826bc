"""Simple-8b: token ids in 64-bit words, and corpora of them in files of blocks.

The upper 4 bits of a word are a selector, which tells how many values of how many bits the other 60
hold. A value of more than 60 bits is an escape: selector 15 and the value in the word that follows.
Every BLOCK values begin a word of their own, whose place is kept, so that blocks decode alone
and all at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from tidemark.llm.shared import PASS_BYTES, as_list, buffers, handed_back, new_path, passes, small_batches
from tidemark.llm.wordbpe import words

#: Bits and number of values of each selector, most values first.
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNT = 60 // BITS
ESCAPE = 15
#: Values of a block; ids that a row of the files holds at least, unless a partition ends.
BLOCK, GROUP = 1024, 1 << 18


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the word at which each block begins (one more entry than blocks)."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # from each place on the selector of the most values that are narrow enough; where one does not fit,
    # no selector of fewer bits does, as it takes more values
    choice = np.full(n, ESCAPE, np.int8)
    most, where = int(v.max()), None
    narrow = v.astype(np.uint32) if most < 1 << 32 else v
    for s in range(len(BITS) - 1, -1, -1):
        if most >> int(BITS[s]) == 0:
            choice[:] = s
            continue
        c = int(COUNT[s])
        over = np.zeros(n + c + 1, np.int32)
        np.cumsum(narrow >= narrow.dtype.type(1 << int(BITS[s])), dtype=np.int32, out=over[1 : n + 1])
        over[n + 1 :] = over[n]
        if where is None:
            fits = over[c : c + n] == over[:n]
            np.putmask(choice, fits, s)
            if 4 * np.count_nonzero(fits) < n:
                where = np.flatnonzero(fits)
        else:
            where = where[over[where + c] == over[where]]
            choice[where] = s
        if where is not None and not len(where):
            break
    # all blocks step from word to word together
    count = np.append(COUNT, [0, 1])  # by selector
    heads, at = [], np.arange(blocks) * BLOCK
    stops = np.minimum(at + BLOCK, n)
    while len(at):
        heads.append(at)
        at = at + count[choice[at]]
        on = at < stops
        at, stops = at[on], stops[on]
    head = np.sort(np.concatenate(heads))
    take = np.minimum(count[choice[head]], np.minimum((head // BLOCK + 1) * BLOCK, n) - head)
    which, size = choice[head], take
    wide = 1 + (which == ESCAPE)
    place = np.concatenate([[0], np.cumsum(wide)])
    out = np.zeros(place[-1], np.uint64)
    out[place[:-1]] = which.astype(np.uint64) << np.uint64(60)
    for s in range(len(BITS)):
        own = np.flatnonzero(which == s)
        for j in range(COUNT[s]) if len(own) else ():
            use = own[size[own] > j]
            if not len(use):
                break
            out[place[use]] |= v[head[use] + j] << np.uint64(j * BITS[s])
    far = np.flatnonzero(which == ESCAPE)
    out[place[far] + 1] = v[head[far]]
    return out, place[np.append(np.searchsorted(head, np.arange(blocks) * BLOCK), len(head))]


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks; ``starts`` as encode() gives them."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    which = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (which == ESCAPE).any():  # the word after an escape is a value, whatever its upper bits
        skip = False
        for i in range(len(words)):
            raw[i], skip = skip, not skip and which[i] == ESCAPE
    table = np.zeros(16, np.int64)
    table[: len(COUNT)] = COUNT
    table[ESCAPE] = 1
    size = np.where(raw, 0, table[which])
    # within a block every word but the last is full
    run = np.concatenate([[0], np.cumsum(size)])
    block = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    first = block * BLOCK + run[:-1] - run[starts[block]]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in range(len(BITS)):
        own = np.flatnonzero((which == s) & ~raw)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNT[s]) if len(own) else ():
            use = own[first[own] + j < stop[own]]
            out[first[use] + j] = (words[use] >> np.uint64(j * BITS[s])) & mask
    far = np.flatnonzero((which == ESCAPE) & ~raw)
    out[first[far]] = words[far + 1]
    return out


FILES = "part int, seq long, before long, doc_ids array<bigint>, counts array<bigint>, starts array<bigint>, payload binary"


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> None:
    """Write the ids of all texts, in ascending order of doc_id, to a folder of Parquet files of Simple-8b blocks.

    Rows are (part, seq): part numbers rise with doc_id, seq with the place in the part; ``before`` is
    the number of ids before the row in its part. Each row holds whole documents with
    their ids and counts, the words of their blocks and where the blocks begin. A null text is
    an empty one; each document ends with ``end_id``. Null ids come first; rows with the same id
    follow each other by the hash of their texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq, before = words(tokenizer, end_id), TaskContext.get().partitionId(), 0, 0
        docs: list[pa.Array] = []
        made: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def group() -> pa.RecordBatch:
            packed, starts = encode(np.concatenate(made))
            keys, count = pa.concat_arrays(docs), np.concatenate(counts)
            one = np.array([0, len(keys)])
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), as_list(keys, one), as_list(count, one), as_list(starts, np.array([0, len(starts)])), pa.array([packed.astype("<u8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "before", "doc_ids", "counts", "starts", "payload"])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in passes(offsets, 2 * PASS_BYTES + 1):  # pieces are looked up once a pass
                ids, edge = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                docs.append(batch.column("doc_id").slice(a, b - a))
                made.append(ids)
                counts.append(np.diff(edge))
                size += len(ids)
                if size >= GROUP:
                    yield group()
                    seq, before = seq + 1, before + size
                    docs, made, counts, size = [], [], [], 0
        if docs:
            yield group()
        own.known.clear()
        handed_back()

    rows.mapInArrow(run, FILES).write.option("compression", "none").parquet(out)


def read_tokens(files: DataFrame) -> DataFrame:
    """From what write_tokens() wrote: doc_id, start (ids before it in all files), n_tokens, ids_crc32 for each document."""
    parts = files.groupBy("part").agg(F.sum(F.expr("aggregate(counts, 0L, (a, b) -> a + b)")).alias("n"))
    base = parts.select("part", (F.sum("n").over(SparkWindow.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                at = np.concatenate([[0], np.cumsum(counts)])
                ids = decode(np.frombuffer(r["payload"], "<u8"), np.array(r["starts"]), int(at[-1])).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["before"] + r["base"]), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for a part: a few thousand at most, as partitions are
    return files.join(F.broadcast(base), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of ``docs``: its ids are written to the shared folder and read back from the files.

    A null or empty text has the end id alone; a null doc_id comes first; rows with one id follow each other by the hash
    of their texts, and repeated rows are each written. Whole texts are encoded. No rows give no rows; other
    columns are not looked at. The files stay for who asked for them.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark.read.schema(FILES).parquet(path))
