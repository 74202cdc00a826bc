"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full sets.

A table key is a pair of a key from collection A and one from collection B, so M + M small keys of
two hashes each give M * M tables of four hashes: 48 hashes for 144 tables instead of 576. At a
similarity of 0.75 two sets miss all tables with a chance of 1e-4, at 0.8 of 1e-5.

1. Texts with one and the same shingle set are one node; only nodes go on.
2. A key that one node alone has is dropped before keys are paired.
3. A table of up to CROWD nodes gives its pairs. Fuller tables, as a line that thousands of documents
   share fills them, are divided by rare shingles: of two sets that are similar enough, each has a
   shared shingle among its rarest quarter, so the division loses no link.
4. What a division holds is joined to two pivots first; components that are found are skipped from
   then on. What is left after ROUNDS is compared in blocks. Pairs that bounds on size, on position or
   on the difference of two bitmaps rule out are not formed; the bounds are exact.
5. A pair is linked if 100 * intersection >= 75 * union of its full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.shared import as_list, dropped, map_texts, staged

#: Words a shingle; keys in each collection; the share of the union that two sets must have in common, in hundredths.
SHINGLE, M, SHARE = 5, 12, 75
#: Nodes that a table may have to give all its pairs; nodes in one block; rounds of pivots; parts that a node's divisions are dealt to.
CROWD, BLOCK, ROUNDS, SALT = 4, 1000, 2, 8
#: Documents whose ids are broadcast at most (8 bytes each); beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_R = np.random.RandomState(11)
_MUL = _R.randint(1, 2**62, 4 * M, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _R.randint(0, 2**62, 4 * M, dtype=np.int64).astype(np.uint64) * np.uint64(3)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, and the rows' offsets."""
    hashes, _, _, rows = W.words(data, offsets, W.NOT_SPACE)
    n = len(offsets) - 1
    where, _ = W.gram_rows(rows, SHINGLE)
    count = np.diff(rows)
    grams = W.grams(hashes, SHINGLE)[where] if len(where) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), np.maximum(count - SHINGLE + 1, 0))
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    grams = np.concatenate([grams, W.whole_rows(hashes, rows, short)])
    of = np.concatenate([of, short])
    if len(short):
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    edge = np.searchsorted(of, np.arange(n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        grams[a:b].sort()
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(n + 1))


def _node(grams: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """16 bytes that stand for a row's whole set; null for an empty one."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            out[full, 0] = np.add.reduceat(W.mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), offsets[full])
            out[full, 1] = np.add.reduceat(W.mixed(grams + np.uint64(0x14057B7EF767814F)), offsets[full])
    empty = np.diff(offsets) == 0
    flat = pa.py_buffer(np.ascontiguousarray(out).tobytes())
    at = pa.py_buffer((np.arange(len(empty) + 1, dtype=np.int32) * 16).tobytes())
    valid = pa.array(~empty).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(empty), [valid, at, flat])


def _signed(data: np.ndarray, offsets: np.ndarray) -> dict:
    grams, rows = shingle_sets(data, offsets)
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(rows))
    keys = np.zeros((n, 2 * M), np.uint64)
    for i in range(2 * M) if len(full) else ():
        with np.errstate(over="ignore"):
            one, two = (np.minimum.reduceat((grams ^ _XOR[r]) * _MUL[r], rows[full]) for r in (2 * i, 2 * i + 1))
            keys[full, i] = W.mixed(one + W.mixed(two + np.uint64(i)))
    count = np.where(np.diff(rows) > 0, 2 * M, 0)
    flat = keys[np.diff(rows) > 0].reshape(-1).view(np.int64)
    return {"n": pa.array(np.diff(rows).astype(np.int64)), "node": _node(grams, rows), "keys": as_list(flat, np.concatenate([[0], np.cumsum(count)]))}


def bitmaps(grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Eight 64-bit words a row: each bit tells whether an odd number of shingles falls on it.

    Two sets differ by at least as many shingles as their bitmaps by bits.
    """
    n = len(rows) - 1
    out = np.zeros((n, 8), np.int64)
    for a in range(0, n, 4096):
        b = min(a + 4096, n)
        own = np.repeat(np.arange(b - a), np.diff(rows[a : b + 1]))
        bit = (W.mixed(grams[rows[a] : rows[b]] + np.uint64(99)) >> np.uint64(55)).astype(np.int64)
        odd = np.bincount(own * 512 + bit, minlength=(b - a) * 512) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, 512), axis=1).view(np.int64)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray) -> dict:
    grams, rows = shingle_sets(data, offsets)
    bits = bitmaps(grams, rows).reshape(-1)
    return {"node": _node(grams, rows), "shingles": as_list(grams.view(np.int64), rows), "bits": as_list(bits, np.arange(len(rows)) * 8)}


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            fa, fb = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
            na, nb = (np.concatenate([[0], np.cumsum(np.diff(np.asarray(x.offsets)))]) for x in (a, b))
            keep = []
            for i in range(batch.num_rows):
                x, y = fa[na[i] : na[i + 1]], fb[nb[i] : nb[i + 1]]
                both = np.concatenate([x, y])
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * n >= SHARE * (len(both) - n))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _ordered(c: str, d: str) -> list:
    return [F.least(c, d).alias("u"), F.greatest(c, d).alias("v")]


_SIZE = f"100 * least(n, m) >= {SHARE} * greatest(n, m)"
#: A pair that is similar enough has at least NEED shingles in common, and so at most n + m - 2 * NEED that are not.
_NEED = f"ceil({SHARE} * (n + m) / {100 + SHARE})"
_BITS = " + ".join(f"bit_count(bits[{i}] ^ bits2[{i}])" for i in range(8)) + f" <= n + m - 2 * {_NEED}"


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id that links reach, kept is doc_id = component_id. A null or empty
    text, or one of white space alone, has an empty set and stands alone. Rows with one id and other
    texts are other nodes; rows that repeat are one node. A null id never is a component's smallest
    one while another is there; among null ids alone, component_id is null and kept true. A very long text is read whole: its set is
    one row, and its rarest shingles are divisions that several tasks share. Other columns are not read, whatever their names. No rows give no rows.
    """
    base = staged(map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], "doc_id long, n long, node binary, keys array<bigint>", _signed), "signed")
    nodes = staged(base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")

    # keys that at least two nodes have, then their pairs A x B
    single = nodes.select("node", F.posexplode("keys").alias("pos", "key"))
    common = single.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    sides = single.join(common, "key", "left_semi").groupBy("node").agg(F.collect_list(F.expr(f"if(pos < {M}, key, null)")).alias("a"), F.collect_list(F.expr(f"if(pos >= {M}, key, null)")).alias("b"))
    tables = sides.select("node", F.explode("a").alias("x"), "b").select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    tables = staged(tables, "tables")
    # of tables with the same nodes one is enough
    filled = tables.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("c > 1").groupBy("c", "who").agg(F.min("key").alias("key"))
    members = staged(tables.join(filled.select("key", "c"), "key"), "members")
    dropped(tables)

    near = members.select("node").distinct().join(nodes.select("node", "first_id", "n"), "node")
    near = staged(near, "near")
    count = near.count()
    if count:
        ids = near.select(F.col("first_id").alias("doc_id")).distinct()
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        source = source.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, source.doc_id.eqNullSafe(ids.doc_id), "left_semi")
        sets = map_texts(source, "text", ["doc_id"], "doc_id long, node binary, shingles array<bigint>, bits array<bigint>", _sets)
        sets = sets.join(near.select("node", F.col("first_id").alias("f")), "node").where("doc_id <=> f").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
        sets = staged(sets, "sets")
        links = _links(members, sets)
        comps = components(links)
        label = comps.join(near.select("node", "first_id"), "node").groupBy("comp").agg(F.min("first_id").alias("least"))
        found = comps.join(label, "comp").select("node", "least")
        known = nodes.join(found, "node", "left").select("node", F.coalesce("least", "first_id").alias("least"))
    else:
        known = nodes.select("node", F.col("first_id").alias("least"))
    # written first, so that the join has shuffles of its own, whose large groups of copies Spark can split
    out = base.select("doc_id", "n", "node").join(staged(known, "known"), "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _dealt(rows: DataFrame, told: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Rows with what is ``told`` of what they are ``on``; those of one are shared by SALT tasks, dealt ``by`` some SQL."""
    each = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.expr(f"cast(pmod({by}, {SALT}) as int)")).join(each, [on, "salt"], how).drop("salt")


def _of_nodes(rows: DataFrame, told: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (node, pos, ...) with what is ``told`` of their nodes; a long text has thousands of divisions."""
    return _dealt(rows, told, "node", "pos", how)


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (u, v) that join all nodes which links join."""
    few = members.where(F.col("c") <= CROWD).join(sets.select("node", F.size("shingles").alias("n"), "bits"), "node").select("key", "node", "n", "bits")
    pairs = few.join(few.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("bits2")), "key").where(f"node < other and {_SIZE} and {_BITS}").select(*_ordered("node", "other")).distinct()
    links = staged(_linked(pairs, sets), "links")
    crowd = members.where(F.col("c") > CROWD).select("node").distinct()

    # shingles by rarity among the crowd; a set's rarest n - ceil(0.75 n) + 1 are its divisions
    item = crowd.join(sets, "node").select("node", F.explode("shingles").alias("s"), F.size("shingles").alias("n"))
    item = staged(item, "items")
    item = item.join(staged(item.groupBy("s").agg(F.count("*").alias("df")), "rarity"), "s")
    ranked = item.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("all"))
    prefix = ranked.select("node", "n", F.posexplode(F.slice("all", F.lit(1), F.expr("cast(n - ceil(0.75 * n) + 1 as int)"))).alias("pos", "e")).where("e.df > 1")
    parts = staged(_of_nodes(prefix.select(F.col("e.s").alias("key"), "node", "n", "pos"), sets.select("node", "bits").join(crowd, "node")).select("node", "key", "n", "pos", "bits"), "parts")
    if parts.isEmpty():
        return links

    # a set that meets many others in its divisions is likely the middle of a group
    size = _dealt(parts, parts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key", "xxhash64(node)").groupBy("node").agg(F.sum("c").alias("met"))
    left = staged(_of_nodes(parts, staged(size, "size")), "met")
    for turn in range(ROUNDS + 1):
        comps = components(links, 2 if turn < ROUNDS else None)
        now = _of_nodes(left, comps, "left").withColumn("comp", F.coalesce("comp", "node"))
        stat = now.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("met", "n", "pos", "node", "comp", "bits")).alias("p"), F.max(F.struct(F.xxhash64("node").alias("h"), "n", "pos", "node", "comp", "bits")).alias("q")).where("lo <> hi")
        # written first, so that the join has shuffles of its own, whose hot keys Spark can split
        now = staged(now.join(staged(stat.select("key", "c", "p", "q"), "stat"), "key"), "open")
        if now.isEmpty():
            return links
        fits = f"{_SIZE} and least(n - pos, m - at) >= {_NEED} and {_BITS}"
        if turn < ROUNDS:
            tried = [now.where(f"comp <> {x}.comp").select("node", "n", "pos", F.col(f"{x}.node").alias("other"), F.col(f"{x}.n").alias("m"), F.col(f"{x}.pos").alias("at"), "bits", F.col(f"{x}.bits").alias("bits2")) for x in "pq"]
            pairs = tried[0].union(tried[1]).where(f"{_SIZE} and {_BITS}")
            rest = now.where("node <> p.node and node <> q.node").select("key", "node", "n", "pos", "bits", "met")
        else:
            cut = now.withColumn("k", F.expr(f"cast(ceil(c / {BLOCK}) as int)")).withColumn("b", F.expr("cast(pmod(xxhash64(node), k) as int)"))
            one = cut.select("key", "node", "n", "pos", "comp", "bits", "b", F.explode(F.expr("sequence(b, k - 1)")).alias("b2"))
            two = cut.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("comp2"), F.col("bits").alias("bits2"), F.col("b").alias("b2"), F.explode(F.expr("sequence(0, b)")).alias("b"))
            pairs, rest = one.join(two, ["key", "b", "b2"]).where(f"comp <> comp2 and {fits}"), None
        more = staged(_linked(pairs.select(*_ordered("node", "other")).distinct(), sets), "links")
        links = links.union(more)
        if rest is None:
            return links
        left = staged(rest, "parts")
    return links
