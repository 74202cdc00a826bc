"""A Merkle manifest of a table, with a proof for every row by fractal traversal.

Rows become leaves, a tree a group, and the trees' roots leaves of one last tree. Every ARITY nodes in a row are
a run that becomes one node. Leaves get their place by a sort by ranges and are gathered in aligned blocks of
ARITY ** LEVELS; the roots of blocks are leaves of the next layer, until a tree is one block.

Within a block the proofs come one after the other (fractal traversal): for each stack of HEIGHT levels the
existing subtree, which holds the runs around the current leaf, and the desired one, which takes one leaf more with each
proof and is whole when the traversal enters it. What is kept is two subtrees a stack, whatever the block's
length. The proof of the block itself was made in the layer above, by the same means, and is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from tidemark.llm.shared import handed_back, small_batches, staged

#: Nodes of a run; levels of a block, whose row has about 200 bytes for each of its ARITY ** LEVELS leaves; levels of a subtree.
ARITY, LEVELS, HEIGHT = 8, 4, 1


def node(digests: list[str]) -> str:
    """sha256 of digests as hex text, one after the other."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(total: int, most: int) -> int:
    """Levels that a block of a tree of ``total`` leaves has."""
    n = 0
    while n < most and ARITY**n < total:
        n += 1
    return n


class Subtree:
    """Nodes of ``height`` levels from ``base`` on, over an aligned range that is fed leaf by leaf."""

    def __init__(self, base: int, height: int):
        self.base, self.rows, self.waiting = base, [[] for _ in range(height)], [[] for _ in range(base + height)]

    def add(self, digest: str, level: int = 0) -> None:
        if level >= self.base:
            self.rows[level - self.base].append(digest)
        self.waiting[level].append(digest)
        if len(self.waiting[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        if level + 1 < len(self.waiting):
            run, self.waiting[level] = self.waiting[level], []
            self.add(node(run), level + 1)

    def end(self) -> None:
        """Runs that stay short become nodes too."""
        for level, run in enumerate(self.waiting):
            if run:
                self._close(level)


def proofs(leaves: list[str], levels: int, height: int = HEIGHT) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf of a block, from the lowest level on: its place in its run and the run's other nodes."""
    stacks = range(-(-levels // height))
    sizes = [ARITY ** (height * (i + 1)) for i in stacks]

    def fed(i: int, some: list[str]) -> Subtree:
        tree = Subtree(height * i, height)
        for leaf in some:
            tree.add(leaf)
        return tree

    existing = [fed(i, leaves[: sizes[i]]) for i in stacks]
    desired, taken = [fed(i, []) for i in stacks], [min(sizes[i], len(leaves)) for i in stacks]
    for i in stacks:
        if sizes[i] >= len(leaves):
            existing[i].end()
    for place in range(len(leaves)):
        for i in stacks:
            if place and place % sizes[i] == 0:
                existing[i], desired[i] = desired[i], fed(i, [])
        path = []
        for level in range(levels):
            i = level // height
            own, size = place // ARITY**level, sizes[i] // ARITY**level
            first = own // ARITY * ARITY - own // size * size
            run = existing[i].rows[level - height * i][first : first + ARITY]
            path.append((own % ARITY, run[: own % ARITY] + run[own % ARITY + 1 :]))
        yield path
        for i in stacks:
            if taken[i] < len(leaves):
                desired[i].add(leaves[taken[i]])
                taken[i] += 1
                if taken[i] == len(leaves):
                    desired[i].end()


def folded(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof give."""
    for at, others in path:
        digest = node([*others[:at], digest, *others[at:]])
    return digest


def leaf_of(columns: list[Column]) -> Column:
    """sha256 of the columns, each '-' if null, else its bytes' number, ':' and its value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said).cast("binary"), 256)


_NODE = "struct<pos:long,leaf:string,other:string,name:string>"
_PATH = "array<struct<at:int,others:array<string>>>"
_UPPER = f"tree string, block long, path {_PATH}, subroot string, root string"


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (tree, *order, leaf, other, name) with their place ``pos`` within the tree and the tree's ``total``.

    Ranges are sorted and written once; a range's rows of one tree lie together, so their places follow from the first one and from how
    many the ranges before have.
    """
    order = [c for c in rows.columns if c not in ("leaf", "other", "name")]
    lined = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lined = staged(lined.select("tree", "leaf", "other", "name", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "lined")
    by = SparkWindow.partitionBy("tree")
    parts = lined.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    parts = parts.select("tree", "part", "first", F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(SparkWindow.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by).alias("total"))
    return lined.join(parts, ["tree", "part"]).select("tree", "total", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "leaf", "other", "name")


def _blocks(placed: DataFrame, levels: int) -> DataFrame:
    """One row a block, of at most ARITY ** levels nodes in order."""
    nodes = F.array_sort(F.collect_list(F.struct("pos", "leaf", "other", "name"))).cast(f"array<{_NODE}>")
    return staged(placed.groupBy("tree", F.expr(f"pos div {ARITY**levels}").alias("block")).agg(F.max("total").alias("total"), nodes.alias("nodes")), "blocks")


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, block, total, root) of each block."""
    names, kinds = ["tree", "block", "total", "root"], [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                level = [x["leaf"] for x in row["nodes"]]
                for _ in range(levels_of(row["total"], levels)):
                    level = [node(level[a : a + ARITY]) for a in range(0, len(level), ARITY)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row["tree"], row["block"], row["total"], level[0]), kinds, strict=True)], names=names)

    return staged(blocks.mapInArrow(run, "tree string, block long, total long, root string"), "tops")


def _climbed(blocks: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all layers from the leaves on, and (tree, root)."""
    layers, span = [blocks], ARITY**levels
    while True:
        tops = _roots(layers[-1], levels)
        if tops.where(F.col("total") > span).isEmpty():
            return layers, tops.select("tree", "root")
        above = tops.select("tree", F.ceil(F.col("total") / span).alias("total"), F.col("block").alias("pos"), F.col("root").alias("leaf"), F.col("root").alias("other"), F.lit(None).cast("string").alias("name"))
        layers.append(_blocks(above, levels))


def _walked(blocks: DataFrame, upper: DataFrame, levels: int, schema: str, make: Callable) -> DataFrame:
    """``make`` of each node of each block, with its whole path: that of the block is appended to its own."""
    names = [c.partition(" ")[0] for c in schema.split(", ")]
    kinds = [_ARROW.get(c, pa.string()) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                above = [(s["at"], s["others"]) for s in row["path"]]
                paths = proofs([x["leaf"] for x in row["nodes"]], levels_of(row["total"], levels))
                made = [make(row, x, path + above) for x, path in zip(row["nodes"], paths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
        handed_back()

    return blocks.join(upper, ["tree", "block"]).mapInArrow(run, schema)


_ARROW = {"block": pa.int64(), "path": pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])), "doc_id": pa.int64(), "verified": pa.bool_()}


def _steps(path: list[tuple[int, list[str]]]) -> list[dict]:
    return [{"at": at, "others": others} for at, others in path]


def _of_block(row: dict, x: dict, path: list) -> tuple:
    return row["tree"], x["pos"], _steps(path), row["subroot"], row["root"]


def _of_tree(row: dict, x: dict, path: list) -> tuple:
    return x["name"], 0, _steps(path), x["leaf"], row["root"]


def _of_leaf(row: dict, x: dict, path: list) -> tuple:
    proof = node([d for _, others in path for d in others])
    again = folded(x["other"], path)
    return x["name"] and int(x["name"]), x["leaf"], row["subroot"], row["root"], proof, again, again == row["root"]


def authenticated(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (tree, doc_id, row, leaf, other).

    ``tree`` is never null; trees go by its bytes. ``row`` is a number of its own of each row, which only parts rows that are otherwise alike;
    ``levels`` is the height of a block.
    """
    small_batches(leaves.sparkSession)
    placed = _placed(leaves.select("tree", "doc_id", F.col("leaf").alias("digest"), "row", "leaf", "other", F.col("doc_id").cast("string").alias("name")))
    layers, subroots = _climbed(_blocks(placed, levels), levels)
    nodes = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("root").alias("leaf"), F.col("root").alias("other"), F.col("tree").alias("name"))
    last, root = _climbed(_blocks(_placed(nodes), levels), levels)
    upper = root.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), "root")
    for blocks, make in [*[(b, _of_block) for b in last[:0:-1]], (last[0], _of_tree), *[(b, _of_block) for b in layers[:0:-1]]]:
        upper = _walked(blocks, upper, levels, _UPPER, make)
    return _walked(layers[0], upper, levels, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", _of_leaf)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and proof of each row of documents, and whether the row, perhaps tampered with, still folds to the root.

    Trees are languages, a null one first. Tampered with are rows where 3 divides the crc32 of the id: the text's A-Z are lower-cased there; a null
    id is never tampered with. Rows that share an id are ordered by their leaf; rows that repeat are leaves of their own. Null ids come first. Null
    and empty texts differ. A very long text is hashed where it is read and goes no further. An empty table gives no rows;
    other columns than doc_id, source, lang, n_chars and text are not read.
    """
    own = lambda text: leaf_of([F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), own(F.col("text")).alias("leaf"),
        F.when(third & F.col("text").isNotNull(), own(F.translate("text", ascii_uppercase, ascii_lowercase))).alias("other"),
    )
    return authenticated(staged(rows.withColumn("other", F.coalesce("other", "leaf")), "leaves"), levels)
