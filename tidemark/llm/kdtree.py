"""Sharding by a K-d tree: split at weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, staged

#: Bins of a histogram, and how often the bin that holds a median is divided again: 2 ** 30 places of a dimension's range.
BINS, PASSES = 1024, 3
#: Levels after which the points are written with their leaf.
LEVELS = 4
#: Copies of a text that weigh more than this share of a leaf together are placed by their weight, before the tree divides the rest.
HEAVY = 1 / 32
#: Parts of a shard that a text which outweighs it is divided into.
SPLIT = 16


def leaves(points: DataFrame, dims: list[str], weight: str, depth: int, room: list[float] | None = None) -> DataFrame:
    """``points`` with a column ``leaf`` from 0 to 2 ** depth - 1 whose weights are near equal, or in proportion to ``room``.

    Level by level, all nodes at once: each takes the dimension whose spread, as a share of the spread
    at the root, is the widest, and is cut where the weight to the left comes closest to a half, or to the share of the leaves there. The
    median is found by histograms, whose next pass divides the bin that holds it. Nodes with their ranges and cuts are a
    written table, a row a node, which is joined to the points by broadcast, so neither the driver nor a plan grows with the leaves. Points that
    are equal in all dimensions stay in one leaf.
    """
    spark = points.sparkSession
    now = points.withColumn("leaf", F.lit(0))
    ends = now.agg(*[f(d).cast("double").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends[0] is None:
        return now
    spread = {d: max(ends[f"hi_{d}"] - ends[f"lo_{d}"], 1e-300) for d in dims}
    for level in range(depth):
        seen = now.groupBy("leaf").agg(*[f(d).cast("double").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
        share = F.array(*[(F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(spread[d]) for d in dims])
        seen = seen.withColumn("d", (F.array_position(share, F.array_max(share)) - 1).cast("int"))
        of = lambda n: F.get(F.array(*[F.col(f"{n}_{d}") for d in dims]), F.col("d")).alias(n)
        nodes = seen.select("leaf", "d", of("lo"), of("hi"), F.lit(0.5).alias("left"), F.lit(None).cast("double").alias("cut"))
        if room:
            wide = 2 ** (depth - level)
            lefts = [(i, sum(own[: wide // 2]) / max(sum(own), 1e-300)) for i in range(2**level) for own in [room[i * wide : (i + 1) * wide]]]
            nodes = nodes.drop("left").join(spark.createDataFrame(lefts, "leaf int, left double"), "leaf").select("leaf", "d", "lo", "hi", "left", "cut")
        nodes = staged(nodes, "nodes")
        for turn in range(PASSES):
            nodes = _narrowed(now, nodes, dims, weight, turn)
        right = F.get(F.array(*[F.col(d) for d in dims]), F.col("d")) >= F.col("cut")
        now = now.join(F.broadcast(nodes.select("leaf", "d", "cut")), "leaf").withColumn("leaf", F.col("leaf") * 2 + F.when(right, 1).otherwise(0)).drop("d", "cut")
        if (level + 1) % LEVELS == 0 and level + 1 < depth:
            now = staged(now, "leaves")  # else every pass would go through all levels before it
    return now


def _narrowed(points: DataFrame, nodes: DataFrame, dims: list[str], weight: str, turn: int) -> DataFrame:
    """Nodes with the bin of their range that holds the median as the new range, and the nearer side of it as the cut."""
    wide = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    cell = F.floor((F.get(F.array(*[F.col(d) for d in dims]), F.col("d")) - F.col("lo")) / wide * BINS).cast("long")
    binned = points.select("leaf", weight, *dims).join(F.broadcast(nodes), "leaf").select("leaf", weight, F.greatest(F.lit(-1), F.least(F.lit(BINS if turn else BINS - 1), cell)).alias("bin"))
    own = SparkWindow.partitionBy("leaf")
    sums = binned.groupBy("leaf", "bin").agg(F.sum(weight).cast("double").alias("w"))
    sums = sums.withColumn("upto", F.sum("w").over(own.orderBy("bin").rowsBetween(SparkWindow.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(own))
    sums = sums.join(F.broadcast(nodes.select("leaf", "left")), "leaf").withColumn("half", F.col("all") * F.col("left"))
    found = sums.groupBy("leaf").agg(
        F.min(F.when(F.col("upto") >= F.col("half"), F.struct("bin", (F.col("upto") - F.col("w")).alias("run"), "w"))).alias("m"), F.max("half").alias("half"),
        F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col("w"))), F.lit(0.0)).alias("first"), F.coalesce(F.sum(F.when(F.col("bin") == BINS - 1, F.col("w"))), F.lit(0.0)).alias("last"),
    )
    b = F.least(F.greatest(F.col("m.bin"), F.lit(0)), F.lit(BINS - 1))
    w = F.when(F.col("m.bin") < 0, F.col("first")).when(F.col("m.bin") >= BINS, F.col("last")).otherwise(F.col("m.w"))
    # the cut goes to the nearer side of the bin
    found = found.select("leaf", b.alias("b"), F.when(F.col("half") - F.col("m.run") > F.col("m.run") + w - F.col("half"), 1).otherwise(0).alias("side"))
    step = (F.col("hi") - F.col("lo")) / BINS
    at = lambda n: F.col("lo") + step * n
    return staged(nodes.join(found, "leaf").select("leaf", "d", at(F.col("b")).alias("lo"), at(F.col("b") + 1).alias("hi"), "left", at(F.col("b") + F.col("side")).alias("cut")), "nodes")


def packed(weights: dict[int, dict[int, float]], count: int, most: float) -> tuple[dict, list[float]]:
    """The leaf of each part of each text, and what is then left of ``most`` in each leaf.

    The heaviest text comes first and begins in the emptiest leaf; its parts stay there while they fit.
    """
    used, home = [0.0] * count, {}
    for h in sorted(weights, key=lambda h: (-sum(weights[h].values()), h)):
        leaf = None
        for part, w in sorted(weights[h].items()):
            if leaf is None or used[leaf] + w > most:
                leaf = min(range(count), key=lambda i: (used[i], i))
            home[h, part] = leaf
            used[leaf] += w
    return home, [max(most - u, 0.0) for u in used]


def shards(docs: DataFrame, count: int = 16, target_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id", rows_a_cell: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Other columns are not read, and a very long text is measured where it is read and goes no further.
    The law is ``bytes``: shards of near equal UTF-8 bytes, a row's being those of its text plus 1 (a null
    text: 1). There are ``count`` of them, a power of 2, or as many as bring each to ``target_bytes``.

    The dimensions come from the text alone: the logarithm of its length, its bytes a character and its characters a
    space, each told apart by the hash of the text within a thousandth. So equal texts share a shard. Those that weigh more than
    HEAVY of a shard together (count / HEAVY texts at most) are placed first, whole, and leave less room for the tree's leaf; only
    what outweighs a whole shard is parted, by row, into as few shards as hold it. Slots run from 0 without
    gaps in each shard; a null id is an id like others. Fewer texts than shards leave shards empty. No
    rows give no rows; grown_shard is null under this law.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(body)
    spaces = chars - F.length(F.replace(body, F.lit(" "), F.lit("")))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row"),
        F.log2(chars + 1.5).alias("long"), F.log2((F.octet_length(body) + 1) / (chars + 1)).alias("wide"), F.log2((chars + 1) / (spaces + 1)).alias("dense"),
    )
    rows = staged(rows, "points")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        count = 1 << max(0, (-(-total // target_bytes) - 1).bit_length())
    leaf = total / count
    # at most count / HEAVY texts weigh that much
    heavy = rows.groupBy("h").agg(F.sum("size").alias("all")).where(F.col("all") > HEAVY * leaf).collect()
    parts = {r.h: 1 if r["all"] <= leaf else SPLIT * -(-r["all"] // int(leaf + 1)) for r in heavy}
    room = [leaf] * count
    placed, light = None, rows
    if parts:
        told = docs.sparkSession.createDataFrame([(h, n) for h, n in parts.items()], "h long, parts int")
        known = rows.join(F.broadcast(told), "h", "left").withColumn("part", F.expr("pmod(xxhash64(row), parts)"))
        light = known.where("parts is null").drop("parts", "part")
        known = known.where("parts is not null")
        weights: dict[int, dict[int, float]] = {}
        for r in known.groupBy("h", "part").agg(F.sum("size").alias("w")).collect():
            weights.setdefault(r.h, {})[r.part] = float(r.w)
        home, room = packed(weights, count, leaf)
        homes = docs.sparkSession.createDataFrame([(h, p, s) for (h, p), s in home.items()], "h long, part long, shard int")
        placed = known.join(F.broadcast(homes), ["h", "part"])
    dims = ["long", "wide", "dense"]
    spot = (F.xxhash64("h", F.lit(1)) / 2.0**64 + 0.5) / 1000
    points = light.select("doc_id", "size", "text_crc32", "h", *[(F.col(d) + spot).alias(d) for d in dims])
    own = ["doc_id", "size", "text_crc32", "h", "shard"]
    found = leaves(points, dims, "size", count.bit_length() - 1, room).withColumn("shard", F.col("leaf").cast("int")).select(own)
    placed = staged(found.union(placed.select(own)) if parts else found, "placed")
    cells = max(1, -(-placed.count() // (rows_a_cell * count)))
    placed_cells = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)))
    before = placed_cells.groupBy("shard", "cell").agg(F.count("*").alias("c")).withColumn("start", F.sum("c").over(SparkWindow.partitionBy("shard").orderBy("cell")) - F.col("c"))
    slot = F.row_number().over(SparkWindow.partitionBy("shard", "cell").orderBy("doc_id", "h")) - 1
    out = placed_cells.withColumn("slot", slot).join(before, ["shard", "cell"])
    dropped(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
