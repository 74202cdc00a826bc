"""Connected components of a graph of links, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, staged


def _print(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows (node, comp) for the nodes of ``edges`` (u, v): comp is the smallest node that is reachable.

    After a given number of rounds comp is some node that is reachable, perhaps not the smallest one.

    Alternates large and small stars: every node hands its neighbours to its smallest one. The rounds
    grow with the logarithm of the longest path; each is a few shuffles of the edges, and the driver
    sees only their number and hash. A hub's edges are joined to one row, so Spark can split them. The result is a written table.
    No edges give no rows; loops and repeated edges do no harm; nulls are left out.
    """
    now = staged(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen, turn = None if rounds else _print(now), 0
    while rounds is None or turn < rounds:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        then = staged(small, "edges")
        dropped(now)
        now = then
        if rounds is None:
            got = _print(then)
            if got == seen:
                break
            seen = got
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    found = staged(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(hubs).groupBy("node").agg(F.min("comp").alias("comp")), "comps")
    dropped(now)
    return found
