"""Streams that keep derived tables in step with the event log.

Late rows are never dropped: each micro-batch finds the keys it touches, derives them anew from the whole log and
replaces them, so a stream, a replay and a batch run end in the same table, and a batch that is run twice changes nothing.
Rows, dead letters and the batch's number are one commit (``sources/commits.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import commits

#: A run over what is there, after which the stream ends.
ONCE = {"availableNow": True}


def scan_floor(watermark: datetime | None, lookback: int = 600) -> datetime:
    """From where to scan: some seconds before the watermark, everything if there is none."""
    return datetime(1970, 1, 1) if watermark is None else watermark - timedelta(seconds=lookback)


def advanced(frontier: datetime | None, unresolved: datetime | None) -> datetime | None:
    """How far the watermark may go: to the frontier, but not past the oldest that is unresolved."""
    if frontier is None or unresolved is None:
        return frontier
    return min(frontier, unresolved)


def frontier(events: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: the largest finality time, the oldest of what is unresolved, and the watermark between them."""
    a = events.agg(F.max("finalized_at").alias("frontier"))
    b = unresolved.agg(F.min("finalized_at").alias("oldest"))
    return a.crossJoin(b).withColumn("watermark", F.least("frontier", "oldest"))


def in_batches(stream: DataFrame, target: str, checkpoint: str, work: Callable[[DataFrame, dict, Callable[[DataFrame], DataFrame]], dict[str, commits.Change] | None], trigger: dict | None = None) -> StreamingQuery:
    """Run ``work(batch, manifest, kept)`` for each micro-batch and commit the changes that it returns together with the batch's number.

    What several changes are made from goes through ``kept``: it is computed once, and given up after the commit. A batch that was committed but not yet noted in the stream's checkpoint is passed over when it comes again, so each is applied once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        was = commits.manifest(spark, target)
        done = was["state"].get("batches", {})
        if done.get(checkpoint, -1) >= number:
            return
        held: list[DataFrame] = []

        def kept(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        try:
            changes = work(batch, was, kept) or {}
            commits.commit(spark, target, changes, was["state"] | {"batches": done | {checkpoint: number}})
        finally:
            for df in held:
                df.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def of_keys(log: DataFrame, key: str, keys: list[str | None]) -> DataFrame:
    """Rows of some values of ``key``, given as text; a condition that prunes a log partitioned by it."""
    kind = log.schema[key].dataType
    some = F.col(key).isin([F.lit(k).cast(kind) for k in keys if k is not None])
    return log.where(some | F.col(key).isNull() if None in keys else some)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], touched: Callable[[DataFrame], DataFrame], key: str, files_a_batch: int = 8, trigger: dict | None = None) -> StreamingQuery:
    """Keep the table ``rows`` of ``target`` equal to ``build(all rows)``, partition by partition of ``key``.

    ``touched`` gives the keys of a batch; ``build`` is run over the log's rows with those keys, whose values are a condition that
    prunes a log partitioned by them. A key that has no rows left is deleted from the table. The files of a
    batch are in the log when the batch runs, so the log itself is the state. Keys are days or the like: a batch's come to the driver.
    """

    def work(batch: DataFrame, _: dict, kept: Callable[[DataFrame], DataFrame]) -> dict[str, commits.Change] | None:
        keys = [r[0] for r in touched(batch).select(F.col(key).cast("string")).distinct().collect()]
        if not keys:
            return None
        log = touched(spark.read.schema(schema).parquet(source))
        return {"rows": commits.Change(build(of_keys(log, key, keys)), key, keys)}

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return in_batches(stream, target, checkpoint, work, trigger)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, decode: Callable[[DataFrame], DataFrame], keys: list[str], by: str, files_a_batch: int = 8, trigger: dict | None = None) -> StreamingQuery:
    """Logs in chunks into the tables ``rows`` and ``dead`` of ``target``, with the last block of each contract as a checkpoint, in one commit.

    ``decode`` gives the chunk's rows with ``error`` (null where all is well) and ``critical``; a critical row with an error halts the stream, and
    nothing of its chunk is kept. Rows and dead letters whose ``keys`` are there already are left out: the tables are asked only for the chunk's partitions of ``by``.
    """

    def fresh(rows: DataFrame, name: str, was: dict) -> DataFrame:
        once = rows.dropDuplicates(keys)
        if name not in was["tables"]:
            return once
        parts = [r[0] for r in rows.select(F.col(by).cast("string")).distinct().collect()]
        old = of_keys(commits.read(spark, target, name, was), by, parts).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return once.join(old, same, "left_anti")

    def work(batch: DataFrame, was: dict, kept: Callable[[DataFrame], DataFrame]) -> dict[str, commits.Change]:
        chunk = kept(decode(batch))
        bad = chunk.where("critical and error is not null").limit(5).collect()
        if bad:
            raise ValueError("critical events cannot be decoded: " + "; ".join(f"{[r[k] for k in keys]}: {r.error}" for r in bad))
        good, dead = chunk.where("error is null").drop("error", "critical"), chunk.where("error is not null").drop("critical")
        last = F.max("block_number").alias("block_number")
        seen = chunk.groupBy("contract").agg(last)
        if "checkpoints" in was["tables"]:
            seen = seen.union(commits.read(spark, target, "checkpoints", was)).groupBy("contract").agg(last)
        return {n: commits.Change(fresh(rows, n, was), by, append=True) for n, rows in (("rows", good), ("dead", dead))} | {"checkpoints": commits.Change(seen.coalesce(1))}

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return in_batches(stream, target, checkpoint, work, trigger)


class Loops:
    """Several streams that go on in one session, each from a checkpoint of its own.

    ``jobs`` start a stream with the trigger that they are given. A stream that fails is started again from its checkpoint when
    ``tend`` is called, at most ``tries`` times in a row without progress; ``stop`` lets each finish what is there, in the order in which they were started.
    """

    def __init__(self, jobs: dict[str, Callable[[dict], StreamingQuery]], every: str = "10 seconds", tries: int = 5):
        self.jobs, self.trigger, self.tries = jobs, {"processingTime": every}, tries
        self.failed: dict[str, list[str]] = {name: [] for name in jobs}
        self.running = {name: start(self.trigger) for name, start in jobs.items()}

    def tend(self) -> dict[str, bool]:
        """Whether each stream runs, after those that failed have been started again."""
        for name, query in self.running.items():
            if query.lastProgress is not None and query.isActive:
                self.failed[name] = []
            if not query.isActive and len(self.failed[name]) < self.tries:
                self.failed[name].append(str(query.exception()))
                self.running[name] = self.jobs[name](self.trigger)
        return {name: query.isActive for name, query in self.running.items()}

    def stop(self) -> None:
        for query in self.running.values():
            if query.isActive:
                query.processAllAvailable()
                query.stop()


def first_seen(spark: SparkSession, source: str, schema: str, keys: list[str], by: str, target: str, checkpoint: str, files_a_batch: int = 8, trigger: dict | None = None) -> StreamingQuery:
    """Each combination of ``keys`` and ``by``, a day or the like, once, in the table ``rows`` of ``target``.

    What was seen is the table itself, of which a batch reads its own partitions alone, so the stream keeps no state however many keys there
    are and however late they come.
    """

    def work(batch: DataFrame, was: dict, kept: Callable[[DataFrame], DataFrame]) -> dict[str, commits.Change]:
        fresh = kept(batch.select(*keys, by).distinct())
        if "rows" in was["tables"]:
            parts = [r[0] for r in fresh.select(F.col(by).cast("string")).distinct().collect()]
            old = of_keys(commits.read(spark, target, "rows", was), by, parts).select(*[F.col(k).alias(f"_{k}") for k in (*keys, by)])
            fresh = fresh.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, by)], "left_anti")
        return {"rows": commits.Change(fresh, by, append=True)}

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return in_batches(stream, target, checkpoint, work, trigger)
