"""Where tables are written and how: shared folders, partitions replaced, reports, seeds, file hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import commits


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only where the session names none and Spark runs in one process. The session's settings stay as they are."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = _own_folder()
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def block_days(spark: SparkSession, root: str) -> DataFrame:
    """The index of a stored log: (day_utc, first_block, last_block, first_at, last_at), a row a day and commit."""
    return commits.read(spark, root, "blocks")


def days_of_blocks(spark: SparkSession, root: str, first: int | None, last: int | None) -> list[date]:
    """Days that may have blocks of a range; a row a day comes to the driver."""
    index = block_days(spark, root)
    index = index if first is None else index.where(F.col("last_block") >= first)
    index = index if last is None else index.where(F.col("first_block") <= last)
    return sorted(r.day_utc for r in index.select("day_utc").distinct().collect())


def scan_logs(spark: SparkSession, root: str, contract: str | None = None, topics: Sequence[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Logs of a contract, of some kinds, in a range of blocks: the index turns blocks into days, which choose partitions, and every condition reaches the scan."""
    logs = commits.read(spark, root, "rows")
    if first is not None or last is not None:
        logs = logs.where(F.col("day_utc").isin(days_of_blocks(spark, root, first, last)))
    for condition in (contract and F.col("contract_name") == contract, topics and F.col("event_name").isin(list(topics)), first is not None and F.col("block_number") >= first, last is not None and F.col("block_number") <= last):
        logs = logs if condition is None or condition is False else logs.where(condition)
    return logs


def block_window(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """One row: when the first block from ``first`` on and the last one up to ``last`` were.

    Days that lie wholly on the right side of a block answer from the index; only those that a block parts are read.
    """
    index = block_days(spark, root)
    inside = index.agg(F.min(F.when(F.col("first_block") >= first, F.col("first_at"))).alias("a"), F.max(F.when(F.col("last_block") <= last, F.col("last_at"))).alias("z"))
    parted = index.where(f"(first_block < {first} and last_block >= {first}) or (first_block <= {last} and last_block > {last})").select("day_utc").distinct()
    logs = commits.read(spark, root, "rows").where(F.col("day_utc").isin([r.day_utc for r in parted.collect()]))
    edge = logs.agg(F.min(F.when(F.col("block_number") >= first, F.col("block_timestamp"))).alias("b"), F.max(F.when(F.col("block_number") <= last, F.col("block_timestamp"))).alias("y"))
    return inside.crossJoin(edge).select(F.least("a", "b").alias("first_at"), F.greatest("z", "y").alias("last_at"))  # one row each


def with_block_times(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    return logs.join(blocks.select("block_number", "block_timestamp"), "block_number", "left")


def write_events(events: DataFrame, root: str) -> None:
    """Add to the stored log, by UTC day, and to its index of blocks by day, which is read from the new files alone."""
    spark = events.sparkSession
    rows = events.withColumn("day_utc", F.to_date("block_timestamp"))
    before = commits.manifest(spark, root)
    now = commits.commit(spark, root, {"rows": commits.Change(rows, "day_utc", append=True)})
    had = {f for own in before["tables"].get("rows", {"parts": {}})["parts"].values() for f in own}
    parts = {k: [f for f in own if f not in had] for k, own in now["tables"]["rows"]["parts"].items()}
    fresh = commits.read(spark, root, "rows", {"tables": {"rows": now["tables"]["rows"] | {"parts": parts}}})
    at = lambda f, c, n: f(c).alias(n)
    index = fresh.groupBy("day_utc").agg(at(F.min, "block_number", "first_block"), at(F.max, "block_number", "last_block"), at(F.min, "block_timestamp", "first_at"), at(F.max, "block_timestamp", "last_at"))
    commits.commit(spark, root, {"blocks": commits.Change(index.coalesce(1), append=True)})


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite those partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def put_rows(target: DataFrame, rows: DataFrame, keys: Sequence[str], gone: DataFrame | None = None) -> DataFrame:
    """The target with rows put in place of those of the same keys, and keys in ``gone`` left out."""
    kept = target.join(rows.select(*keys), list(keys), "left_anti")
    kept = kept if gone is None else kept.join(gone.select(*keys), list(keys), "left_anti")
    return kept.unionByName(rows)


def csv_report(df: DataFrame, path: str) -> None:
    """CSV with a header; a field is quoted if it holds a comma, a quote or a line break, quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(path)


def seed_prices(payouts: DataFrame, rewards: DataFrame) -> DataFrame:
    """Seeds of both kinds in one shape: ETH from payouts, LPT from rewards, the log's place unknown.

    A reward's row pairs all tokens with the orchestrator's dollars, so those are for audits only.
    """
    one = payouts.selectExpr("lower(transaction_id) as tx_hash", "-1 as log_index", "'ETH' as asset", "cast(face_value as decimal(38,18)) as amount", "cast(face_value_usd as decimal(38,18)) as amount_usd", "cast(eth_price as decimal(38,18)) as price")
    two = rewards.selectExpr("lower(transaction_id) as tx_hash", "-1 as log_index", "'LPT' as asset", "cast(total_tokens as decimal(38,18)) as amount", "cast(orch_tokens_usd as decimal(38,18)) as amount_usd", "cast(lpt_price as decimal(38,18)) as price")
    return one.unionByName(two).dropDuplicates(["tx_hash", "asset"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), "length")
