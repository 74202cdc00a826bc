"""Queries that go through files and streams: seeds, reports, partitions replaced, tables kept in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.abi import decoded
from tidemark.operators.core import latest_by
from tidemark.plans.operations import EVENTS, metrics, raw_logs
from tidemark.plans.registry import query
from tidemark.plans.rollups import log_by_day
from tidemark.sources import protocol as P
from tidemark.sources import commits, storage
from tidemark.streaming import incremental


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.protocol_events(spark, sf_dir).select("id", "block_number", "block_timestamp", "event_name", "contract_name", "from_address", "to_address", "is_canonical", F.to_date("block_timestamp").alias("day"))


def _daily(e: DataFrame) -> DataFrame:
    return e.where("is_canonical").groupBy("day", "event_name").agg(F.count("*").alias("events"), F.countDistinct("from_address").alias("senders"))


@query("SELECT CAST(block_timestamp AS DATE) AS day, event_name, count(*) AS events, count(DISTINCT from_address) AS senders FROM ev WHERE is_canonical GROUP BY 1, 2")
def st1_st9_followed_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts as a stream leaves them that reads a log by day, and then rows that came late, of some senders, for every day."""
    source, target, state = (storage.shared_path(spark, n) for n in ("log", "daily", "state"))
    log, late = _log(spark, sf_dir), F.col("from_address").endswith("7")
    schema = "id long, block_number long, block_timestamp timestamp_ntz, event_name string, contract_name string, from_address string, to_address string, is_canonical boolean, day date"
    for some in (~late, late):
        log.where(some).repartition("day").write.mode("append").partitionBy("day").parquet(source)
        incremental.follow(spark, source, schema, target, state, _daily, lambda e: e, "day", 16).awaitTermination()
    return commits.read(spark, target, "rows").select("day", "event_name", "events", "senders")


@query("""WITH f AS (SELECT *, k % 7 = 0 OR k % 6 = 0 AS bad FROM ev)
SELECT CAST(block_timestamp AS DATE) AS day, count(*) FILTER (NOT bad) AS rows, count(*) FILTER (bad) AS dead, (SELECT min(b) FROM (SELECT max(block_number) AS b FROM f GROUP BY contract_name)) AS checkpoint FROM f GROUP BY 1""")
def st9_chunks_with_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs in chunks, each row twice: decoded rows, dead letters and checkpoints as the commits leave them."""
    source, target, state = (storage.shared_path(spark, n) for n in ("logs", "ingested", "state"))
    logs = raw_logs(spark, sf_dir)
    schema = "id long, contract string, block_number long, day date, topics array<string>, data string"
    for some in (F.col("id") % 10 < 6, F.col("id") % 10 >= 3):  # what both have comes twice
        logs.where(some).repartition(4).write.mode("append").parquet(source)
        incremental.ingest(spark, source, schema, target, state, lambda chunk: decoded(chunk, EVENTS, ("id", "contract", "block_number", "day")), ["id"], "day").awaitTermination()
    at = commits.manifest(spark, target)
    n = lambda name: commits.read(spark, target, name, at).groupBy("day").agg(F.count("*").alias(name))
    last = commits.read(spark, target, "checkpoints", at).agg(F.min("block_number").alias("checkpoint"))
    return n("rows").join(n("dead"), "day", "full_outer").select("day", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("dead", F.lit(0)).alias("dead")).crossJoin(F.broadcast(last))  # one row


@query("SELECT CAST(block_timestamp AS DATE) AS day, event_name, count(*) FILTER (is_canonical) AS events, count(DISTINCT from_address) AS senders FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (is_canonical) > 0")
def st1_loops_over_one_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams that go on in one session, each from its own checkpoint, while the second half of the log comes: counts of canonical events, and all senders once."""
    source, counts, seen, one, two = (storage.shared_path(spark, n) for n in ("log", "counts", "seen", "state", "state"))
    log = _log(spark, sf_dir).select("id", "event_name", "from_address", "is_canonical", "day")
    schema = "id long, event_name string, from_address string, is_canonical boolean, day date"
    put = lambda some: log.where(some).repartition("day").write.mode("append").partitionBy("day").parquet(source)
    tally = lambda e: e.where("is_canonical").groupBy("day", "event_name").agg(F.count("*").alias("events"))
    put("id % 2 = 0")
    loops = incremental.Loops({
        "counts": lambda every: incremental.follow(spark, source, schema, counts, one, tally, lambda e: e, "day", 40, every),
        "seen": lambda every: incremental.first_seen(spark, source, schema, ["event_name", "from_address"], "day", seen, two, 40, every),
    }, "500 milliseconds")
    put("id % 2 = 1")
    loops.tend()
    loops.stop()
    senders = commits.read(spark, seen, "rows").groupBy("day", "event_name").agg(F.count("from_address").alias("senders"))
    return commits.read(spark, counts, "rows").join(senders, ["day", "event_name"]).select("day", "event_name", "events", "senders")


@query("SELECT CAST(block_timestamp AS DATE) AS day, count(*) AS events FROM ev WHERE block_timestamp < TIMESTAMP '2024-01-10' OR block_timestamp >= TIMESTAMP '2024-01-15' GROUP BY 1")
def st6_retracted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts as a stream leaves them that first reads the whole log, then retractions of all events of five days."""
    source, target, state = (storage.shared_path(spark, n) for n in ("log", "daily", "state"))
    log = P.protocol_events(spark, sf_dir).select("id", F.to_date("block_timestamp").alias("day"))
    log.withColumn("sign", F.lit(1)).write.parquet(source)
    last = lambda e: e.groupBy("day", "id").agg(F.sum("sign").alias("n")).where("n > 0").groupBy("day").agg(F.count("*").alias("events"))
    run = lambda: incremental.follow(spark, source, "id long, day date, sign int", target, state, last, lambda e: e, "day", 100).awaitTermination()
    run()
    log.where("day between '2024-01-10' and '2024-01-14'").withColumn("sign", F.lit(-1)).write.mode("append").parquet(source)
    run()
    return commits.read(spark, target, "rows").select("day", "events")


@query("SELECT DISTINCT CAST(block_timestamp AS DATE) AS day, to_address, from_address FROM ev")
def st8_first_seen_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders by recipient and day, each once, from a log of which every row comes twice, the second time late."""
    source, target, state = (storage.shared_path(spark, n) for n in ("log", "seen", "state"))
    for _ in range(2):
        _log(spark, sf_dir).select("to_address", "from_address", "day").repartition(4).write.mode("append").parquet(source)
        incremental.first_seen(spark, source, "to_address string, from_address string, day date", ["to_address", "from_address"], "day", target, state).awaitTermination()
    return commits.read(spark, target, "rows").select("day", "to_address", "from_address")


@query("SELECT max(finalized_at) AS frontier, min(finalized_at) FILTER (k % 17 = 0 AND is_valuable) AS oldest, least(max(finalized_at), min(finalized_at) FILTER (k % 17 = 0 AND is_valuable)) AS watermark FROM ev")
def p24_st3_st4_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    return incremental.frontier(e, e.where("k % 17 = 0 and is_valuable"))


@query("SELECT CAST(block_timestamp AS DATE) AS day, count(*) AS events FROM ev WHERE NOT (block_timestamp >= DATE '2024-01-10' AND block_timestamp < DATE '2024-01-12') OR is_canonical GROUP BY 1")
def s14_replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days are written again without what is not canonical; the others stay as they are."""
    path, e = storage.shared_path(spark, "days"), _log(spark, sf_dir).select("id", "is_canonical", "day")
    storage.replace_partitions(e, path, "day")
    storage.replace_partitions(e.where("is_canonical and day in (date '2024-01-10', date '2024-01-11')"), path, "day")
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("events"))


@query("SELECT gateway, max(block_number) AS block_number FROM bal WHERE gateway NOT IN ('g1', 'g2') GROUP BY 1 UNION ALL SELECT 'new', -1")
def s15_put_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_by(P.gateway_balances(spark, sf_dir).select("gateway", "block_number"), ["gateway"], ["block_number"])
    return storage.put_rows(latest, spark.sql("select 'new' as gateway, -1L as block_number"), ["gateway"], spark.sql("select stack(2, 'g1', 'g2') as gateway"))


def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, written as CSV and read back."""
    path = storage.shared_path(spark, "report")
    e = P.protocol_events(spark, sf_dir).selectExpr("id", "concat('a \"', event_name, '\", ', k) as note")
    storage.csv_report(e, path)
    return spark.read.schema("id long, note string").option("header", True).option("escape", '"').csv(path)


@query("SELECT id, 'a \"' || event_name || '\", ' || k AS note FROM ev")
def s18_t4_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all events through a CSV file and back."""
    return event_report(spark, sf_dir)


@query("SELECT asset, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS amount_usd FROM (SELECT 'ETH' AS asset, 't' || o_orderkey AS tx, CAST(o_totalprice AS DECIMAL(12,2)) AS usd FROM orders UNION ALL SELECT 'LPT', 't' || o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def s10_seed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P._read(spark, sf_dir, "orders").withColumn("usd", F.expr("cast(o_totalprice as decimal(12,2))"))
    payouts = o.selectExpr("concat('T', o_orderkey) as transaction_id", "usd as face_value", "usd as face_value_usd", "2 as eth_price")
    rewards = o.where("o_orderkey % 2 = 0").selectExpr("concat('T', o_orderkey) as transaction_id", "usd as total_tokens", "usd as orch_tokens_usd", "3 as lpt_price")
    return storage.seed_prices(payouts, rewards).groupBy("asset").agg(F.count("*").alias("n"), F.sum("amount_usd").cast("double").alias("amount_usd"))


@query("SELECT block_number, count(*) AS logs, min(block_timestamp) AS first_at FROM ev WHERE contract_name = 'BondingManager' AND event_name IN ('Bond', 'Reward') AND block_number BETWEEN 200 AND 1200 GROUP BY 1")
def s1_s2_s3_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by contract, kind and blocks from a log that is partitioned by day and has an index of its blocks, joined to the blocks' times."""
    e = P.protocol_events(spark, sf_dir)
    logs = storage.scan_logs(spark, log_by_day(spark, sf_dir), "BondingManager", ["Bond", "Reward"], 200, 1200).select("id", "block_number")
    times = e.where("contract_name = 'BondingManager' and event_name in ('Bond', 'Reward')").groupBy("block_number").agg(F.min("block_timestamp").alias("block_timestamp"))
    return storage.with_block_times(logs, times).groupBy("block_number").agg(F.count("*").alias("logs"), F.min("block_timestamp").alias("first_at"))


@query("SELECT event_name AS name, 'tidemark_' || lower(event_name) AS metric, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY 1")
def s24_metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.protocol_events(spark, sf_dir).groupBy("event_name").agg(F.count("*").alias("n")).selectExpr("concat('tidemark_', lower(event_name), '{name=\"', event_name, '\"} ', n) as line")
    return metrics(lines).selectExpr("labels['name'] as name", "name as metric", "value")


@query("SELECT count(*) AS n FROM ev")
def a37_exact_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.protocol_events(spark, sf_dir).agg(F.count("*").alias("n"))
