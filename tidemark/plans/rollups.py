"""Daily cubes and what is read from them: time buckets, leaderboards, period summaries, series."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.money import commission, part, tz_bucket
from tidemark.operators.core import as_of_join, date_spine, keyset_page, null_safe
from tidemark.plans.registry import dbl, query
from tidemark.sources import protocol as P
from tidemark.sources.cubes import Cube, bucketed, kept_up, noted_prints, stored, stored_log
from tidemark.sources.storage import block_window

#: Blocks of one recipient's events that a task of an as-of join takes at most.
AS_OF_BLOCKS = 1_000_000
#: Updates of shares.
_UPDATES = "event_name = 'TranscoderUpdate' and is_canonical"


def _day():
    return F.to_date("block_timestamp").alias("day")


def final(log: DataFrame) -> DataFrame:
    return log.where("is_canonical and finality = 'finalized'")


def final_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final(P.protocol_events(spark, sf_dir))


#: What reports and cubes need of an event; nothing else goes through the shuffle of an as-of join.
NEEDED = ("id", "block_number", "log_index", "block_timestamp", "tx_hash", "event_name", "from_address", "to_address", "asset", "amount_normalized")


def with_shares(events: DataFrame, every: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """NEEDED and ``more`` columns of ``events`` with the fee share of the last update of their recipient at or before them; 0 without any.

    ``events`` are best filtered before: no condition passes the window behind the join.
    """
    events = events.select(*NEEDED, *more)
    updates = every.where("event_name = 'TranscoderUpdate' and is_canonical").select("to_address", "block_number", "log_index", F.col("fee_share").alias("share"))
    return as_of_join(events, updates, ["to_address"], ["block_number", "log_index"], ["share"], AS_OF_BLOCKS).withColumn("share", F.coalesce("share", F.lit(0)))


def valued(events: DataFrame, val: DataFrame, how: str = "inner") -> DataFrame:
    """Events with their values; a null asset is equal to a null asset."""
    v = val.select(F.col("event_id").alias("v_event"), F.col("asset").alias("v_asset"), "valuation_version", "amount_usd", "native_usd_price", "status")
    return events.join(v, null_safe(events, v, [("id", "v_event")], [("asset", "v_asset")]), how).drop("v_event", "v_asset")


#: What payout and reward reports are made of.
REPORTED = ("WinningTicketRedeemed", "Reward")


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final payouts and rewards with their value, updates of shares, and for each recipient and range of blocks the update that it begins with."""
    log = P.protocol_events(spark, sf_dir).withColumn("part", F.expr(f"block_number div {AS_OF_BLOCKS}"))
    v = P.valuations(spark, sf_dir).where(f"valuation_version = '{P.V1}' and amount_usd is not null")
    e = valued(final(log).where(F.col("event_name").isin(*REPORTED)).select(*NEEDED, "part"), v, "left").select(*NEEDED, "part", "amount_usd", "native_usd_price")
    u = log.where(_UPDATES).select(*NEEDED, "part", F.struct("fee_share").alias("point"))
    ends = u.groupBy("to_address", "part").agg(F.max(F.struct("block_number", "log_index", "point")).alias("end"))
    asked = e.select("to_address", "part").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    before = W.partitionBy("to_address").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.unionByName(asked).groupBy("to_address", "part").agg(F.max("end").alias("end")).withColumn("in", F.last("end", ignorenulls=True).over(before)).where("in is not null")
    carried = carried.select("to_address", "part", F.lit(-1).cast("bigint").alias("block_number"), F.lit(-1).alias("log_index"), F.lit("carried").alias("event_name"), F.col("in.point").alias("point"))
    return e.unionByName(u, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)


def report_log(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The stored log of reports in buckets by recipient and range of blocks, sorted by place, so that a look back needs no shuffle."""
    return bucketed(spark, sf_dir, "reports", _report_rows, ["to_address", "part"], ["to_address", "part", "block_number", "log_index"], refresh)


def reported(spark: SparkSession, sf_dir: str, name: str, where: str = "true") -> DataFrame:
    """Payouts or rewards with their value, where there is one, and the share in force; ``where`` is on recipients."""
    w = W.partitionBy("to_address", "part").orderBy("block_number", "log_index").rowsBetween(W.unboundedPreceding, 0)
    log = report_log(spark, sf_dir).where(f"({where}) and (event_name = '{name}' or point is not null)")
    return log.withColumn("share", F.coalesce(F.last("point", ignorenulls=True).over(w)["fee_share"], F.lit(0))).where(f"event_name = '{name}'").drop("point", "part")


def log_by_day(spark: SparkSession, sf_dir: str, refresh: bool = False) -> str:
    """Where the stored log lies, by day and with an index of its blocks."""
    return stored_log(spark, sf_dir, "log", P.protocol_events, refresh)


def valued_log(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Canonical valuable events, each with its value in the first version where it has one, stored."""
    def build(s: SparkSession, d: str) -> DataFrame:
        e, v = P.protocol_events(s, d).where("is_canonical and is_valuable"), P.valuations(s, d).where(f"valuation_version = '{P.V1}'")
        return valued(e, v, "left").select(*NEEDED, "finality", "amount_usd").sortWithinPartitions("block_number")

    return stored(spark, sf_dir, "valued", build, refresh)


def of_days(events: DataFrame, first: date | str | None, last: date | str | None) -> DataFrame:
    """Events of whole days, by a range of their time that reaches the scan."""
    if first is not None:
        events = events.where(F.col("block_timestamp") >= F.lit(str(first)).cast("timestamp_ntz"))
    if last is not None:
        events = events.where(F.col("block_timestamp") < F.lit(str(last)).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return events


def on_days(events: DataFrame, days: DataFrame | None) -> DataFrame:
    return events if days is None else events.join(F.broadcast(days), F.to_date("block_timestamp") == F.col("day"), "left_semi")  # a row a day


def payouts_daily(spark: SparkSession, sf_dir: str, log: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Payouts by day, orchestrator, version and kind of gateway; of another state of the log, or of some days (day), if they are given."""
    log = P.protocol_events(spark, sf_dir) if log is None else log
    e = with_shares(on_days(final(log).where("event_name = 'WinningTicketRedeemed'"), days), log)
    kinds = P.classifications(spark, sf_dir)
    j = valued(e, on_days(P.valuations(spark, sf_dir), days)).join(kinds, F.col("from_address") == F.col("gateway"), "left").withColumn("kind", F.coalesce("kind", F.lit("transcoding")))
    usd = F.coalesce("amount_usd", F.lit(0))
    own = F.expr(commission("amount_normalized", "share"))
    own_usd = F.expr(commission("cast(coalesce(amount_usd, 0) as decimal(24,12))", "share"))
    g = j.groupBy(_day(), F.col("to_address").alias("orchestrator"), "valuation_version", "kind").agg(
        F.count("*").alias("payouts"), F.sum("amount_normalized").alias("face"), F.sum(own).alias("commission"), F.sum(F.col("amount_normalized") - own).alias("delegators"),
        F.sum(usd).alias("face_usd"), F.sum(own_usd).alias("commission_usd"), F.countDistinct("from_address").alias("gateways"), F.count("amount_usd").alias("priced"), F.max("id").alias("last_event"),
    )
    return g


_EV_AS_OF = """
upd AS (SELECT to_address, block_number, log_index, fee_share FROM ev WHERE event_name = 'TranscoderUpdate' AND is_canonical),
tick AS (SELECT e.*, coalesce(u.fee_share, 0) AS share FROM ev e
  LEFT JOIN LATERAL (SELECT fee_share FROM upd u WHERE u.to_address = e.to_address AND (u.block_number, u.log_index) <= (e.block_number, e.log_index)
                     ORDER BY u.block_number DESC, u.log_index DESC LIMIT 1) u ON true
  WHERE e.event_name IN ('WinningTicketRedeemed', 'Reward') AND e.is_canonical AND e.finality = 'finalized'),
pay AS (SELECT CAST(t.block_timestamp AS DATE) AS day, t.to_address AS orchestrator, v.valuation_version, coalesce(c.kind, 'transcoding') AS kind, count(*) AS payouts,
  sum(t.amount_normalized) AS face, sum(t.amount_normalized * CAST(CAST(1000000 - t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6))) AS commission,
  sum(coalesce(v.amount_usd, 0)) AS face_usd, sum(CAST(coalesce(v.amount_usd, 0) AS DECIMAL(24,12)) * CAST(CAST(1000000 - t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6))) AS commission_usd,
  count(DISTINCT t.from_address) AS gateways, count(v.amount_usd) AS priced, max(t.id) AS last_event
  FROM tick t JOIN val v ON v.event_id = t.id AND v.asset IS NOT DISTINCT FROM t.asset LEFT JOIN cls c ON c.gateway = t.from_address
  WHERE t.event_name = 'WinningTicketRedeemed' GROUP BY ALL)
"""


def daily_gateways(spark: SparkSession, sf_dir: str, log: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Who paid whom on which day, for distinct counts over any days."""
    log = P.protocol_events(spark, sf_dir) if log is None else log
    return on_days(final(log), days).where("event_name = 'WinningTicketRedeemed'").select(_day(), F.col("to_address").alias("orchestrator"), F.col("from_address").alias("gateway")).distinct()


def cube(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False) -> DataFrame:
    """A stored daily cube: payouts, rewards, tickets, metrics or gateways."""
    return kept_up(spark, sf_dir, name, CUBES[name], refresh)


@query("WITH " + _EV_AS_OF + """
SELECT day, orchestrator, valuation_version, kind, payouts, CAST(face AS DOUBLE) AS face, CAST(CAST(commission AS DECIMAL(38,18)) AS DOUBLE) AS commission, CAST(CAST(face - commission AS DECIMAL(38,18)) AS DOUBLE) AS delegators,
  CAST(face_usd AS DOUBLE) AS face_usd, CAST(commission_usd AS DOUBLE) AS commission_usd, gateways, priced, last_event FROM pay""")  # fmt: skip
def p18_payouts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payouts_daily(spark, sf_dir).selectExpr("day", "orchestrator", "valuation_version", "kind", "payouts", *dbl("face", "face_usd", "commission_usd"), "cast(cast(commission as decimal(38,18)) as double) as commission", "cast(cast(delegators as decimal(38,18)) as double) as delegators", "gateways", "priced", "last_event")


def rewards_daily(spark: SparkSession, sf_dir: str, log: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Rewards by day, orchestrator and version; the orchestrator's part is amount x cut, the rest its delegators'."""
    log = P.protocol_events(spark, sf_dir) if log is None else log
    e = with_shares(on_days(final(log).where("event_name = 'Reward'"), days), log)
    own = F.expr(part("amount_normalized", "share"))
    own_usd = F.expr(part("cast(coalesce(amount_usd, 0) as decimal(24,12))", "share"))
    return valued(e, on_days(P.valuations(spark, sf_dir), days)).groupBy(_day(), F.col("to_address").alias("orchestrator"), "valuation_version").agg(
        F.count("*").alias("rewards"), F.sum("amount_normalized").alias("total"), F.sum(own).alias("own"), F.sum(F.col("amount_normalized") - own).alias("delegators"), F.sum(F.coalesce("amount_usd", F.lit(0))).alias("total_usd"), F.sum(own_usd).alias("own_usd"), F.count("amount_usd").alias("priced"), F.max("id").alias("last_event"),
    )


_REW = _EV_AS_OF + """,
rew AS (SELECT CAST(t.block_timestamp AS DATE) AS day, t.to_address AS orchestrator, v.valuation_version, count(*) AS rewards, sum(t.amount_normalized) AS total,
  sum(t.amount_normalized * CAST(CAST(t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6))) AS own, sum(coalesce(v.amount_usd, 0)) AS total_usd,
  sum(CAST(coalesce(v.amount_usd, 0) AS DECIMAL(24,12)) * CAST(CAST(t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6))) AS own_usd, count(v.amount_usd) AS priced, max(t.id) AS last_event
  FROM tick t JOIN val v ON v.event_id = t.id AND v.asset IS NOT DISTINCT FROM t.asset WHERE t.event_name = 'Reward' GROUP BY ALL)
"""


@query("WITH " + _REW + "SELECT day, orchestrator, valuation_version, rewards, CAST(total AS DOUBLE) AS total, CAST(CAST(own AS DECIMAL(38,18)) AS DOUBLE) AS own, CAST(CAST(total - own AS DECIMAL(38,18)) AS DOUBLE) AS delegators, CAST(total_usd AS DOUBLE) AS total_usd, CAST(CAST(own_usd AS DECIMAL(38,18)) AS DOUBLE) AS own_usd, priced, last_event FROM rew")
def p19_rewards_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards_daily(spark, sf_dir).selectExpr("day", "orchestrator", "valuation_version", "rewards", *dbl("total", "total_usd"), "cast(cast(own as decimal(38,18)) as double) as own", "cast(cast(own_usd as decimal(38,18)) as double) as own_usd", "cast(cast(delegators as decimal(38,18)) as double) as delegators", "priced", "last_event")


def tickets_daily(spark: SparkSession, sf_dir: str, log: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Tickets by day and kind, valued or not."""
    log = P.protocol_events(spark, sf_dir) if log is None else log
    e = on_days(final(log).where("event_name = 'WinningTicketRedeemed'"), days).join(P.classifications(spark, sf_dir), F.col("from_address") == F.col("gateway"), "left")
    return e.groupBy(_day(), F.coalesce("kind", F.lit("transcoding")).alias("kind")).agg(F.count("*").alias("tickets"), F.countDistinct("to_address").alias("orchestrators"), F.countDistinct("from_address").alias("gateways"))


_TIX = """tix AS (SELECT CAST(block_timestamp AS DATE) AS day, coalesce(c.kind, 'transcoding') AS kind, count(*) AS tickets, count(DISTINCT to_address) AS orchestrators, count(DISTINCT from_address) AS gateways
  FROM ev LEFT JOIN cls c ON c.gateway = from_address WHERE event_name = 'WinningTicketRedeemed' AND is_canonical AND finality = 'finalized' GROUP BY 1, 2)
"""


@query("WITH " + _TIX + "SELECT * FROM tix")
def p20_tickets_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets_daily(spark, sf_dir)


def metrics_daily(events: DataFrame, val: DataFrame) -> DataFrame:
    """Events by day, contract, event, asset and version: what is valued, final and has an asset."""
    j = valued(events.where("is_canonical and finality = 'finalized' and asset is not null"), val)
    return j.groupBy(_day(), "contract_name", "event_name", "asset", "valuation_version").agg(F.count("*").alias("events"), F.sum("amount_normalized").alias("native"), F.sum("amount_usd").alias("usd"), F.count("amount_usd").alias("priced"), F.max("id").alias("last_event"))


_MET = """met AS (SELECT CAST(e.block_timestamp AS DATE) AS day, e.contract_name, e.event_name, e.asset, v.valuation_version, count(*) AS events, sum(e.amount_normalized) AS native, sum(v.amount_usd) AS usd, count(v.amount_usd) AS priced, max(e.id) AS last_event
  FROM ev e JOIN val v ON v.event_id = e.id AND v.asset IS NOT DISTINCT FROM e.asset WHERE e.is_canonical AND e.finality = 'finalized' AND e.asset IS NOT NULL GROUP BY ALL)
"""


@query("WITH " + _MET + "SELECT day, contract_name, event_name, asset, valuation_version, events, CAST(native AS DOUBLE) AS native, CAST(usd AS DOUBLE) AS usd, priced, last_event FROM met")
def p21_event_metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_daily(P.protocol_events(spark, sf_dir), P.valuations(spark, sf_dir))
    return m.selectExpr("day", "contract_name", "event_name", "asset", "valuation_version", "events", *dbl("native", "usd"), "priced", "last_event")


def _metrics(spark: SparkSession, sf_dir: str, log: DataFrame, days: DataFrame | None) -> DataFrame:
    return metrics_daily(on_days(log, days), on_days(P.valuations(spark, sf_dir), days))


#: How each stored cube is made; an update of a share counts for all later days.
CUBES = {
    "payouts": Cube(payouts_daily, P.protocol_events, _UPDATES, (P.classifications,)),
    "rewards": Cube(rewards_daily, P.protocol_events, _UPDATES),
    "tickets": Cube(tickets_daily, P.protocol_events, sides=(P.classifications,)),
    "gateways": Cube(daily_gateways, P.protocol_events),
    "metrics": Cube(_metrics, P.protocol_events),
}


def bucket_raw(events: DataFrame, bucket: str, tz: str = "UTC", address: str | None = None, limit: int = 1000) -> DataFrame:
    """Time buckets straight from valued events: all canonical valuable ones, tentative too, priced or not."""
    e = events.where((F.col("from_address") == address) | (F.col("to_address") == address)) if address else events
    return e.groupBy(tz_bucket(bucket, "block_timestamp", tz).alias("bucket")).agg(F.count("*").alias("events"), F.sum(F.coalesce("amount_normalized", F.lit(0))).alias("native"), F.coalesce(F.sum("amount_usd"), F.lit(0)).alias("usd"), F.count("amount_usd").alias("priced")).orderBy("bucket").limit(limit)


_RAW = """SELECT {b} AS bucket, count(*) AS events, CAST(sum(coalesce(e.amount_normalized, 0)) AS DOUBLE) AS native, CAST(coalesce(sum(v.amount_usd), 0) AS DOUBLE) AS usd, coalesce(CAST(sum(v.amount_usd) AS DOUBLE) / nullif(count(v.amount_usd), 0), 0) AS mean_usd
FROM ev e LEFT JOIN val v ON v.event_id = e.id AND v.asset IS NOT DISTINCT FROM e.asset AND v.valuation_version = 'v1' WHERE e.is_canonical AND e.is_valuable {w} GROUP BY 1 ORDER BY 1 LIMIT 1000"""


def _bucket_out(df: DataFrame) -> DataFrame:
    return df.selectExpr("bucket", "events", *dbl("native", "usd"), "coalesce(cast(usd as double) / nullif(priced, 0), 0D) as mean_usd")


@query(_RAW.format(b="CAST(date_trunc('day', e.block_timestamp) AS TIMESTAMP)", w=""))
def a1_bucket_day_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_out(bucket_raw(valued_log(spark, sf_dir), "day"))


@query(_RAW.format(b="CAST(date_trunc('week', e.block_timestamp) AS TIMESTAMP)", w="AND (e.from_address = 'g1' OR e.to_address = 'o3')"))
def a1_bucket_week_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_out(bucket_raw(valued_log(spark, sf_dir).where("from_address = 'g1' or to_address = 'o3'"), "week"))


@query(_RAW.format(b="CAST(date_trunc('day', e.block_timestamp - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS TIMESTAMP)", w=""))
def d2_bucket_day_new_york(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_out(bucket_raw(valued_log(spark, sf_dir), "day", "America/New_York"))


def bucket_rollup(metrics: DataFrame, bucket: str, version: str | None = None, limit: int = 1000) -> DataFrame:
    """Time buckets from the daily cube; without a version an event counts once for each."""
    m = metrics.where(F.col("valuation_version") == version) if version else metrics
    return m.groupBy(F.expr(f"cast(date_trunc('{bucket}', day) as date)").alias("bucket")).agg(F.sum("events").alias("events"), F.sum("native").alias("native"), F.sum("usd").alias("usd"), F.sum("priced").alias("priced")).orderBy("bucket").limit(limit)


_ROLL = "SELECT CAST(date_trunc('{b}', day) AS DATE) AS bucket, CAST(sum(events) AS BIGINT) AS events, CAST(sum(native) AS DOUBLE) AS native, CAST(sum(usd) AS DOUBLE) AS usd, CAST(sum(usd) AS DOUBLE) / nullif(CAST(sum(priced) AS BIGINT), 0) AS mean_usd FROM met {w} GROUP BY 1"


def _rolled(df: DataFrame) -> DataFrame:
    return df.selectExpr("bucket", "events", *dbl("native", "usd"), "cast(usd as double) / nullif(priced, 0) as mean_usd")


@query("WITH " + _MET + _ROLL.format(b="week", w="WHERE valuation_version = 'v1'"))
def a2_bucket_week_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(bucket_rollup(cube(spark, sf_dir, "metrics"), "week", P.V1))


@query("WITH " + _MET + _ROLL.format(b="month", w=""))
def q2_bucket_month_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(bucket_rollup(cube(spark, sf_dir, "metrics"), "month"))


def route(to: date, covered_to: date, tz: str = "UTC", address: str | None = None) -> str:
    """The cube answers if no address is asked for, days are UTC days and it covers the range."""
    return "rollup" if address is None and tz == "UTC" and to <= covered_to else "raw"


@query("WITH " + _MET + "SELECT 'rollup' AS source, day AS bucket, CAST(sum(events) AS BIGINT) AS events FROM met WHERE valuation_version = 'v1' AND day <= DATE '2024-01-20' GROUP BY day")
def a3_routed_day_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = route(date(2024, 1, 20), date(2024, 1, 24))
    if source == "rollup":
        out = bucket_rollup(cube(spark, sf_dir, "metrics").where("day <= date '2024-01-20'"), "day", P.V1)
    else:
        out = bucket_raw(valued_log(spark, sf_dir).where("block_timestamp < timestamp_ntz '2024-01-21'"), "day")
    return out.select(F.lit(source).alias("source"), "bucket", "events")


@query("SELECT min(CASE WHEN block_number >= 100 THEN block_timestamp END) AS first_at, max(CASE WHEN block_number <= 2000 THEN block_timestamp END) AS last_at FROM ev")
def a4_block_window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_window(spark, log_by_day(spark, sf_dir), 100, 2000)


def payout_board(spark: SparkSession, sf_dir: str, first: str, last: str, version: str = P.V1) -> DataFrame:
    """Sums of the stored cube by orchestrator, distinct gateways from the pairs of each day, and names."""
    days = cube(spark, sf_dir, "payouts").where(F.col("day").between(first, last) & (F.col("valuation_version") == version))
    sums = days.groupBy("orchestrator").agg(F.sum("payouts").alias("payouts"), F.sum("face").alias("face"), F.sum("commission_usd").alias("commission_usd"), F.sum("priced").alias("priced"))
    gateways = cube(spark, sf_dir, "gateways").where(F.col("day").between(first, last)).groupBy("orchestrator").agg(F.countDistinct("gateway").alias("gateways"))
    names = P.names(spark, sf_dir).select(F.col("address").alias("orchestrator"), F.coalesce("override_name", "ens_name").alias("name"))
    return sums.join(gateways, "orchestrator", "left").join(names, "orchestrator", "left").withColumn("gateways", F.coalesce("gateways", F.lit(0)))


_BOARD = """board AS (SELECT p.orchestrator, CAST(sum(payouts) AS BIGINT) AS payouts, sum(face) AS face, sum(commission_usd) AS commission_usd, CAST(sum(priced) AS BIGINT) AS priced,
  coalesce((SELECT count(DISTINCT from_address) FROM ev WHERE event_name = 'WinningTicketRedeemed' AND is_canonical AND finality = 'finalized' AND to_address = p.orchestrator AND block_timestamp >= DATE '2024-01-03' AND block_timestamp < DATE '2024-01-18'), 0) AS gateways,
  max(coalesce(n.override_name, n.ens_name)) AS name FROM pay p LEFT JOIN nam n ON n.address = p.orchestrator WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-17' AND valuation_version = 'v1' GROUP BY p.orchestrator)
"""
_BOARD_OUT = "SELECT orchestrator, name, payouts, CAST(face AS DOUBLE) AS face, CAST(CAST(commission_usd AS DECIMAL(38,18)) AS DOUBLE) AS commission_usd, priced, gateways FROM board ORDER BY CAST(commission_usd AS DECIMAL(38,18)) DESC, orchestrator LIMIT {n} {o}"


def _board_page(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return keyset_page(payout_board(spark, sf_dir, "2024-01-03", "2024-01-17").withColumn("commission_usd", F.col("commission_usd").cast("decimal(38,18)")), [("commission_usd", True), ("orchestrator", False)], None, limit)


def _board_out(df: DataFrame) -> DataFrame:
    return df.selectExpr("orchestrator", "name", "payouts", *dbl("face", "commission_usd"), "priced", "gateways")


@query("WITH " + _EV_AS_OF + "," + _BOARD + _BOARD_OUT.format(n=10, o=""))
def a5_payout_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board_out(_board_page(spark, sf_dir, 10))


@query("WITH " + _EV_AS_OF + "," + _BOARD + _BOARD_OUT.format(n=5, o="OFFSET 5"))
def k3_payout_leaderboard_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the fifth row, from its value and address."""
    whole = payout_board(spark, sf_dir, "2024-01-03", "2024-01-17").withColumn("commission_usd", F.col("commission_usd").cast("decimal(38,18)"))
    row = _board_page(spark, sf_dir, 5).orderBy("commission_usd", F.desc("orchestrator")).limit(1).select(F.struct("commission_usd", "orchestrator").alias("at"))
    after = whole.join(F.broadcast(row), F.expr("commission_usd < at.commission_usd or (commission_usd = at.commission_usd and orchestrator > at.orchestrator)")).drop("at")
    return _board_out(keyset_page(after, [("commission_usd", True), ("orchestrator", False)], None, 5))


def period(kind: str, day: date) -> tuple[date, date]:
    """First and last day of the day, week from Monday, or month that a day is in."""
    if kind == "daily":
        return day, day
    if kind == "weekly":
        first = day - timedelta(days=day.weekday())
        return first, first + timedelta(days=6)
    first = day.replace(day=1)
    return first, (first + timedelta(days=32)).replace(day=1) - timedelta(days=1)


def payout_summary(spark: SparkSession, sf_dir: str, first: date, last: date, kind: str | None = None, version: str = P.V1) -> DataFrame:
    days = cube(spark, sf_dir, "payouts").where(F.col("day").between(first, last) & (F.col("valuation_version") == version))
    days = days.where(F.col("kind") == kind) if kind else days
    return days.agg(F.coalesce(F.sum("payouts"), F.lit(0)).alias("payouts"), F.coalesce(F.sum("face"), F.lit(0)).alias("face"), F.coalesce(F.sum("face_usd"), F.lit(0)).alias("face_usd"), F.countDistinct("orchestrator").alias("orchestrators"))


@query("WITH " + _EV_AS_OF + """
SELECT p.period, CAST(coalesce(sum(payouts), 0) AS BIGINT) AS payouts, CAST(coalesce(sum(face), 0) AS DOUBLE) AS face, CAST(coalesce(sum(face_usd), 0) AS DOUBLE) AS face_usd, count(DISTINCT orchestrator) AS orchestrators
FROM (VALUES ('daily', DATE '2024-01-10', DATE '2024-01-10'), ('weekly', DATE '2024-01-08', DATE '2024-01-14'), ('monthly', DATE '2024-01-01', DATE '2024-01-31')) p(period, a, b)
LEFT JOIN pay ON day BETWEEN p.a AND p.b AND valuation_version = 'v1' AND kind = 'transcoding' GROUP BY p.period""")  # fmt: skip
def a6_payout_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("daily", "weekly", "monthly"):
        one = payout_summary(spark, sf_dir, *period(kind, date(2024, 1, 10)), kind="transcoding").selectExpr(f"'{kind}' as period", "payouts", *dbl("face", "face_usd"), "orchestrators")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH " + _REW + "SELECT orchestrator, CAST(sum(rewards) AS BIGINT) AS rewards, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(total_usd) AS DOUBLE) AS total_usd, CAST(CAST(sum(own) AS DECIMAL(38,18)) AS DOUBLE) AS own FROM rew WHERE valuation_version = 'v1' GROUP BY 1 ORDER BY sum(total_usd) DESC, 1 LIMIT 10")
def a7_reward_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cube(spark, sf_dir, "rewards").where("valuation_version = 'v1'").groupBy("orchestrator").agg(F.sum("rewards").alias("rewards"), F.sum("total").alias("total"), F.sum("total_usd").alias("total_usd"), F.sum("own").cast("decimal(38,18)").alias("own"))
    return keyset_page(s, [("total_usd", True), ("orchestrator", False)], None, 10).selectExpr("orchestrator", "rewards", *dbl("total", "total_usd", "own"))


@query("WITH " + _REW + "SELECT CAST(coalesce(sum(rewards), 0) AS BIGINT) AS rewards, CAST(coalesce(sum(total_usd), 0) AS DOUBLE) AS total_usd FROM rew WHERE valuation_version = 'v1' AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
def a8_reward_summary_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = period("weekly", date(2024, 1, 10))
    d = cube(spark, sf_dir, "rewards").where(F.col("day").between(first, last) & (F.col("valuation_version") == P.V1))
    return d.agg(F.coalesce(F.sum("rewards"), F.lit(0)).alias("rewards"), F.coalesce(F.sum("total_usd"), F.lit(0)).alias("total_usd")).selectExpr("rewards", *dbl("total_usd"))


@query("WITH " + _TIX + "SELECT CAST(d AS DATE) AS day, k.kind, coalesce(tickets, 0) AS tickets FROM generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY) s(d), (VALUES ('ai'), ('transcoding')) k(kind) LEFT JOIN tix ON tix.day = CAST(d AS DATE) AND tix.kind = k.kind")
def a23_ticket_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day for both kinds, zeros where there is none."""
    days = date_spine(spark, "2023-12-28", "2024-02-02").withColumn("kind", F.explode(F.array(F.lit("ai"), F.lit("transcoding"))))
    return days.join(cube(spark, sf_dir, "tickets").select("day", "kind", "tickets"), ["day", "kind"], "left").withColumn("tickets", F.coalesce("tickets", F.lit(0)))


def repaired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a cube needs after a reorganisation: rows to delete and rows to put, of the keys before and after."""
    a, b = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("was")), new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("now"))
    j = a.join(b, keys, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return j.select(*keys, F.when(F.col("now").isNull(), "delete").otherwise("put").alias("action"))


#: The keys of each cube.
KEYS = {"payouts": ["day", "orchestrator", "valuation_version", "kind"], "rewards": ["day", "orchestrator", "valuation_version"], "tickets": ["day", "kind"], "metrics": ["day", "contract_name", "event_name", "asset", "valuation_version"]}


def repairs(spark: SparkSession, sf_dir: str, log: DataFrame, first_block: int) -> DataFrame:
    """What each stored cube needs once the log is ``log``, which differs from the cubes' from ``first_block`` on.

    Only days that have events from that block on, before or after, are rebuilt: an update of a share that is gone
    changes no earlier ones.
    """
    touched = [e.where(F.col("block_number") >= first_block).select(_day()) for e in (P.protocol_events(spark, sf_dir), log)]
    days = touched[0].union(touched[1]).distinct()  # a row a day
    new = {
        "payouts": payouts_daily(spark, sf_dir, log, days),
        "rewards": rewards_daily(spark, sf_dir, log, days),
        "tickets": tickets_daily(spark, sf_dir, log, days),
        "metrics": _metrics(spark, sf_dir, log, days),
    }
    every = [repaired(cube(spark, sf_dir, n).join(days, "day", "left_semi"), new[n], KEYS[n]).select(F.lit(n).alias("cube"), "day", F.concat_ws("|", *KEYS[n][1:]).alias("key"), "action") for n in KEYS]
    return reduce(DataFrame.unionByName, every)


def _repair_sql(name: str, cte: str) -> str:
    keys = ", ".join(KEYS[name])
    key = "concat_ws('|', " + ", ".join(KEYS[name][1:]) + ")"
    return f"SELECT DISTINCT '{name}' AS cube, day, {key} AS key, CASE WHEN ({keys}) IN (SELECT ({keys}) FROM {cte}2) THEN 'put' ELSE 'delete' END AS action FROM ((SELECT * FROM {cte} EXCEPT SELECT * FROM {cte}2) UNION ALL (SELECT * FROM {cte}2 EXCEPT SELECT * FROM {cte}))"


_CUBES = _REW + "," + _TIX + "," + _MET
_AFTER = "ev2 AS (SELECT * FROM ev WHERE NOT (block_number BETWEEN 300 AND 500)), " + re.sub(r"\b(ev|upd|tick|pay|rew|tix|met)\b", r"\g<1>2", _CUBES)


@query("WITH " + _CUBES + ", " + _AFTER + " UNION ALL ".join(_repair_sql(n, c) for n, c in (("payouts", "pay"), ("rewards", "rew"), ("tickets", "tix"), ("metrics", "met"))))
def p22_rollup_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 300 to 500 turn out not to be canonical: rows of the four cubes to delete and to put."""
    return repairs(spark, sf_dir, P.protocol_events(spark, sf_dir).where("not (block_number between 300 and 500)"), 300)


_SUMS = """SELECT cube, day, key, CAST(n AS BIGINT) AS n, CAST(CAST(amount AS DECIMAL(38,18)) AS DOUBLE) AS amount FROM (
  SELECT 'payouts' AS cube, day, concat_ws('|', orchestrator, valuation_version, kind) AS key, payouts AS n, commission AS amount FROM pay2
  UNION ALL SELECT 'rewards', day, concat_ws('|', orchestrator, valuation_version), rewards, own FROM rew2
  UNION ALL SELECT 'tickets', day, kind, tickets, gateways FROM tix2
  UNION ALL SELECT 'metrics', day, concat_ws('|', contract_name, event_name, asset, valuation_version), events, usd FROM met2)"""


@query("WITH " + _CUBES + ", " + _AFTER + _SUMS)
def p22_cubes_after_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes that were stored when the whole log was canonical, after blocks 300 to 500 turn out not to be: only days that differ are derived anew."""
    whole = P.protocol_events(spark, sf_dir)
    after = whole.where("not (block_number between 300 and 500)")
    said = {"payouts": ("payouts", "commission"), "rewards": ("rewards", "own"), "tickets": ("tickets", "gateways"), "metrics": ("events", "usd")}
    noted = {c: [noted_prints(log, c) for log in (whole, after)] for c in {CUBES[name].carried for name in said}}
    every = []
    for name, (n, amount) in said.items():
        before, now = noted[CUBES[name].carried]
        kept_up(spark, sf_dir, f"repaired-{name}", CUBES[name], log=whole, noted=before)
        rows = kept_up(spark, sf_dir, f"repaired-{name}", CUBES[name], log=after, noted=now)
        every.append(rows.select(F.lit(name).alias("cube"), "day", F.concat_ws("|", *KEYS[name][1:]).alias("key"), F.col(n).alias("n"), F.col(amount).cast("decimal(38,18)").cast("double").alias("amount")))
    return reduce(DataFrame.unionByName, every)


@query("SELECT CAST(e.block_timestamp AS DATE) AS day, e.to_address AS orchestrator, v.valuation_version, count(DISTINCT e.from_address) AS gateways FROM ev e JOIN val v ON v.event_id = e.id AND v.asset = e.asset WHERE e.event_name = 'WinningTicketRedeemed' AND e.is_canonical GROUP BY ALL")
def p23_distinct_gateways(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).where("event_name = 'WinningTicketRedeemed' and is_canonical")
    return valued(e, P.valuations(spark, sf_dir)).groupBy(_day(), F.col("to_address").alias("orchestrator"), "valuation_version").agg(F.countDistinct("from_address").alias("gateways"))
