"""Events, reports, finality, reorganisations, reconciliation, ingestion and diagnostics."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.abi import Event, Param, decoded, encoded
from tidemark.functions.money import call_hash, commission, gas_fee, normalised, part, revert_kind, topic_of
from tidemark.operators.core import as_of_join, filtered, keyset_page, reconciled, without
from tidemark.plans.registry import dbl, query
from tidemark.plans.rollups import _EV_AS_OF, AS_OF_BLOCKS, final_events, reported
from tidemark.sources import protocol as P
from tidemark.sources.cubes import stored

# --- events ---------------------------------------------------------------------------------------


def events_page(events: DataFrame, after: tuple | None, limit: int, descending: bool = False, include_reorged: bool = False, include_tentative: bool = False, either: str | None = None, **wanted) -> DataFrame:
    """A page of events: gates, one condition for each value given, a cursor of (block_number, log_index)."""
    e = events if include_reorged else events.where("is_canonical")
    e = e if include_tentative else e.where("finality = 'finalized'")
    e = e.where((F.col("from_address") == either) | (F.col("to_address") == either)) if either else e
    return keyset_page(filtered(e, **wanted), [("block_number", descending), ("log_index", descending)], after, min(limit, 1000))


@query("SELECT id, block_number, log_index, event_name FROM ev WHERE is_canonical AND finality = 'finalized' AND contract_name = 'BondingManager' AND event_name IN ('Bond', 'Unbond') AND (block_number, log_index) > (120, 1) ORDER BY block_number, log_index LIMIT 100")
def k1_events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_page(P.protocol_events(spark, sf_dir), (120, 1), 100, contract_name="BondingManager", event_name=["Bond", "Unbond"], asset=None).select("id", "block_number", "log_index", "event_name")


@query("SELECT id, block_number, log_index FROM ev WHERE is_canonical AND (from_address = 'g1' OR to_address = 'o4') ORDER BY block_number DESC, log_index DESC LIMIT 50")
def f5_events_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).where("from_address = 'g1' or to_address = 'o4'")
    return events_page(e, None, 50, descending=True, include_tentative=True).select("id", "block_number", "log_index")


@query("SELECT event_id, valuation_version, CAST(amount_usd AS DOUBLE) AS amount_usd FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY amount_usd DESC, valuation_version DESC) AS n FROM val WHERE amount_usd IS NOT NULL) WHERE n = 1 ORDER BY amount_usd DESC, event_id DESC LIMIT 40")
def k2_top_events_by_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest events, each once."""
    best = P.valuations(spark, sf_dir).where("amount_usd is not null").groupBy("event_id").agg(F.max(F.struct("amount_usd", "valuation_version")).alias("m")).select("event_id", "m.*")
    return keyset_page(best, [("amount_usd", True), ("event_id", True)], None, 40).selectExpr("event_id", "valuation_version", *dbl("amount_usd"))


@query("SELECT e.id, count(v.event_id) AS n, coalesce(string_agg(v.valuation_version || ':' || v.status, ',' ORDER BY v.valuation_version), '') AS inlined FROM ev e LEFT JOIN val v ON v.event_id = e.id GROUP BY e.id")
def j20_events_with_valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the list of its values, an empty one without any."""
    e = P.protocol_events(spark, sf_dir).select("id")
    lists = P.valuations(spark, sf_dir).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("valuation_version", "status"))).alias("vs"))
    j = e.join(lists, e.id == lists.event_id, "left").withColumn("vs", F.coalesce("vs", F.array().cast("array<struct<valuation_version:string,status:string>>")))
    return j.select("id", F.size("vs").cast("bigint").alias("n"), F.array_join(F.transform("vs", lambda v: F.concat(v.valuation_version, F.lit(":"), v.status)), ",").alias("inlined"))


@query("SELECT block_number, event_id, asset, valuation_version, status FROM val WHERE block_number >= 30 AND status = 'priced' ORDER BY block_number, event_id, asset, valuation_version LIMIT 100")
def k12_valuations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.valuations(spark, sf_dir).where("block_number >= 30 and status = 'priced'")
    return keyset_page(v, [("block_number", False), ("event_id", False), ("asset", False), ("valuation_version", False)], None, 100).select("block_number", "event_id", "asset", "valuation_version", "status")


# --- reports --------------------------------------------------------------------------------------


def receipts(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The stored receipts, one a transaction."""
    return stored(spark, sf_dir, "receipts", P.receipts, refresh)


def payout_report(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Tickets that have a value with the share at their time and the fee of their transaction; without a receipt the fee and what is net of it are not known."""
    j = reported(spark, sf_dir, "WinningTicketRedeemed").where("amount_usd is not null").join(receipts(spark, sf_dir), "tx_hash", "left").withColumn("fee", gas_fee("gas_used", "effective_gas_price", "gas_price"))
    own = commission("amount_normalized", "share")
    return j.selectExpr("id", f"{side} as address", "block_timestamp", "concat('https://arbiscan.io/tx/', tx_hash) as url", "cast(amount_normalized as double) as amount", f"cast(cast({own} as decimal(38,18)) as double) as commission", "cast(fee as double) as fee", "cast(amount_normalized as double) - cast(fee as double) as net", "cast(amount_usd as double) - cast(fee as double) * cast(native_usd_price as double) as net_usd")


_REPORT = """SELECT t.id, {s} AS address, t.block_timestamp, 'https://arbiscan.io/tx/' || t.tx_hash AS url, CAST(t.amount_normalized AS DOUBLE) AS amount,
CAST(CAST(t.amount_normalized * CAST(CAST(1000000 - t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6)) AS DECIMAL(38,18)) AS DOUBLE) AS commission, f.fee,
CAST(t.amount_normalized AS DOUBLE) - f.fee AS net, CAST(v.amount_usd AS DOUBLE) - f.fee * CAST(v.native_usd_price AS DOUBLE) AS net_usd
FROM tick t JOIN val v ON v.event_id = t.id AND v.asset = t.asset AND v.valuation_version = 'v1' AND v.amount_usd IS NOT NULL LEFT JOIN rcpt r ON r.tx_hash = t.tx_hash
CROSS JOIN LATERAL (SELECT CAST(r.gas_used AS DOUBLE) * CAST(coalesce(r.effective_gas_price, r.gas_price) AS DOUBLE) / 1e18 AS fee) f WHERE t.event_name = 'WinningTicketRedeemed'"""


@query("WITH " + _EV_AS_OF + _REPORT.format(s="t.to_address"))
def e_payouts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payout_report(spark, sf_dir, "to_address")


@query("WITH " + _EV_AS_OF + _REPORT.format(s="t.from_address"))
def e_gateway_payouts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payout_report(spark, sf_dir, "from_address")


@query("WITH " + _EV_AS_OF + """SELECT t.id, t.share, CAST(CAST(t.amount_normalized * CAST(CAST(t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6)) AS DECIMAL(38,18)) AS DOUBLE) AS own, CAST(v.native_usd_price AS DOUBLE) AS price
FROM tick t JOIN val v ON v.event_id = t.id AND v.asset = t.asset AND v.valuation_version = 'v1' AND v.amount_usd IS NOT NULL WHERE t.event_name = 'Reward'""")  # fmt: skip
def j5_rewards_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = reported(spark, sf_dir, "Reward").where("amount_usd is not null")
    return j.selectExpr("id", "share", "cast(cast(amount_normalized * cast(cast(share as decimal(12,0)) / 1000000 as decimal(7,6)) as decimal(38,18)) as double) as own", "cast(native_usd_price as double) as price")


_ETH = "eth AS (SELECT block_number, CAST(price AS DOUBLE) AS eth_price FROM price WHERE source = 'chainlink')"


@query("WITH " + _EV_AS_OF + f""", {_ETH} SELECT t.id, CAST(CAST(t.amount_normalized * CAST(CAST(t.share AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6)) AS DECIMAL(38,18)) AS DOUBLE) * CAST(v.native_usd_price AS DOUBLE)
  - CAST(r.gas_used AS DOUBLE) * CAST(coalesce(r.effective_gas_price, r.gas_price) AS DOUBLE) / 1e18 * e.eth_price AS net_usd
FROM tick t JOIN val v ON v.event_id = t.id AND v.asset = t.asset AND v.valuation_version = 'v1' AND v.amount_usd IS NOT NULL LEFT JOIN rcpt r ON r.tx_hash = t.tx_hash LEFT JOIN eth e ON e.block_number = t.block_number WHERE t.event_name = 'Reward'""")
def n9_rewards_report_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an orchestrator keeps of a reward in dollars less its transaction's fee at the price of ETH in its block; not known without a receipt or a price."""
    j = reported(spark, sf_dir, "Reward").where("amount_usd is not null").join(receipts(spark, sf_dir), "tx_hash", "left")
    eth = P.prices(spark, sf_dir).where("source = 'chainlink'").select("block_number", F.col("price").cast("double").alias("eth_price"))
    fee = gas_fee("gas_used", "effective_gas_price", "gas_price").cast("double")
    own = F.expr(f"cast(cast({part('amount_normalized', 'share')} as decimal(38,18)) as double)")
    return j.join(eth, "block_number", "left").select("id", (own * F.col("native_usd_price").cast("double") - fee * F.col("eth_price")).alias("net_usd"))


def unreceipted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Transactions of a report that have no receipt: a report that has any is not complete."""
    return without(reported(spark, sf_dir, name).where("amount_usd is not null").select("tx_hash").distinct(), receipts(spark, sf_dir).select("tx_hash"), ["tx_hash"])


@query("SELECT t.event_name AS report, count(DISTINCT t.tx_hash) AS missing FROM ev t JOIN val v ON v.event_id = t.id AND v.asset = t.asset AND v.valuation_version = 'v1' AND v.amount_usd IS NOT NULL WHERE t.event_name IN ('WinningTicketRedeemed', 'Reward') AND t.is_canonical AND t.finality = 'finalized' AND t.tx_hash NOT IN (SELECT tx_hash FROM rcpt) GROUP BY 1")
def n9_reports_without_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By report the transactions whose fees are not known, which a caller has to fetch first."""
    n = [unreceipted(spark, sf_dir, name).agg(F.lit(name).alias("report"), F.count("*").alias("missing")) for name in ("WinningTicketRedeemed", "Reward")]
    return n[0].unionByName(n[1]).where("missing > 0")


def page_of(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """A page with whether more follow: one row more than the page is read, and none but the page's are kept."""
    more = keyset_page(rows, order, after, limit + 1)
    w = W.orderBy(*[F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in order])  # limit + 1 rows
    return more.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(W.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


@query("WITH " + _EV_AS_OF + ", p AS (SELECT id, block_number, log_index, share FROM tick WHERE event_name = 'WinningTicketRedeemed' AND to_address = 'o3' ORDER BY block_number DESC, log_index DESC LIMIT 51) SELECT *, (SELECT count(*) FROM p) > 50 AS has_more, block_number || ':' || log_index AS cursor FROM p ORDER BY block_number DESC, log_index DESC LIMIT 50")
def k10_ticket_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest tickets of an orchestrator; each row's cursor leads to those after it."""
    page = page_of(reported(spark, sf_dir, "WinningTicketRedeemed", "to_address = 'o3'"), [("block_number", True), ("log_index", True)], None, 50)
    return page.select("id", "block_number", "log_index", "share", "has_more", F.concat_ws(":", "block_number", "log_index").alias("cursor"))


#: Rows of a page, and at most, by route.
LIMITS = {"events": (100, 1000), "delegators": (50, 500), "rounds": (50, 500), "round events": (100, 1000), "tickets": (100, 1000), "proposals": (100, 1000), "votes": (100, 1000), "prices": (1000, 10000), "stake": (1000, 10000)}


def limit_of(route: str, asked: int | None = None) -> int:
    usual, most = LIMITS[route]
    return max(0, min(usual if asked is None else asked, most))


def endpoint(text: str | None) -> tuple[int | None, datetime | None]:
    """A block number or the start of a UTC day; at most one is there."""
    if text is None:
        return None, None
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text), None
    try:
        return None, datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        raise ValueError(f"{text!r} is neither a day, as YYYY-MM-DD, nor a block number") from None


def between(events: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Events from ``first`` on up to ``last``, each a block or a day; as a day begins at midnight, the last one's own events are left out."""
    for (block, at), past in ((endpoint(first), False), (endpoint(last), True)):
        for c, v in (("block_number", block), ("block_timestamp", at)):
            if v is not None:
                v = F.lit(v).cast("timestamp_ntz") if c == "block_timestamp" else F.lit(v)
                events = events.where(F.col(c) <= v if past else F.col(c) >= v)
    return events


@query("SELECT count(*) FILTER (block_timestamp >= TIMESTAMP '2024-01-05' AND block_timestamp <= TIMESTAMP '2024-01-10') AS by_day, count(*) FILTER (block_number >= 100 AND block_number <= 900) AS by_block, count(*) FILTER (block_number >= 100 AND block_timestamp <= TIMESTAMP '2024-01-10') AS by_both FROM ev")
def f11_date_or_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    n = lambda a, b, name: between(e, a, b).agg(F.count("*").alias(name))
    return n("2024-01-05", "2024-01-10", "by_day").crossJoin(n("100", "900", "by_block")).crossJoin(n("100", "2024-01-10", "by_both"))  # one row each


def comma_list(text: str) -> F.Column:
    """Parts between commas, without spaces around them and without empty ones."""
    return F.expr(f"filter(transform(split({text}, ','), x -> trim(x)), x -> x <> '')")


@query("SELECT id, '/api/v1/orchestrators/' || to_address || '/avatar' AS avatar, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 2 ELSE 0 END AS n, CASE WHEN k % 3 = 0 THEN to_address WHEN k % 3 = 1 THEN to_address || '|' || from_address ELSE '' END AS parts FROM ev")
def t3_t7_avatars_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).withColumn("list", F.expr("case k % 3 when 0 then concat(' ', to_address, ' ,, ') when 1 then concat(to_address, ', ', from_address) else ' , ' end")).withColumn("found", comma_list("list"))
    return e.select("id", F.concat(F.lit("/api/v1/orchestrators/"), "to_address", F.lit("/avatar")).alias("avatar"), F.size("found").alias("n"), F.array_join("found", "|").alias("parts"))


@query("WITH u AS (SELECT * FROM ev WHERE event_name = 'TranscoderUpdate') SELECT to_address, max(block_number) AS block_number, max_by(fee_share, (block_number, log_index)) / 10000.0::DOUBLE AS share, (1000000 - max_by(fee_share, (block_number, log_index))) / 10000.0::DOUBLE AS fee_cut FROM u WHERE is_canonical AND block_number <= 1800 GROUP BY 1")
def e_transcoder_params_at_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = P.protocol_events(spark, sf_dir).where("event_name = 'TranscoderUpdate' and is_canonical and block_number <= 1800")
    g = u.groupBy("to_address").agg(F.max(F.struct("block_number", "log_index", "fee_share")).alias("m"))
    return g.selectExpr("to_address", "m.block_number", "m.fee_share / 10000D as share", "(1000000 - m.fee_share) / 10000D as fee_cut")


@query("SELECT e.id, (SELECT max(x.block_timestamp) FROM ev x WHERE x.event_name = 'TranscoderUpdate' AND x.to_address = e.to_address AND x.block_number <= e.block_number) AS last_update FROM ev e WHERE e.event_name = 'Bond'")
def w11_last_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each bond the time of the last update of its delegate up to the bond's block, whole."""
    e = P.protocol_events(spark, sf_dir)
    points = e.where("event_name = 'TranscoderUpdate'").groupBy("to_address", "block_number").agg(F.max("block_timestamp").alias("last_update"))
    return as_of_join(e.where("event_name = 'Bond'").select("id", "to_address", "block_number"), points, ["to_address"], ["block_number"], ["last_update"], AS_OF_BLOCKS).select("id", "last_update")


# --- finality, reorganisations, reconciliation -------------------------------------------------------


@query("SELECT id, CASE WHEN block_timestamp <= TIMESTAMP '2024-01-24 00:00:00' - INTERVAL 60 SECOND THEN 'finalized' WHEN block_timestamp <= TIMESTAMP '2024-01-27 00:00:00' - INTERVAL 600 SECOND THEN 'l1_posted' ELSE 'tentative' END AS finality FROM ev")
def p16_finality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the posted and of the final head, less ten minutes and one; the second wins."""
    posted, final = F.lit("2024-01-26 23:50:00").cast("timestamp_ntz"), F.lit("2024-01-23 23:59:00").cast("timestamp_ntz")
    t = F.col("block_timestamp")
    return P.protocol_events(spark, sf_dir).select("id", F.when(t <= final, "finalized").when(t <= posted, "l1_posted").otherwise("tentative").alias("finality"))


def reorganised(events: DataFrame, chain: DataFrame, depth: int = 7500) -> DataFrame:
    """Blocks among the last ``depth`` whose hash is no longer the chain's, whatever its case, with their events."""
    head = chain.agg(F.max("block_number").alias("head"))
    mine = events.where("is_canonical and finality = 'tentative'").groupBy("block_number", "block_hash").agg(F.count("*").alias("events"))
    j = mine.join(chain.withColumnRenamed("block_hash", "chain_hash"), "block_number").crossJoin(F.broadcast(head))  # one row
    return j.where((F.col("block_number") >= F.col("head") - depth) & (F.lower("block_hash") != F.lower("chain_hash"))).select("block_number", "block_hash", "chain_hash", "events")


@query("WITH chain AS (SELECT DISTINCT block_number, CASE WHEN block_number % 40 = 0 THEN 'x' || block_number WHEN block_number % 3 = 0 THEN upper(block_hash) ELSE block_hash END AS chain_hash FROM ev) SELECT block_number, block_hash, chain_hash, count(*) AS events FROM ev JOIN chain USING (block_number) WHERE is_canonical AND finality = 'tentative' AND lower(block_hash) <> lower(chain_hash) AND block_number >= (SELECT max(block_number) FROM ev) - 7500 GROUP BY ALL")
def p17_reorg_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    return reorganised(e, e.select("block_number", F.expr("case when block_number % 40 = 0 then concat('x', block_number) when block_number % 3 = 0 then upper(block_hash) else block_hash end").alias("block_hash")).distinct())


@query("SELECT CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right' WHEN a.n = b.n THEN 'matched' ELSE 'mismatch' END AS state, count(*) AS n FROM (SELECT c_custkey AS k, c_nationkey % 2 AS n FROM customer) a FULL JOIN (SELECT o_custkey AS k, count(*) % 2 AS n FROM orders GROUP BY 1) b ON a.k = b.k GROUP BY 1")
def j21_u5_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers against what their orders tell; some have none."""
    a = P._read(spark, sf_dir, "customer").selectExpr("c_custkey as k", "cast(c_nationkey % 2 as bigint) as n")
    b = P._read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") % 2).alias("n"))
    return reconciled(a, b, ["k"], ["n"]).groupBy("state").agg(F.count("*").alias("n"))


# --- ingestion ------------------------------------------------------------------------------------


def inserted(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that the target lacks, each key once: an insert that may be repeated."""
    return without(batch.dropDuplicates(keys), target.select(*keys), keys)


@query("SELECT tx_hash, log_index, id FROM ev WHERE NOT is_canonical")
def s11_insert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log, each row twice, into the canonical part of it."""
    e = P.protocol_events(spark, sf_dir)
    rows = e.select("tx_hash", "log_index", "id")
    return inserted(e.where("is_canonical").select("tx_hash", "log_index", "id"), rows.union(rows), ["tx_hash", "log_index"])


def added(old: DataFrame, more: DataFrame, keys: list[str], sums: list[str], tops: list[str]) -> DataFrame:
    """Counters added, watermarks by the larger one."""
    return old.unionByName(more).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in tops])


@query("SELECT event_name, count(*) AS events, max(id) AS last_event FROM ev GROUP BY 1")
def s13_additive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves folded one after the other are the whole."""
    one = lambda e: e.groupBy("event_name").agg(F.count("*").alias("events"), F.max("id").alias("last_event"))
    e = P.protocol_events(spark, sf_dir)
    return added(one(e.where("id < 3000")), one(e.where("id >= 3000")), ["event_name"], ["events"], ["last_event"])


@query("SELECT gateway, block_number, CAST(CASE WHEN block_number % 4 = 0 THEN deposit + 1 ELSE deposit END AS DOUBLE) AS deposit FROM bal")
def s16_bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.gateway_balances(spark, sf_dir)
    new = b.where("block_number % 4 = 0").select("block_number", (F.col("deposit") + 1).alias("new"))
    return b.join(new, "block_number", "left").selectExpr("gateway", "block_number", "cast(coalesce(new, deposit) as double) as deposit")


@query("SELECT DISTINCT tx_hash FROM ev WHERE is_canonical AND tx_hash NOT IN (SELECT tx_hash FROM rcpt)")
def s21_missing_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(P.protocol_events(spark, sf_dir).where("is_canonical").select("tx_hash").distinct(), P.receipts(spark, sf_dir).select("tx_hash"), ["tx_hash"])


#: What the words of each event's data are, in order.
SHAPES = {
    "Bond": ("address", "address", "uint", "uint"),
    "Unbond": ("address", "address", "uint"),
    "Reward": ("address", "uint"),
    "TranscoderUpdate": ("address", "uint", "uint"),
    "WinningTicketRedeemed": ("address", "address", "uint"),
}


_DECODED = """WITH s AS (SELECT id, event_name, k, user_id, 'a' || id AS topic, CAST(k AS HUGEINT) * CAST('18446744073709551616' AS HUGEINT) + user_id AS amount, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS who,
  CASE WHEN k % 7 = 0 THEN 'unknown topic' WHEN k % 6 = 0 THEN 'bad data' END AS error FROM ev)
SELECT id, CASE WHEN k % 7 <> 0 THEN event_name END AS event, error, CASE WHEN error IS NULL THEN who END AS first_address,
  CASE WHEN error IS NULL THEN CAST(amount AS VARCHAR) END AS amount, CASE WHEN error IS NULL THEN CASE event_name WHEN 'Bond' THEN 4 WHEN 'Reward' THEN 2 ELSE 3 END END AS n FROM s"""


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as logs whose topic is a hash of their name: every seventh of no known one, every sixth cut short, amounts beyond 64 bits."""
    who, amount = "lpad(lower(hex(user_id)), 64, '0')", "concat(repeat('0', 32), lpad(lower(hex(k)), 16, '0'), lpad(lower(hex(user_id)), 16, '0'))"
    data = "case event_name " + " ".join(f"when '{n}' then concat('0x', {', '.join(who if k == 'address' else amount for k in kinds)})" for n, kinds in SHAPES.items()) + " end"
    return P.protocol_events(spark, sf_dir).selectExpr("id", "contract_name as contract", "block_number", "to_date(block_timestamp) as day", "array(if(k % 7 = 0, 'no such topic', sha2(event_name, 256))) as topics", f"if(k % 6 = 0, left({data}, 50), {data}) as data")


#: Events by contract and topic, as ``raw_logs`` has them.
EVENTS = {(contract, hashlib.sha256(n.encode()).hexdigest()): Event(n, tuple(Param(f"p{i}", k) for i, k in enumerate(kinds))) for n, kinds in SHAPES.items() for contract in ("BondingManager", "TicketBroker")}


@query(_DECODED)
def s4_s12_decode_and_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoded(raw_logs(spark, sf_dir), EVENTS).withColumn("v", F.from_json("decoded", "map<string,string>"))
    n = F.size("v").cast("int")
    error = F.when(F.col("error") == "unknown topic", "unknown topic").when(F.col("error").isNotNull(), "bad data")
    return found.select("id", "event", error.alias("error"), F.col("v")["p0"].alias("first_address"), F.when(F.col("v").isNotNull(), F.try_element_at("v", F.concat(F.lit("p"), (n - 1).cast("string")))).alias("amount"), F.when(F.col("v").isNotNull(), n).alias("n"))


#: The parameters of a governor's proposal, as its standard interface has them.
PROPOSAL = (
    Param("proposalId", "uint256"), Param("proposer", "address"), Param("targets", "address[]"), Param("values", "uint256[]"), Param("signatures", "string[]"),
    Param("calldatas", "bytes[]"), Param("voteStart", "uint256"), Param("voteEnd", "uint256"), Param("description", "string"),
)


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown topic' WHEN o_orderkey % 11 = 0 THEN 'values do not fit the event' WHEN o_orderkey % 13 = 0 THEN 'data is not whole words' END AS error FROM orders)
SELECT k AS id, error, CASE WHEN error IS NULL THEN '0x' || lpad(lower(to_hex(c)), 40, '0') END AS proposer, CASE WHEN error IS NULL THEN array_to_string([CAST(c + i AS VARCHAR) FOR i IN range(k % 4)], ',') END AS amounts,
  CASE WHEN error IS NULL THEN array_to_string(['pay(' || repeat('é', CAST(i * 20 AS INTEGER)) || ')' FOR i IN range(k % 4)], ',') END AS signatures, CASE WHEN error IS NULL THEN array_to_string(['0x' || repeat('ab', CAST(i * 33 AS INTEGER)) FOR i IN range(k % 4)], ',') END AS calldatas,
  CASE WHEN error IS NULL THEN CAST(k + 10 AS VARCHAR) END AS vote_end, CASE WHEN error IS NULL THEN 'Vorschlag № ' || k || ': „' || p || '“ 提案 😀' || chr(10) || repeat('ö', CAST(k % 50 AS INTEGER)) END AS description FROM o""")  # fmt: skip
def s4_decoded_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals from the raw words of their events, with arrays and texts of any length: every seventh of an unknown contract, every eleventh with an offset beyond the end, every thirteenth cut short."""
    o = P._read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # small rows make much work: neither the file's layout nor their size tells how many tasks it takes
    o = o.selectExpr("o_orderkey as id", "o_custkey as c", "o_orderpriority as p", "transform(filter(sequence(0L, 3L), i -> i < o_orderkey % 4), i -> i) as each")
    o = o.selectExpr("id", "concat('0x', lpad(lower(hex(c)), 40, '0')) as proposer", "transform(each, i -> concat('0x', lpad(lower(hex(i)), 40, '0'))) as targets", "transform(each, i -> c + i) as amounts", "transform(each, i -> concat('pay(', repeat('é', cast(i * 20 as int)), ')')) as signatures",
                     "transform(each, i -> concat('0x', repeat('ab', cast(i * 33 as int)))) as calldatas", "concat('Vorschlag № ', id, ': „', p, '“ 提案 😀', char(10), repeat('ö', cast(id % 50 as int))) as description")
    good = o.withColumn("good", encoded([p.kind for p in PROPOSAL], ["id", "proposer", "targets", "amounts", "signatures", "calldatas", "id", "id + 10", "description"]))
    logs = good.selectExpr("id", "if(id % 7 = 0, 'Elsewhere', 'Governor') as contract", "array('0x01') as topics", "concat('0x', case when id % 11 = 0 then concat(left(good, 128), repeat('f', 64), substring(good, 193)) when id % 13 = 0 then left(good, length(good) - 2) else good end) as data")
    found = decoded(logs, {("Governor", "0x01"): Event("ProposalCreated", PROPOSAL)})
    v = found.withColumn("v", F.from_json("decoded", "proposer string, values array<string>, signatures array<string>, calldatas array<string>, voteEnd string, description string"))
    return v.select("id", "error", "v.proposer", F.array_join("v.values", ",").alias("amounts"), F.array_join("v.signatures", ",").alias("signatures"), F.array_join("v.calldatas", ",").alias("calldatas"), F.col("v.voteEnd").alias("vote_end"), "v.description")


@query("SELECT 'eth_call' || chr(0) AS x, id, sha256(CAST('eth_call' AS BLOB) || '\\x00'::BLOB || CAST('p' || k AS BLOB) || '\\x00'::BLOB || unhex(lpad(to_hex(block_number), 16, '0'))) AS call_hash FROM ev".replace("'eth_call' || chr(0) AS x, ", ""))
def h1_s5_call_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).selectExpr("id", "'eth_call' as m", "concat('p', k) as p", "block_number")
    return e.select("id", call_hash("m", "p", "block_number").alias("call_hash"))


def cached_reads(calls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that the memo answers, and those to fetch, each once."""
    hit = calls.join(cache, "call_hash")
    return hit, without(calls.select("call_hash").distinct(), cache.select("call_hash"), ["call_hash"])


@query("SELECT DISTINCT k % 97 AS call FROM ev WHERE k % 97 NOT IN (SELECT k FROM ev WHERE k < 40)")
def s6_s9_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    calls = e.select((F.col("k") % 97).alias("call_hash"))
    return cached_reads(calls, e.where("k < 40").select(F.col("k").alias("call_hash")).distinct())[1].withColumnRenamed("call_hash", "call")


@query("SELECT block_number, min(k) AS a, min(CASE WHEN block_number % 11 = 0 THEN k + 1 ELSE k END) AS b FROM ev GROUP BY 1 HAVING min(k) <> min(CASE WHEN block_number % 11 = 0 THEN k + 1 ELSE k END)")
def s7_s8_provider_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    a = e.groupBy("block_number").agg(F.min("k").alias("a"))
    b = e.groupBy("block_number").agg(F.min(F.expr("if(block_number % 11 = 0, k + 1, k)")).alias("b"))
    return a.join(b, "block_number").where("a <> b")


# --- diagnostics ----------------------------------------------------------------------------------


@query("SELECT contract_name, event_name, count(*) AS n FROM ev GROUP BY 1, 2")
def a32_event_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.protocol_events(spark, sf_dir).groupBy("contract_name", "event_name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, min(block_timestamp) AS since, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(block_timestamp))) // 1000000 AS age_s FROM ev WHERE is_valuable AND is_canonical AND id NOT IN (SELECT event_id FROM val WHERE status = 'priced')")
def a24_d5_pricing_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).where("is_valuable and is_canonical")
    left = without(e, P.valuations(spark, sf_dir).where("status = 'priced'").select(F.col("event_id").alias("id")), ["id"])
    return left.agg(F.count("*").alias("n"), F.min("block_timestamp").alias("since")).withColumn("age_s", F.expr("cast(timestampdiff(SECOND, since, timestamp_ntz '2024-02-01') as bigint)"))


@query("SELECT max(block_number) FILTER (finality = 'finalized') AS block, max(finalized_at) AS finalized_at, max(id) FILTER (is_valuable) AS last_valuable FROM ev")
def a26_a27_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = F.when(F.col("finality") == "finalized", F.col("block_number"))
    return P.protocol_events(spark, sf_dir).agg(F.max(final).alias("block"), F.max("finalized_at").alias("finalized_at"), F.max(F.when(F.col("is_valuable"), F.col("id"))).alias("last_valuable"))


@query("SELECT CASE WHEN lag_finality > 600 THEN 'finality' WHEN backlog > 0 THEN 'pricing' ELSE 'none' END AS blocker, lag_finality, backlog FROM (SELECT (epoch_us(max(block_timestamp)) - epoch_us(max(finalized_at))) // 1000000 AS lag_finality, (SELECT count(*) FROM val WHERE status <> 'priced') AS backlog FROM ev)")
def a33_a34_first_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage that holds reports up: finality, then pricing."""
    lag = P.protocol_events(spark, sf_dir).agg(F.expr("cast(timestampdiff(SECOND, max(finalized_at), max(block_timestamp)) as bigint)").alias("lag_finality"))
    j = lag.crossJoin(P.valuations(spark, sf_dir).agg(F.count_if(F.col("status") != "priced").alias("backlog")))  # one row each
    return j.select(F.when(F.col("lag_finality") > 600, "finality").when(F.col("backlog") > 0, "pricing").otherwise("none").alias("blocker"), "lag_finality", "backlog")


#: Seconds, and unpriced events, beyond which a stage is late.
LATE = {"indexer": 120, "finality": 3600, "pricing": 500, "rollup": 1800}
#: The event whose last final one is the checkpoint of a cube; the cube of metrics takes all that have an asset.
ROLLUPS = {"payouts": "event_name = 'WinningTicketRedeemed'", "rewards": "event_name = 'Reward'", "tickets": "event_name = 'WinningTicketRedeemed'", "metrics": "asset is not null"}


def age(at: str, now: str) -> F.Column:
    return F.expr(f"cast(timestampdiff(SECOND, {at}, timestamp_ntz '{now}') as bigint)")


def stages(spark: SparkSession, sf_dir: str, now: str) -> DataFrame:
    """One row: how old the oldest checkpoint of the indexer, the last final event and the oldest cube are, and how many final events have no price."""
    e = P.protocol_events(spark, sf_dir)
    seen = e.groupBy("contract_name").agg(F.max("block_timestamp").alias("at"), F.max("block_number").alias("block")).agg(F.max(age("at", now)).alias("indexer_age"), F.min("block").alias("least_block"))
    settled = final_events(spark, sf_dir)
    cubes = [age(f"max(case when {c} then finalized_at end)", now) for c in ROLLUPS.values()]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cubes])
    ages = settled.agg(age("max(finalized_at)", now).alias("finality_age"), F.when(known, F.greatest(*cubes)).alias("rollup_age"))
    left = without(settled.where("is_valuable").select("id"), P.valuations(spark, sf_dir).where("status = 'priced'").select(F.col("event_id").alias("id")), ["id"])
    return seen.crossJoin(ages).crossJoin(left.agg(F.count("*").alias("backlog")))  # one row each


def verdict(late: dict[str, int]) -> F.Column:
    """The first stage of indexer, finality, pricing and rollups that is late; a stage of unknown age is not, but for rollups."""
    over = lambda c, stage: F.col(c) > late[stage]
    return F.when(over("indexer_age", "indexer"), "indexer").when(over("finality_age", "finality"), "finality").when(over("backlog", "pricing"), "pricing").when(F.col("rollup_age").isNull() | over("rollup_age", "rollup"), "rollup").otherwise("ok")


#: Limits under which each stage in turn is the first late one, and the usual ones.
PATIENT = {"usual": {}, "no indexer": {"indexer": 10**9}, "nor finality": {"indexer": 10**9, "finality": 10**9}, "nor pricing": {"indexer": 10**9, "finality": 10**9, "pricing": 10**9}, "none": dict.fromkeys(LATE, 10**9)}
_AGE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us({})) // 1000000"
_STAGES = f"""fin AS (SELECT * FROM ev WHERE is_canonical AND finality = 'finalized'),
late AS (SELECT (SELECT max({_AGE.format('seen')}) FROM (SELECT max(block_timestamp) AS seen FROM ev GROUP BY contract_name)) AS indexer_age, (SELECT min(b) FROM (SELECT max(block_number) AS b FROM ev GROUP BY contract_name)) AS least_block,
  (SELECT {_AGE.format('max(finalized_at)')} FROM fin) AS finality_age, (SELECT CASE WHEN count(a) = count(*) THEN max(a) END FROM (SELECT {_AGE.format('max(finalized_at)')} AS a FROM fin WHERE event_name = 'WinningTicketRedeemed' UNION ALL SELECT {_AGE.format('max(finalized_at)')} FROM fin WHERE event_name = 'Reward' UNION ALL SELECT {_AGE.format('max(finalized_at)')} FROM fin WHERE asset IS NOT NULL)) AS rollup_age,
  (SELECT count(*) FROM fin WHERE is_valuable AND id NOT IN (SELECT event_id FROM val WHERE status = 'priced')) AS backlog)
"""


@query("WITH " + _STAGES + """SELECT limits, CASE WHEN indexer_age > i THEN 'indexer' WHEN finality_age > f THEN 'finality' WHEN backlog > p THEN 'pricing' WHEN rollup_age IS NULL OR rollup_age > r THEN 'rollup' ELSE 'ok' END AS blocked_at, indexer_age, least_block, finality_age, backlog, rollup_age
FROM late, (VALUES ('usual', 120, 3600, 500, 1800), ('no indexer', 1000000000, 3600, 500, 1800), ('nor finality', 1000000000, 1000000000, 500, 1800), ('nor pricing', 1000000000, 1000000000, 1000000000, 1800), ('none', 1000000000, 1000000000, 1000000000, 1000000000)) v(limits, i, f, p, r)""")  # fmt: skip
def a34_dependency_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first late stage at 2024-02-01 under several limits."""
    found = [F.struct(F.lit(name).alias("limits"), verdict({**LATE, **more}).alias("blocked_at")) for name, more in PATIENT.items()]
    return stages(spark, sf_dir, "2024-02-01 00:00:00").withColumn("v", F.explode(F.array(*found))).select("v.*", "indexer_age", "least_block", "finality_age", "backlog", "rollup_age")


def readiness(spark: SparkSession, sf_dir: str, now: str, late: dict[str, int]) -> DataFrame:
    """By cube its last day, how far it is behind and whether it is stale; beside it what holds reports up."""
    settled = final_events(spark, sf_dir)
    last = reduce(DataFrame.unionByName, [settled.where(c).agg(F.lit(n).alias("cube"), F.max(F.to_date("block_timestamp")).alias("max_day"), age("max(finalized_at)", now).alias("age_s"), F.max("id").alias("last_event")) for n, c in ROLLUPS.items()])
    priced = P.valuations(spark, sf_dir).where("status = 'priced'").agg(F.max("event_id").alias("last_priced"))
    state = stages(spark, sf_dir, now).drop("rollup_age", "indexer_age")
    j = last.withColumn("stale", F.coalesce(F.col("age_s") > late["rollup"], F.lit(True))).crossJoin(F.broadcast(priced)).crossJoin(F.broadcast(state))  # one row each, beside four
    blocker = F.when(F.col("finality_age") > late["finality"], "finality").when(F.col("backlog") > late["pricing"], "pricing").when(F.max("stale").over(W.partitionBy()), "rollup_worker").otherwise("none")
    return j.select("cube", "max_day", F.date_diff(F.lit(now).cast("date"), "max_day").alias("days_behind"), "age_s", "stale", "last_event", (F.col("last_priced") - F.col("last_event")).alias("events_behind"), blocker.alias("blocker"))


@query("WITH " + _STAGES + f""", cubes AS (SELECT unnest(['payouts', 'tickets']) AS cube, max(CAST(block_timestamp AS DATE)) AS max_day, {_AGE.format('max(finalized_at)')} AS age_s, max(id) AS last_event FROM fin WHERE event_name = 'WinningTicketRedeemed'
  UNION ALL SELECT 'rewards', max(CAST(block_timestamp AS DATE)), {_AGE.format('max(finalized_at)')}, max(id) FROM fin WHERE event_name = 'Reward' UNION ALL SELECT 'metrics', max(CAST(block_timestamp AS DATE)), {_AGE.format('max(finalized_at)')}, max(id) FROM fin WHERE asset IS NOT NULL)
SELECT cube, max_day, CAST(DATE '2024-02-01' - max_day AS INTEGER) AS days_behind, age_s, coalesce(age_s > 1800, true) AS stale, last_event, (SELECT max(event_id) FROM val WHERE status = 'priced') - last_event AS events_behind,
  CASE WHEN finality_age > 1000000000 THEN 'finality' WHEN backlog > 1000000000 THEN 'pricing' WHEN (SELECT bool_or(coalesce(age_s > 1800, true)) FROM cubes) THEN 'rollup_worker' ELSE 'none' END AS blocker FROM cubes, late""")  # fmt: skip
def a33_report_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness(spark, sf_dir, "2024-02-01 00:00:00", {**LATE, "finality": 10**9, "pricing": 10**9})


@query("SELECT min(behind) AS least, max(behind) AS most, bool_or(behind > 5) AS stale FROM (SELECT contract_name, (SELECT max(block_number) FROM ev) - max(block_number) AS behind FROM ev GROUP BY 1)")
def a35_indexer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    last = e.groupBy("contract_name").agg(F.max("block_number").alias("b")).crossJoin(F.broadcast(e.agg(F.max("block_number").alias("head"))))  # one row
    return last.select((F.col("head") - F.col("b")).alias("behind")).agg(F.min("behind").alias("least"), F.max("behind").alias("most"), F.bool_or(F.col("behind") > 5).alias("stale"))


@query("SELECT 'not canonical' AS what, count(*) AS n FROM ev WHERE NOT is_canonical UNION ALL SELECT 'tentative', count(*) FROM ev WHERE finality = 'tentative' UNION ALL SELECT 'failed values', count(*) FROM val WHERE status LIKE 'failed_%' UNION ALL SELECT 'no receipt', count(DISTINCT tx_hash) FROM ev WHERE tx_hash NOT IN (SELECT tx_hash FROM rcpt)")
def a36_u1_u2_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = P.protocol_events(spark, sf_dir), P.valuations(spark, sf_dir)
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n("not canonical", e.where("not is_canonical")).unionByName(n("tentative", e.where("finality = 'tentative'"))).unionByName(n("failed values", v.where("status like 'failed_%'"))).unionByName(n("no receipt", without(e.select("tx_hash").distinct(), P.receipts(spark, sf_dir).select("tx_hash"), ["tx_hash"])))


@query("WITH t AS (SELECT DISTINCT from_address AS address, 'gateway' AS entity FROM ev UNION ALL SELECT DISTINCT to_address, 'orchestrator' FROM ev), s AS (SELECT t.*, n.ens_name, CASE WHEN n.ens_name IS NULL THEN TIMESTAMP '1970-01-01' ELSE TIMESTAMP '2024-01-01' END AS seen FROM t LEFT JOIN nam n USING (address)) SELECT address, entity FROM s WHERE ens_name IS NULL OR seen < TIMESTAMP '2024-01-02' ORDER BY seen, address, entity LIMIT 200")
def p26_p27_names_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses whose name is missing or stale, oldest first."""
    e = P.protocol_events(spark, sf_dir)
    t = e.select(F.col("from_address").alias("address"), F.lit("gateway").alias("entity")).distinct().unionByName(e.select(F.col("to_address").alias("address"), F.lit("orchestrator").alias("entity")).distinct())
    j = t.join(P.names(spark, sf_dir), "address", "left").withColumn("seen", F.expr("if(ens_name is null, timestamp_ntz '1970-01-01', timestamp_ntz '2024-01-01')"))
    return keyset_page(j.where("ens_name is null or seen < timestamp_ntz '2024-01-02'"), [("seen", False), ("address", False), ("entity", False)], None, 200).select("address", "entity")


_ALLOWED = re.compile(r"^\s*(select|with)\b", re.I)
#: Literals, quoted names and comments, in which any word is harmless; statements that write.
_QUOTED = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)
_WRITES = re.compile(r"\b(insert\s+(into|overwrite)|update\s+\S+\s+set|delete\s+from|merge\s+into|(drop|create|alter|truncate)\s+(or\s+replace\s+)?(temp\w*\s+)?(table|view|database|schema|function))\b", re.I)


#: Functions that run code, read files' names or stop a query; what a parsed plan calls relations and functions.
_UNSAFE = ("reflect", "try_reflect", "java_method", "raise_error", "assert_true", "input_file_name", "input_file_block_start", "input_file_block_length")
_RELATION, _TABLE_FUNCTION = re.compile(r"'UnresolvedRelation \[([^\]]*)\]"), re.compile(r"UnresolvedTableValuedFunction|UnresolvedTVF", re.I)
#: Names that a statement gives itself.
_CTE = re.compile(r"CTE \[([^\]]*)\]")


def guarded(sql: str, limit: int = 1000, spark: SparkSession | None = None, views: tuple[str, ...] = ()) -> str:
    """A single SELECT or WITH with a limit around it; anything else is refused.

    With a session its parsed plan is looked at too: relations are ``views`` or names that the statement gives itself, so no path or
    other table is read, and no function of _UNSAFE is called.
    """
    body = sql.strip().rstrip(";").strip()
    bare = _QUOTED.sub("''", body)
    if ";" in bare or not _ALLOWED.match(bare) or _WRITES.search(bare):
        raise ValueError("a single SELECT or WITH statement is asked for")
    if spark is not None:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
        text = parsed.toString()
        own = {n.strip().lower() for m in _CTE.findall(text) for n in m.split(",")} | {v.lower() for v in views}
        if {m.strip().lower() for m in _RELATION.findall(text)} - own or _TABLE_FUNCTION.search(text):
            raise ValueError("only the views that are given may be read")
        names = {n.lower().rpartition(".")[2] for n in re.findall(r"([A-Za-z_][\w.]*)`?\s*\(", _QUOTED.sub(lambda m: m[0][1:-1] if m[0][0] == "`" else "''", body))}
        if names & set(_UNSAFE):
            raise ValueError("a function is called that may not be")
    return f"SELECT * FROM ({body}) LIMIT {limit}"


@query("SELECT to_json({event_name: event_name, n: n}) AS row FROM (SELECT event_name, count(*) AS n FROM ev GROUP BY 1)")
def s23_guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    P.protocol_events(spark, sf_dir).createOrReplaceTempView("tidemark_ev")
    return spark.sql(guarded("select event_name, count(*) as n from tidemark_ev group by 1", spark=spark, views=("tidemark_ev",))).select(F.to_json(F.struct("*")).alias("row"))


def metrics(lines: DataFrame) -> DataFrame:
    """Samples of a metrics page: name, labels, value; comments and broken lines give nulls."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    labels = F.expr(r"if(l = '', map(), str_to_map(regexp_replace(l, '\"', ''), ',', '='))")
    return lines.select("line", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("l"), F.expr("try_cast(nullif(regexp_extract(line, r'^[^#{\\s]+(?:[{].*[}])?\\s+(\\S+)', 1), '') as double)").alias("value")).withColumn("labels", labels).drop("l")


@query("SELECT id, CASE WHEN k % 2 = 0 THEN 'failed_missing_pool' ELSE 'retryable' END AS kind, '0x' || repeat('0', 24) || lower(substr('0x' || lpad(to_hex(user_id), 40, 'A'), 3)) AS topic, CASE WHEN k % 10 = 0 THEN CAST(k // 10 AS VARCHAR) ELSE (k // 10) || '.' || (k % 10) END AS short FROM ev")
def k7_t1_t5_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).selectExpr("id", "if(k % 2 = 0, 'RPC: Execution Reverted', 'timeout') as m", "concat('0x', lpad(hex(user_id), 40, 'A')) as a", "concat(k div 10, '.', k % 10, '000') as d")
    return e.select("id", revert_kind("m").alias("kind"), topic_of("a").alias("topic"), normalised("d").alias("short"))


@query("SELECT id, CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(k AS VARCHAR) END AS eth_price, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS topic FROM ev")
def j1_j2_j5_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of the first step from WETH or ETH to USD, else 0; the second topic."""
    step = "concat('{\"pair\":\"', if(k % 3 = 0, 'LPT/WETH', 'WETH/USD'), '\",\"price\":\"', k, '\"}')"
    e = P.protocol_events(spark, sf_dir).selectExpr("id", f"concat('{{\"steps\":[{{\"pair\":\"LPT/WETH\",\"price\":\"9\"}},', {step}, ']}}') as chain", "if(k % 5 = 0, '{\"topics\":[\"t0\"]}', concat('{\"topics\":[\"t0\",\"', k, '\"]}')) as raw")
    found = "filter(from_json(get_json_object(chain, '$.steps'), 'array<struct<pair:string,price:string>>'), s -> s.pair in ('WETH/USD', 'ETH/USD'))"
    return e.selectExpr("id", f"coalesce(try_element_at({found}, 1).price, '0') as eth_price", "get_json_object(raw, '$.topics[1]') as topic")


@query("SELECT contract_name, n, from_block, lead(from_block) OVER (PARTITION BY contract_name ORDER BY from_block) - 1 AS to_block FROM (SELECT contract_name, block_number // 500 AS n, min(block_number) AS from_block FROM ev GROUP BY 1, 2)")
def s22_registry_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a contract with the blocks they hold for."""
    r = P.protocol_events(spark, sf_dir).groupBy("contract_name", F.expr("block_number div 500").alias("n")).agg(F.min("block_number").alias("from_block"))
    return r.withColumn("to_block", F.lead("from_block").over(W.partitionBy("contract_name").orderBy("from_block")) - 1)
