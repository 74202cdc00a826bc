"""Gateways, orchestrators, delegators, rounds, governance, prices and the network as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.money import commission, gas_fee, inverse_percent, part, percent
from tidemark.operators.core import keyset_page, latest_by, without
from tidemark.plans.registry import dbl, query
from tidemark.plans.rollups import _EV_AS_OF, _REW, cube, final_events, of_days, valued, with_shares
from tidemark.plans.stake import _REPLAY, registry, stake
from tidemark.sources import protocol as P
from tidemark.sources.cubes import stored

# --- gateways -------------------------------------------------------------------------------------

#: What each of the ticket broker's events is in the ledger; the events of it that name a claimant; those besides that touch a gateway's balance.
FLOW_KINDS = {
    "DepositFunded": "deposit_in",
    "ReserveFunded": "reserve_in",
    "WinningTicketTransfer": "reserve_transfer",
    "WinningTicketRedeemed": "ticket_redeemed",
    "ReserveClaimed": "reserve_claimed",
    "Withdrawal": "withdrawal",
}
CLAIMS = ("WinningTicketRedeemed", "WinningTicketTransfer", "ReserveClaimed")
TOUCHES = (*FLOW_KINDS, "Unlock", "UnlockCancelled")
#: The kinds that fund a gateway, and that pay for it; gross, transfers count too.
FUNDING, NET = ("deposit_in", "reserve_in"), ("ticket_redeemed", "reserve_claimed")
GROSS = (*NET, "reserve_transfer")


def kind_of_flow() -> F.Column:
    kind = F.lit("other")
    for name, flow in FLOW_KINDS.items():
        kind = F.when(F.col("event_name") == name, flow).otherwise(kind)
    return kind


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical events of the ledger with their kind and, where they name one, their claimant."""
    e = P.broker_events(spark, sf_dir).where("is_canonical and from_address is not null").where(F.col("event_name").isin(*FLOW_KINDS))
    return e.withColumn("flow_kind", kind_of_flow()).withColumn("claimant", F.when(F.col("event_name").isin(*CLAIMS), F.col("to_address")))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gateways' ledger: one row per event and kind of flow, valued by the default version where priced."""
    v = P.valuations(spark, sf_dir).where(f"valuation_version = '{P.V1}' and status = 'priced'")
    j = valued(flow_events(spark, sf_dir), v, "left")
    return j.select(F.col("id").alias("event_id"), "flow_kind", F.col("from_address").alias("gateway"), F.col("to_address").alias("counterparty"), "claimant", "block_number", "block_timestamp", "amount_normalized", "amount_usd")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger."""
    return stored(spark, sf_dir, "flows", flows)


_FLOW = "CASE event_name WHEN 'DepositFunded' THEN 'deposit_in' WHEN 'ReserveFunded' THEN 'reserve_in' WHEN 'WinningTicketTransfer' THEN 'reserve_transfer' WHEN 'WinningTicketRedeemed' THEN 'ticket_redeemed' WHEN 'ReserveClaimed' THEN 'reserve_claimed' WHEN 'Withdrawal' THEN 'withdrawal' ELSE 'other' END"
_FLOWS = f"""flow AS (SELECT e.id AS event_id, {_FLOW} AS flow_kind, from_address AS gateway, to_address AS counterparty, CASE WHEN event_name IN ('WinningTicketRedeemed', 'WinningTicketTransfer', 'ReserveClaimed') THEN to_address END AS claimant,
    e.block_number, e.block_timestamp, amount_normalized, v.amount_usd
  FROM bev e LEFT JOIN val v ON v.event_id = e.id AND v.valuation_version = 'v1' AND v.status = 'priced' WHERE is_canonical AND {_FLOW} <> 'other')
"""


@query("WITH " + _FLOWS + "SELECT event_id, flow_kind, gateway, counterparty, claimant, block_number, CAST(amount_normalized AS DOUBLE) AS amount, CAST(amount_usd AS DOUBLE) AS amount_usd FROM flow")
def p10_gateway_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).selectExpr("event_id", "flow_kind", "gateway", "counterparty", "claimant", "block_number", "cast(amount_normalized as double) as amount", "cast(amount_usd as double) as amount_usd")


@query("SELECT event_name, count(*) AS events, min(" + _FLOW + ") AS flow_kind, count(CASE WHEN event_name IN ('WinningTicketRedeemed', 'WinningTicketTransfer', 'ReserveClaimed') THEN to_address END) AS with_claimant FROM bev GROUP BY 1")
def f15_f16_flow_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the broker's events by kind; what is none of the ledger's is 'other'."""
    claimant = F.when(F.col("event_name").isin(*CLAIMS), F.col("to_address"))
    return P.broker_events(spark, sf_dir).groupBy("event_name").agg(F.count("*").alias("events"), F.min(kind_of_flow()).alias("flow_kind"), F.count(claimant).alias("with_claimant"))


@query(f"SELECT id, {_FLOW} AS flow_kind FROM bev WHERE is_canonical AND finality <> 'finalized' AND {_FLOW} <> 'other'")
def j14_events_without_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose flow, of the kind that is computed for them, the ledger lacks; here it holds those of final events."""
    e = flow_events(spark, sf_dir)
    final = e.where("finality = 'finalized'").select("id", "flow_kind")
    return without(e.select("id", "flow_kind"), final, ["id", "flow_kind"])


def recipients(flows_of: DataFrame, gross: bool) -> DataFrame:
    """Who got how much of a gateway; flows without a recipient are left out."""
    f = flows_of.where(F.col("flow_kind").isin(*(GROSS if gross else NET))).withColumn("recipient", F.coalesce("claimant", "counterparty")).where("recipient is not null")
    count = lambda kind: F.count_if(F.col("flow_kind") == kind)
    return f.groupBy("gateway", "recipient").agg(
        F.count("*").alias("flows"), F.sum("amount_normalized").alias("amount"), F.coalesce(F.sum("amount_usd"), F.lit(0)).alias("usd"), F.count("amount_usd").alias("priced"), count("ticket_redeemed").alias("tickets"), count("reserve_claimed").alias("claims"), count("reserve_transfer").alias("transfers"), F.max("block_number").alias("last_block"),
    )


@query("WITH " + _FLOWS + "SELECT gateway, coalesce(claimant, counterparty) AS recipient, count(*) AS flows, CAST(sum(amount_normalized) AS DOUBLE) AS amount, CAST(coalesce(sum(amount_usd), 0) AS DOUBLE) AS usd, count(amount_usd) AS priced, count(*) FILTER (flow_kind = 'ticket_redeemed') AS tickets, count(*) FILTER (flow_kind = 'reserve_claimed') AS claims, count(*) FILTER (flow_kind = 'reserve_transfer') AS transfers, max(block_number) AS last_block FROM flow WHERE flow_kind IN ('ticket_redeemed', 'reserve_claimed', 'reserve_transfer') AND coalesce(claimant, counterparty) IS NOT NULL GROUP BY 1, 2")
def a9_gateway_recipients_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipients(ledger(spark, sf_dir), True).selectExpr("gateway", "recipient", "flows", *dbl("amount", "usd"), "priced", "tickets", "claims", "transfers", "last_block")


@query("WITH " + _FLOWS + "SELECT gateway, coalesce(claimant, counterparty) AS recipient, count(*) AS flows, CAST(sum(amount_normalized) AS DOUBLE) AS amount FROM flow WHERE flow_kind IN ('ticket_redeemed', 'reserve_claimed') AND coalesce(claimant, counterparty) IS NOT NULL GROUP BY 1, 2")
def f17_gateway_recipients_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipients(ledger(spark, sf_dir), False).selectExpr("gateway", "recipient", "flows", *dbl("amount"))


@query("WITH " + _FLOWS + "SELECT gateway, flow_kind, count(*) AS flows, CAST(sum(amount_normalized) AS DOUBLE) AS amount, min(block_timestamp) AS first_at FROM flow GROUP BY 1, 2")
def a10_gateway_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ledger(spark, sf_dir).groupBy("gateway", "flow_kind").agg(F.count("*").alias("flows"), F.sum("amount_normalized").alias("amount"), F.min("block_timestamp").alias("first_at"))
    return g.selectExpr("gateway", "flow_kind", "flows", *dbl("amount"), "first_at")


@query("WITH " + _FLOWS + "SELECT gateway, count(*) FILTER (flow_kind IN ('deposit_in', 'reserve_in')) AS funding, count(*) FILTER (flow_kind IN ('ticket_redeemed', 'reserve_claimed', 'reserve_transfer')) AS payouts, count(*) FILTER (flow_kind = 'withdrawal') AS withdrawals, count(DISTINCT coalesce(claimant, counterparty)) FILTER (flow_kind IN ('ticket_redeemed', 'reserve_claimed', 'reserve_transfer')) AS recipients FROM flow GROUP BY 1")
def a11_a12_gateway_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid, funding = F.col("flow_kind").isin(*GROSS), F.col("flow_kind").isin(*FUNDING)
    return ledger(spark, sf_dir).groupBy("gateway").agg(F.count_if(funding).alias("funding"), F.count_if(paid).alias("payouts"), F.count_if(F.col("flow_kind") == "withdrawal").alias("withdrawals"), F.countDistinct(F.when(paid, F.coalesce("claimant", "counterparty"))).alias("recipients"))


@query("SELECT from_address AS gateway, block_number, log_index, event_name FROM (SELECT *, row_number() OVER (PARTITION BY from_address, block_number ORDER BY log_index DESC) AS n FROM bev WHERE is_canonical) WHERE n = 1")
def p11_w7_gateway_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each gateway and block that may have changed its balance."""
    e = P.broker_events(spark, sf_dir).where("is_canonical and from_address is not null").where(F.col("event_name").isin(*TOUCHES)).select(F.col("from_address").alias("gateway"), "block_number", "log_index", "event_name")
    return latest_by(e, ["gateway", "block_number"], ["log_index"])


def gateway_profiles(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None, balances: DataFrame | None = None) -> DataFrame:
    """The last balance of each gateway, or of those in ``keys``, with its kind."""
    kinds = P.classifications(spark, sf_dir)
    balances = P.gateway_balances(spark, sf_dir) if balances is None else balances
    b = latest_by(balances if keys is None else balances.join(keys, "gateway", "left_semi"), ["gateway"], ["block_number"])
    return b.join(kinds, "gateway", "left").withColumn("kind", F.coalesce("kind", F.lit("transcoding")))


@query("SELECT gateway, block_number, CAST(deposit AS DOUBLE) AS deposit, coalesce(kind, 'transcoding') AS kind FROM (SELECT *, row_number() OVER (PARTITION BY gateway ORDER BY block_number DESC) AS n FROM bal) LEFT JOIN cls USING (gateway) WHERE n = 1 ORDER BY deposit DESC, gateway LIMIT 50")
def w1_k6_gateways_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(gateway_profiles(spark, sf_dir), [("deposit", True), ("gateway", False)], None, 50).selectExpr("gateway", "block_number", *dbl("deposit"), "kind")


def at_block(snapshots: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The last snapshot of each key at or before a block, and how many blocks old it is."""
    return latest_by(snapshots.where(F.col("block_number") <= block), keys, ["block_number"]).withColumn("staleness", F.lit(block) - F.col("block_number"))


@query("SELECT gateway, block_number, CAST(deposit AS DOUBLE) AS deposit, 5000 - block_number AS staleness FROM (SELECT *, row_number() OVER (PARTITION BY gateway ORDER BY block_number DESC) AS n FROM bal WHERE block_number <= 5000) WHERE n = 1")
def j7_w5_gateway_balances_at_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_block(P.gateway_balances(spark, sf_dir), ["gateway"], 5000).selectExpr("gateway", "block_number", *dbl("deposit"), "staleness")


@query("SELECT gateway, block_number, CAST(deposit AS DOUBLE) AS deposit FROM bal WHERE gateway = 'g7' AND block_number BETWEEN 1000 AND 9000 ORDER BY block_number LIMIT 100")
def f13_gateway_balance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.gateway_balances(spark, sf_dir).where("gateway = 'g7' and block_number between 1000 and 9000")
    return keyset_page(b, [("block_number", False)], None, 100).selectExpr("gateway", "block_number", *dbl("deposit"))


# --- orchestrators --------------------------------------------------------------------------------


@query("SELECT address, round, CAST(total_stake AS DOUBLE) AS total_stake, is_active, coalesce(override_name, ens_name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY round DESC) AS n FROM stk) LEFT JOIN nam USING (address) WHERE n = 1 ORDER BY total_stake DESC, address LIMIT 30")
def w2_k5_orchestrators_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_by(P.stake_rounds(spark, sf_dir), ["address"], ["round"]).join(P.names(spark, sf_dir), "address", "left").withColumn("name", F.coalesce("override_name", "ens_name"))
    return keyset_page(s, [("total_stake", True), ("address", False)], None, 30).selectExpr("address", "round", *dbl("total_stake"), "is_active", "name")


@query("SELECT round, CAST(total_stake AS DOUBLE) AS total_stake, is_active FROM stk WHERE address = 'o7' ORDER BY round DESC LIMIT 100")
def e_stake_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(P.stake_rounds(spark, sf_dir).where("address = 'o7'"), [("round", True)], None, 100).selectExpr("round", *dbl("total_stake"), "is_active")


@query("SELECT round, raw_reward_cut / 10000.0::DOUBLE AS reward_cut, (1000000 - raw_fee_share) / 10000.0::DOUBLE AS fee_cut FROM stk WHERE address = 'o7'")
def n2_n3_cuts_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stake_rounds(spark, sf_dir).where("address = 'o7'").select("round", percent("raw_reward_cut").cast("double").alias("reward_cut"), inverse_percent("raw_fee_share").cast("double").alias("fee_cut"))


_GAS = """gas AS (SELECT tx_hash, CAST(CAST(gas_used AS DOUBLE) * CAST(coalesce(effective_gas_price, gas_price) AS DOUBLE) / 1e18 AS DOUBLE) AS fee FROM rcpt)
"""


@query("SELECT tx_hash, CAST(gas_used AS DOUBLE) * CAST(coalesce(effective_gas_price, gas_price) AS DOUBLE) / 1e18 AS fee FROM rcpt")
def n7_gas_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.receipts(spark, sf_dir).select("tx_hash", gas_fee("gas_used", "effective_gas_price", "gas_price").cast("double").alias("fee"))


def economics(spark: SparkSession, sf_dir: str, first: str, last: str, once: bool) -> DataFrame:
    """By orchestrator the dollars that it keeps of payouts and rewards, and the gas of its transactions.

    Of a payout it keeps the commission, of a reward its share. Gas is that of canonical redemptions and rewards, final or
    not; it counts for every event of a transaction, or once.
    """
    e = of_days(final_events(spark, sf_dir), first, last).where("event_name in ('WinningTicketRedeemed', 'Reward')")
    v = valued(with_shares(e, P.protocol_events(spark, sf_dir)), P.valuations(spark, sf_dir))
    usd, reward = "cast(coalesce(amount_usd, 0) as decimal(24,12))", F.col("event_name") == "Reward"
    kept = v.groupBy("to_address").agg(F.sum(F.when(reward, F.expr(part(usd, "share")))).alias("rewards_usd"), F.sum(F.when(~reward, F.expr(commission(usd, "share")))).alias("payouts_usd"))
    paid = of_days(P.protocol_events(spark, sf_dir), first, last).where("is_canonical and event_name in ('WinningTicketRedeemed', 'Reward')")
    spent = paid.select("to_address", "tx_hash", *([] if once else ["id"])).distinct().join(P.receipts(spark, sf_dir), "tx_hash").withColumn("fee", gas_fee("gas_used", "effective_gas_price", "gas_price"))
    return kept.join(spent.groupBy("to_address").agg(F.sum("fee").alias("gas")), "to_address", "full_outer")


def _economics_sql(distinct: str) -> str:
    usd, part_of = "CAST(coalesce(v.amount_usd, 0) AS DECIMAL(24,12))", "CAST(CAST({} AS DECIMAL(12,0)) / 1000000 AS DECIMAL(7,6))"
    return "WITH " + _EV_AS_OF + f""", win AS (SELECT * FROM ev WHERE is_canonical AND event_name IN ('WinningTicketRedeemed', 'Reward') AND block_timestamp >= DATE '2024-01-05' AND block_timestamp < DATE '2024-01-16'),
usd AS (SELECT to_address, sum({usd} * {part_of.format('w.share')}) FILTER (event_name = 'Reward') AS rewards_usd, sum({usd} * {part_of.format('1000000 - w.share')}) FILTER (event_name <> 'Reward') AS payouts_usd
  FROM tick w JOIN val v ON v.event_id = w.id AND v.asset = w.asset WHERE w.block_timestamp >= DATE '2024-01-05' AND w.block_timestamp < DATE '2024-01-16' GROUP BY 1),
spent AS (SELECT to_address, sum(CAST(r.gas_used AS DECIMAL(18,0)) * (CAST(coalesce(r.effective_gas_price, r.gas_price) AS DECIMAL(18,0)))) AS wei FROM ({distinct}) w JOIN rcpt r USING (tx_hash) GROUP BY 1)
SELECT coalesce(usd.to_address, spent.to_address) AS to_address, CAST(rewards_usd AS DOUBLE) AS rewards_usd, CAST(payouts_usd AS DOUBLE) AS payouts_usd, CAST(wei AS DOUBLE) / 1e18 AS gas FROM usd FULL JOIN spent ON usd.to_address = spent.to_address"""


@query(_economics_sql("SELECT to_address, tx_hash FROM win"))
def a20_net_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics(spark, sf_dir, "2024-01-05", "2024-01-15", False).selectExpr("to_address", *dbl("rewards_usd", "payouts_usd", "gas"))


@query(_economics_sql("SELECT DISTINCT to_address, tx_hash FROM win"))
def q9_net_economics_by_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics(spark, sf_dir, "2024-01-05", "2024-01-15", True).selectExpr("to_address", *dbl("rewards_usd", "payouts_usd", "gas"))


# --- rounds and the network -----------------------------------------------------------------------


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stake_rounds(spark, sf_dir).groupBy("round").agg(F.max("block_number").alias("last_block"), F.min("block_number").alias("first_block"), F.max("snapshot_at").alias("snapshot_at"), F.sum("total_stake").alias("stake"), F.count_if("is_active").alias("active"))


_RND = "rnd AS (SELECT round, max(block_number) AS last_block, min(block_number) AS first_block, max(snapshot_at) AS snapshot_at, sum(total_stake) AS stake, count(*) FILTER (is_active) AS active FROM stk GROUP BY round)\n"


@query("WITH " + _RND + "SELECT round, last_block, snapshot_at, CAST(stake AS DOUBLE) AS stake, active FROM rnd ORDER BY round DESC LIMIT 50")
def a14_k11_rounds_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(rounds(spark, sf_dir), [("round", True)], None, 50).selectExpr("round", "last_block", "snapshot_at", *dbl("stake"), "active")


@query("SELECT address, CAST(total_stake AS DOUBLE) AS total_stake FROM stk WHERE round = 30 ORDER BY total_stake DESC, address LIMIT 10")
def a15_round_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(P.stake_rounds(spark, sf_dir).where("round = 30"), [("total_stake", True), ("address", False)], None, 10).selectExpr("address", *dbl("total_stake"))


@query("WITH " + _RND + "SELECT r.round, p.round AS previous, CAST(r.stake - p.stake AS DOUBLE) AS delta, r.active - p.active AS active_delta FROM rnd r JOIN rnd p ON p.round = (SELECT max(round) FROM rnd x WHERE x.round < r.round)")
def a17_previous_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.orderBy("round")  # one row a round: a few thousand in all
    r = rounds(spark, sf_dir).withColumn("p", F.lag(F.struct("round", "stake", "active")).over(w)).where("p is not null")
    return r.selectExpr("round", "p.round as previous", "cast(stake - p.stake as double) as delta", "active - p.active as active_delta")


@query("WITH days AS (SELECT CAST(snapshot_at AS DATE) AS d, sum(total_stake) AS s FROM stk WHERE round <= 40 GROUP BY 1 ORDER BY 1 DESC LIMIT 30) SELECT CASE WHEN count(*) >= 30 THEN CAST(sum(s) AS DOUBLE) / count(*) END AS mean_stake, count(*) AS days FROM days")
def a16_trailing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the last 30 days with snapshots up to a round; null if there are fewer."""
    d = P.stake_rounds(spark, sf_dir).where("round <= 40").groupBy(F.to_date("snapshot_at").alias("d")).agg(F.sum("total_stake").alias("s")).orderBy(F.desc("d")).limit(30)
    return d.agg(F.count("*").alias("days"), F.sum("s").cast("double").alias("s")).selectExpr("case when days >= 30 then s / days end as mean_stake", "days")


@query("WITH " + _RND + ", win AS (SELECT round, first_block, (SELECT min(first_block) FROM rnd x WHERE x.round > r.round) - 1 AS end_block FROM rnd r) SELECT * FROM win")
def f19_w14_round_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a round: up to the first block of any later one, open at the end."""
    w = W.orderBy(F.desc("round")).rowsBetween(W.unboundedPreceding, -1)
    return rounds(spark, sf_dir).select("round", "first_block", (F.min("first_block").over(w) - 1).alias("end_block"))


@query("SELECT event_name, count(*) AS n FROM ev WHERE is_canonical AND block_number BETWEEN 100 AND 900 GROUP BY ROLLUP (event_name)")
def a18_round_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event in a window of blocks, and their total under a null name."""
    return P.protocol_events(spark, sf_dir).where("is_canonical and block_number between 100 and 900").rollup("event_name").agg(F.count("*").alias("n"))


@query("SELECT id, block_number, log_index FROM ev WHERE is_canonical AND block_number BETWEEN 100 AND 900 AND (block_number, log_index) < (700, 2) ORDER BY block_number DESC, log_index DESC LIMIT 25")
def k9_round_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).where("is_canonical and block_number between 100 and 900").select("id", "block_number", "log_index")
    return keyset_page(e, [("block_number", True), ("log_index", True)], (700, 2), 25)


@query("""SELECT (SELECT max(round) FROM stk) AS round, (SELECT count(DISTINCT address) FROM stk) AS orchestrators, (SELECT count(*) FROM stk WHERE round = (SELECT max(round) FROM stk) AND is_active) AS active,
  (SELECT CAST(sum(total_stake) AS DOUBLE) FROM stk WHERE round = (SELECT max(round) FROM stk)) AS stake, (SELECT count(DISTINCT from_address) FROM ev WHERE event_name = 'WinningTicketRedeemed' AND is_canonical) AS gateways,
  (SELECT count(*) FROM ev WHERE is_canonical AND block_timestamp >= TIMESTAMP '2024-01-19 12:00:00' AND block_timestamp < TIMESTAMP '2024-01-20 12:00:00') AS events_24h,
  (SELECT CAST(coalesce(sum(v.amount_usd), 0) AS DOUBLE) FROM ev e JOIN val v ON v.event_id = e.id WHERE e.is_canonical AND e.finality = 'finalized' AND CAST(e.block_timestamp AS DATE) BETWEEN DATE '2024-01-19' AND DATE '2024-01-20') AS usd_24h""")  # fmt: skip
def a19_network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of one moment, 2024-01-20 12:00; dollars go by days, events by hours."""
    s, e = P.stake_rounds(spark, sf_dir), P.protocol_events(spark, sf_dir).where("is_canonical")
    last = latest_by(s.groupBy("round").agg(F.count_if("is_active").alias("active"), F.sum("total_stake").alias("stake")).withColumn("one", F.lit(1)), ["one"], ["round"]).drop("one")
    usd = valued(e.where("finality = 'finalized' and to_date(block_timestamp) between '2024-01-19' and '2024-01-20'"), P.valuations(spark, sf_dir)).agg(F.coalesce(F.sum("amount_usd"), F.lit(0)).cast("double").alias("usd_24h"))
    one = e.agg(F.countDistinct(F.when(F.col("event_name") == "WinningTicketRedeemed", F.col("from_address"))).alias("gateways"), F.count_if((F.col("block_timestamp") >= F.lit("2024-01-19 12:00:00").cast("timestamp_ntz")) & (F.col("block_timestamp") < F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))).alias("events_24h"))
    # four rows of one aggregate each
    out = last.crossJoin(s.agg(F.countDistinct("address").alias("orchestrators"))).crossJoin(one).crossJoin(usd)
    return out.selectExpr("round", "orchestrators", "active", *dbl("stake"), "gateways", "events_24h", "usd_24h")


_STATS = "WITH " + _REW + ", " + _REPLAY + """, g AS (SELECT delegator, min(event_id) FILTER (registers) AS f, max_by(balance, event_id) AS balance FROM r5 GROUP BY 1),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator, delegate ORDER BY block_number DESC) AS m FROM srow) WHERE m = 1),
prof AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY round DESC) AS n FROM stk) WHERE n = 1),
head AS (SELECT * FROM stk WHERE round = (SELECT max(round) FROM stk) ORDER BY address LIMIT 1)
SELECT '42161' AS chain_id, (SELECT round FROM head) AS latest_round, (SELECT block_number FROM head) AS round_block, (SELECT snapshot_at FROM head) AS round_at, (SELECT count(*) FROM prof WHERE is_active) AS active_orchestrators,
  (SELECT CAST(sum(total_stake) AS DOUBLE) FROM prof) AS total_stake, (SELECT count(DISTINCT gateway) FROM bal) AS gateways_known,
  (SELECT CAST(CAST(coalesce(sum(commission_usd), 0) AS DECIMAL(38,18)) AS DOUBLE) FROM pay WHERE day BETWEEN DATE '2024-01-19' AND DATE '2024-01-20') AS payouts_usd_24h, (SELECT CAST(CAST(coalesce(sum(own_usd), 0) AS DECIMAL(38,18)) AS DOUBLE) FROM rew WHERE day BETWEEN DATE '2024-01-19' AND DATE '2024-01-20') AS rewards_usd_24h,
  (SELECT coalesce(CAST(sum(CAST(gas_used AS DECIMAL(18,0)) * CAST(coalesce(effective_gas_price, gas_price) AS DECIMAL(18,0))) AS DOUBLE), 0) / 1e18 FROM rcpt WHERE tx_hash IN (SELECT tx_hash FROM ev WHERE block_timestamp >= TIMESTAMP '2024-01-19 12:00:00' AND block_timestamp < TIMESTAMP '2024-01-20 12:00:00')) AS gas_eth_24h,
  (SELECT max(snapshot_at) FROM prof) AS orchestrators_at, (SELECT max(observed_at) FROM bal) AS gateways_at, (SELECT count(*) FROM g WHERE f IS NOT NULL AND balance > 0) AS active_delegators, (SELECT count(*) FROM pairs WHERE balance > 0) AS total_delegations"""


@query(_STATS)
def a19_network_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalars of the network at 2024-01-20 12:00: the last round, profiles, a day's dollars from the cubes (all versions), a day's gas, delegations as pairs."""
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    s = P.stake_rounds(spark, sf_dir)
    head = s.agg(F.max(F.struct("round")).alias("m")).select("m.round").join(s, "round").agg(F.min(F.struct("address", "round", "block_number", "snapshot_at")).alias("m")).select(F.lit("42161").alias("chain_id"), F.col("m.round").alias("latest_round"), F.col("m.block_number").alias("round_block"), F.col("m.snapshot_at").alias("round_at"))
    profiles = latest_by(s, ["address"], ["round"]).agg(F.count_if("is_active").alias("active_orchestrators"), F.sum("total_stake").cast("double").alias("total_stake"), F.max("snapshot_at").alias("orchestrators_at"))
    gateways = P.gateway_balances(spark, sf_dir).agg(F.countDistinct("gateway").alias("gateways_known"), F.max("observed_at").alias("gateways_at"))
    day = F.col("day").between("2024-01-19", "2024-01-20")
    usd = lambda name, c: cube(spark, sf_dir, name).where(day).agg(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,18)").cast("double").alias(f"{name}_usd_24h"))
    recent = P.protocol_events(spark, sf_dir).where((F.col("block_timestamp") >= now - F.expr("interval 24 hours")) & (F.col("block_timestamp") < now)).select("tx_hash").distinct()
    gas = P.receipts(spark, sf_dir).join(recent, "tx_hash", "left_semi").agg(F.coalesce(F.sum(gas_fee("gas_used", "effective_gas_price", "gas_price")), F.lit(0)).cast("double").alias("gas_eth_24h"))
    active = registry(P.stake_events(spark, sf_dir)).agg(F.count_if("is_active").alias("active_delegators"))
    pairs = latest_by(stake(spark, sf_dir), ["delegator", "delegate"], ["block_number"]).agg(F.count_if(F.col("balance") > 0).alias("total_delegations"))
    out = head
    for one in (profiles, gateways, usd("payouts", "commission_usd"), usd("rewards", "own_usd"), gas, active, pairs):
        out = out.crossJoin(one)  # one row each
    return out


# --- governance -----------------------------------------------------------------------------------


def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.votes(spark, sf_dir).selectExpr("get_json_object(decoded, '$.proposalId') as proposal_id", "get_json_object(decoded, '$.support') as support", "try_cast(get_json_object(decoded, '$.weight') as decimal(38,0)) as weight")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("support") == s, F.col("weight"))), F.lit(0)).cast("bigint")
    return v.groupBy("proposal_id").agg(side("0").alias("against"), side("1").alias("for_votes"), side("2").alias("abstain"), F.count("*").alias("votes"))


@query("SELECT p.proposal_id, p.proposer, p.proposed_at, p.executed_block, coalesce(CAST(sum(weight) FILTER (support = 0) AS BIGINT), 0) AS against, coalesce(CAST(sum(weight) FILTER (support = 1) AS BIGINT), 0) AS for_votes, coalesce(CAST(sum(weight) FILTER (support = 2) AS BIGINT), 0) AS abstain, count(v.voter) AS votes FROM prop p LEFT JOIN vote v USING (proposal_id) GROUP BY ALL")
def j15_a13_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = P.proposals(spark, sf_dir).join(tallies(spark, sf_dir), "proposal_id", "left")
    return j.select("proposal_id", "proposer", "proposed_at", "executed_block", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("against", "for_votes", "abstain", "votes")])


@query("SELECT proposal_id FROM prop WHERE executed_block IS NULL")
def e_proposals_not_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proposals(spark, sf_dir).where("executed_block is null").select("proposal_id")


@query("SELECT proposal_id, voter, block_number, log_index FROM vote WHERE voter = 'g5' ORDER BY block_number DESC, log_index DESC, l_partkey, l_suppkey LIMIT 21")
def k10_votes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row more than a page, which tells whether there is another."""
    v = P.votes(spark, sf_dir).where("voter = 'g5'").withColumn("proposal_id", F.get_json_object("decoded", "$.proposalId"))
    return keyset_page(v, [("block_number", True), ("log_index", True), ("l_partkey", False), ("l_suppkey", False)], None, 21).select("proposal_id", "voter", "block_number", "log_index")


# --- prices ---------------------------------------------------------------------------------------


@query("SELECT block_number, min(source) AS source, CAST(min_by(price, source) AS DOUBLE) AS price FROM price WHERE asset = 'ETH' AND quote = 'USD' GROUP BY block_number")
def k14_price_at_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each block the price of the first source by name."""
    p = P.prices(spark, sf_dir).where("asset = 'ETH' and quote = 'USD'").groupBy("block_number").agg(F.min(F.struct("source", "price")).alias("m"))
    return p.selectExpr("block_number", "m.source", "cast(m.price as double) as price")


@query("SELECT block_number, source, CAST(price AS DOUBLE) AS price FROM price WHERE block_number BETWEEN 50 AND 250 ORDER BY block_number, source LIMIT 1000")
def k13_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(P.prices(spark, sf_dir).where("block_number between 50 and 250"), [("block_number", False), ("source", False)], None, 1000).selectExpr("block_number", "source", *dbl("price"))


@query("SELECT block_number, source, CAST(price AS DOUBLE) AS price FROM price ORDER BY block_number DESC, source LIMIT 1")
def w10_latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(P.prices(spark, sf_dir), [("block_number", True), ("source", False)], None, 1).selectExpr("block_number", "source", *dbl("price"))


@query("SELECT day, CAST(sum(face_usd) AS DOUBLE) AS usd, CAST(sum(payouts) AS BIGINT) AS payouts FROM (SELECT CAST(e.block_timestamp AS DATE) AS day, sum(coalesce(v.amount_usd, 0)) AS face_usd, count(*) AS payouts FROM ev e JOIN val v ON v.event_id = e.id WHERE event_name = 'WinningTicketRedeemed' AND is_canonical AND finality = 'finalized' AND to_address = 'o3' GROUP BY 1) GROUP BY 1")
def a30_daily_ticket_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir, "payouts").where("orchestrator = 'o3'").groupBy("day").agg(F.sum("face_usd").cast("double").alias("usd"), F.sum("payouts").alias("payouts"))


@query("SELECT from_address AS gateway, CAST(sum(v.amount_usd) AS DOUBLE) AS usd FROM ev e JOIN val v ON v.event_id = e.id AND v.valuation_version = 'v1' WHERE event_name = 'WinningTicketRedeemed' AND is_canonical AND to_address = 'o3' AND v.amount_usd IS NOT NULL GROUP BY 1 ORDER BY sum(v.amount_usd) DESC, 1 LIMIT 10")
def a31_top_gateways(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir).where("event_name = 'WinningTicketRedeemed' and is_canonical and to_address = 'o3'")
    g = valued(e, P.valuations(spark, sf_dir).where("valuation_version = 'v1' and amount_usd is not null")).groupBy(F.col("from_address").alias("gateway")).agg(F.sum("amount_usd").alias("usd"))
    return keyset_page(g, [("usd", True), ("gateway", False)], None, 10).selectExpr("gateway", *dbl("usd"))
