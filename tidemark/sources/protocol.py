"""The protocol's tables as projections of the given ones.

Every table is a pure function of the input files. Money enters decimal space at two decimals and
stays exact. The same projections are written as SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V1, DEGRADED = "v1", "v1_degraded"
ZERO = "0x0000000000000000000000000000000000000000"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def protocol_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one row per (block_number, log_index), ids in the order of ingestion."""
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id as id", "event_id div 4 as block_number", "cast(event_id % 4 as int) as log_index", "ts as block_timestamp", "concat('t', event_id div 2) as tx_hash",
        "concat('h', event_id div 4) as block_hash", "user_id", "cast(get_json_object(props, '$.k') as int) as k",
        "case event_type when 'purchase' then 'WinningTicketRedeemed' when 'click' then 'Reward' when 'signup' then 'Bond' when 'error' then 'Unbond' else 'TranscoderUpdate' end as event_name",
        "case when event_type = 'purchase' then 'TicketBroker' else 'BondingManager' end as contract_name",
        "concat('g', user_id) as from_address", "concat('o', cast(get_json_object(props, '$.k') as int) % 20) as to_address",
        "case event_type when 'purchase' then 'ETH' when 'view' then null else 'LPT' end as asset",
        "case when event_type <> 'view' then cast(cast(value as decimal(12,2)) as decimal(24,18)) end as amount_normalized",
        "event_type <> 'view' as is_valuable", "cast(get_json_object(props, '$.k') as int) % 50 <> 0 as is_canonical",
        "case when event_type = 'view' then cast(get_json_object(props, '$.k') as int) * 10000 end as fee_share",
        "case when ts < timestamp_ntz '2024-01-25' then 'finalized' when ts < timestamp_ntz '2024-01-28' then 'l1_posted' else 'tentative' end as finality",
        "case when ts < timestamp_ntz '2024-01-25' then ts + interval 20 minutes end as finalized_at",
    )


def broker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticket broker's events: kinds spread by k over payouts, deposits and withdrawals; only tickets and claims have a recipient, and not all of them."""
    return protocol_events(spark, sf_dir).where("event_name in ('WinningTicketRedeemed', 'Bond', 'Unbond')").selectExpr(
        "id", "block_number", "log_index", "block_timestamp",
        "case event_name when 'Bond' then if(k % 2 = 0, 'DepositFunded', 'ReserveFunded') when 'Unbond' then case k % 3 when 0 then 'Withdrawal' when 1 then 'Unlock' else 'UnlockCancelled' end else case k % 4 when 0 then 'WinningTicketTransfer' when 1 then 'ReserveClaimed' else 'WinningTicketRedeemed' end end as event_name",
        "from_address", "case when event_name = 'WinningTicketRedeemed' and k % 9 <> 0 then to_address end as to_address", "asset", "amount_normalized", "is_canonical", "finality",
    )


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of valuable events by (event_id, valuation_version, asset); two versions for every tenth."""
    e = protocol_events(spark, sf_dir).where("is_valuable").withColumn("valuation_version", F.explode(F.expr(f"if(k % 10 = 0, array('{V1}', '{DEGRADED}'), array('{V1}'))")))
    price = "case when k % 17 <> 0 then cast(2 + cast(dayofmonth(block_timestamp) as decimal(4,2)) / 100 as decimal(12,2)) end"
    return e.withColumn("native_usd_price", F.expr(price)).select(
        F.col("id").alias("event_id"), "valuation_version", "asset", "block_number", "native_usd_price",
        F.expr("cast(amount_normalized * native_usd_price as decimal(38,18))").alias("amount_usd"),
        F.expr("case when k % 17 = 0 then 'failed_missing_oracle' else 'priced' end").alias("status"), "tx_hash", "block_timestamp",
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by (asset, quote, block_number, source): two sources for every fifth block."""
    b = _read(spark, sf_dir, "events").groupBy(F.expr("event_id div 4").alias("block_number")).agg(F.min("ts").alias("block_timestamp"))
    b = b.withColumn("source", F.explode(F.expr("if(block_number % 5 = 0, array('chainlink', 'uniswap_v3_twap_30min'), array('chainlink'))")))
    return b.selectExpr("'ETH' as asset", "'USD' as quote", "block_number", "source", "block_timestamp", "cast(2 + cast(dayofmonth(block_timestamp) as decimal(4,2)) / 100 + if(source = 'chainlink', 0, 1) as decimal(12,2)) as price")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted historical prices of every third event."""
    return protocol_events(spark, sf_dir).where("k % 3 = 0 and asset is not null").selectExpr("id as event_id", "asset", "cast(1.5 as decimal(12,2)) as asset_usd_price")


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of gateways: those that are not listed transcode."""
    return _read(spark, sf_dir, "events").where("user_id % 7 = 0").select(F.concat(F.lit("g"), "user_id").alias("gateway"), F.lit("ai").alias("kind")).distinct()


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of orchestrators, and names that override them for even ones."""
    return _read(spark, sf_dir, "supplier").selectExpr("concat('o', s_suppkey) as address", "s_name as ens_name", "case when s_suppkey % 2 = 0 then concat('the ', s_name) end as override_name")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts by transaction: gas used and prices, the effective one missing from every third."""
    l = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("used"), F.max("l_suppkey").alias("price"))
    return l.selectExpr("concat('t', l_orderkey) as tx_hash", "cast(used + 21000 as decimal(20,0)) as gas_used", "case when l_orderkey % 3 <> 0 then cast(price + 1 as decimal(20,0)) * 1000000000 end as effective_gas_price", "cast(price + 2 as decimal(20,0)) * 1000000000 as gas_price")


def stake_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of orchestrators by round: months since 1995-01 are the rounds."""
    o = _read(spark, sf_dir, "orders").selectExpr("concat('o', o_custkey % 50) as address", "cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as int) as round", "cast(o_totalprice as decimal(12,2)) as v", "o_orderdate", "o_orderkey")
    return o.groupBy("address", "round").agg(F.expr("cast(sum(v) as decimal(38,18))").alias("total_stake"), F.max("o_orderdate").alias("snapshot_at"), F.max("o_orderkey").alias("block_number"), F.expr("count(*) % 3 <> 0").alias("is_active"), F.expr("cast(max(o_orderkey) % 1000000 as string)").alias("raw_reward_cut"), F.expr("cast(min(o_orderkey) % 1000000 as string)").alias("raw_fee_share"))


def gateway_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits of gateways by block."""
    return _read(spark, sf_dir, "orders").selectExpr("concat('g', o_custkey) as gateway", "o_orderkey as block_number", "cast(cast(o_totalprice as decimal(12,2)) as decimal(38,18)) as deposit", "cast(cast(o_totalprice as decimal(12,2)) / 4 as decimal(38,18)) as reserve", "o_orderdate as observed_at")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance proposals: executed ones carry the block of their execution."""
    return _read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as proposal_id", "o_orderkey as block_number", "concat('o', o_custkey % 50) as proposer", "o_orderdate as proposed_at", "case when o_orderstatus = 'F' then o_orderkey + 7 end as executed_block")


def governance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created and executed proposals as raw events; a proposal's id and proposer are in their JSON."""
    o = _read(spark, sf_dir, "orders")
    raw = "to_json(named_struct('decoded', named_struct('proposalId', cast(o_orderkey as string){}))) as raw_event"
    made = o.selectExpr("o_orderkey as block_number", "0 as log_index", "'ProposalCreated' as event_name", "true as is_canonical", raw.format(", 'proposer', concat('o', o_custkey % 50)"))
    done = o.where("o_orderstatus = 'F'").selectExpr("o_orderkey + 7 as block_number", "0 as log_index", "'ProposalExecuted' as event_name", "true as is_canonical", raw.format(""))
    return made.unionByName(done)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as raw events: support is a JSON number, weight a string."""
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as block_number", "l_linenumber as log_index", "concat('g', l_partkey % 100) as voter",
        "to_json(named_struct('proposalId', cast(l_orderkey as string), 'support', l_linenumber % 3, 'weight', cast(cast(l_quantity as int) as string))) as decoded", "l_partkey", "l_suppkey",
    )


def stake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonding events with their kinds spread by k, rewards of claims in wei as strings."""
    return protocol_events(spark, sf_dir).where("contract_name = 'BondingManager' and is_canonical").selectExpr(
        "id as event_id", "block_number", "log_index", "block_timestamp",
        "case event_name when 'Bond' then 'Bond' when 'Unbond' then if(k % 4 = 0, 'WithdrawStake', 'Unbond') when 'TranscoderUpdate' then 'EarningsClaimed' else if(k % 2 = 0, 'Rebond', 'TransferBond') end as event_name",
        "concat('d', user_id % 40) as from_address", "case when k % 9 = 0 then null else concat('d', k % 40) end as to_address",
        "case when k % 11 <> 0 then amount_normalized end as amount_normalized", "case when event_name = 'TranscoderUpdate' then concat(k, '000000000000000') end as rewards",
    )
