"""Lookups, snapshots and histories that the other modules leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.core import as_of_join, keyset_page, latest_by
from tidemark.plans.entities import flow_events, rounds, tallies
from tidemark.plans.registry import dbl, query
from tidemark.plans.rollups import _REW, AS_OF_BLOCKS, cube, final_events, valued
from tidemark.plans.stake import _REPLAY, current_stake, stake
from tidemark.sources import protocol as P


@query("WITH " + _REW + ", b AS (SELECT orchestrator, sum(total_usd) AS usd FROM rew WHERE valuation_version = 'v1' GROUP BY 1) SELECT orchestrator, CAST(usd AS DOUBLE) AS usd FROM b WHERE usd < 9000 OR (usd = 9000 AND orchestrator > 'o5') ORDER BY b.usd DESC, orchestrator LIMIT 7")
def k4_reward_leaderboard_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cube(spark, sf_dir, "rewards").where("valuation_version = 'v1'").groupBy("orchestrator").agg(F.sum("total_usd").alias("usd"))
    return keyset_page(b, [("usd", True), ("orchestrator", False)], (9000, "o5"), 7).selectExpr("orchestrator", *dbl("usd"))


@query("SELECT event_id, block_number, log_index, event_name FROM sev WHERE (from_address = 'd3' OR to_address = 'd3') AND event_name IN ('Bond', 'Unbond', 'TransferBond') AND (block_number, log_index) < (2000, 1) ORDER BY block_number DESC, log_index DESC LIMIT 40")
def k8_delegator_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.stake_events(spark, sf_dir).where("(from_address = 'd3' or to_address = 'd3') and event_name in ('Bond', 'Unbond', 'TransferBond')").select("event_id", "block_number", "log_index", "event_name")
    return keyset_page(e, [("block_number", True), ("log_index", True)], (2000, 1), 40)


@query("WITH " + _REPLAY + ", cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator ORDER BY block_number DESC) AS m FROM srow) WHERE m = 1) SELECT count(*) AS delegators, CAST(sum(CASE WHEN balance > 0 THEN balance ELSE 0 END) AS DOUBLE) AS principal, count(*) FILTER (balance > 0) AS delegations FROM cur")
def a21_delegator_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = current_stake(stake(spark, sf_dir))
    return c.agg(F.count("*").alias("delegators"), F.sum(F.greatest("balance", F.lit(0))).cast("double").alias("principal"), F.count_if(F.col("balance") > 0).alias("delegations"))


@query("SELECT p.proposal_id, p.proposer, t.yes, t.no FROM (SELECT * FROM prop ORDER BY block_number, proposer LIMIT 1) p CROSS JOIN (SELECT coalesce(CAST(sum(weight) FILTER (support = 1) AS BIGINT), 0) AS yes, coalesce(CAST(sum(weight) FILTER (support = 0) AS BIGINT), 0) AS no FROM vote WHERE proposal_id = (SELECT min_by(proposal_id, block_number) FROM prop)) t")
def j16_j17_proposal_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first proposal with its tally, zeros if nobody has voted."""
    p = keyset_page(P.proposals(spark, sf_dir), [("block_number", False), ("proposer", False)], None, 1)
    t = tallies(spark, sf_dir).join(F.broadcast(p.select("proposal_id")), "proposal_id", "left_semi").agg(F.coalesce(F.max("for_votes"), F.lit(0)).alias("yes"), F.coalesce(F.max("against"), F.lit(0)).alias("no"))
    return p.crossJoin(t).select("proposal_id", "proposer", "yes", "no")  # one row each


@query("SELECT s.round, CAST(coalesce(u.usd, 0) AS DOUBLE) AS usd FROM (SELECT round, CAST(DATE '2024-01-01' + CAST(round % 40 AS INTEGER) AS DATE) AS day FROM stk GROUP BY round) s LEFT JOIN (SELECT CAST(e.block_timestamp AS DATE) AS day, sum(v.amount_usd) AS usd FROM ev e JOIN val v ON v.event_id = e.id AND v.asset IS NOT DISTINCT FROM e.asset WHERE e.is_canonical AND e.finality = 'finalized' AND e.event_name = 'WinningTicketRedeemed' GROUP BY 1) u ON u.day = s.day")
def j22_j24_rounds_with_day_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars of the day of each round, over all versions, by one join to the days' totals."""
    usd = valued(final_events(spark, sf_dir).where("event_name = 'WinningTicketRedeemed'"), P.valuations(spark, sf_dir)).groupBy(F.to_date("block_timestamp").alias("day")).agg(F.sum("amount_usd").alias("usd"))
    r = rounds(spark, sf_dir).select("round", F.expr("date_add(date '2024-01-01', round % 40)").alias("day"))
    return r.join(usd, "day", "left").select("round", F.coalesce("usd", F.lit(0)).cast("double").alias("usd"))


@query("SELECT event_id, latest FROM (SELECT id AS event_id, block_number FROM ev WHERE event_name = 'Bond') b LEFT JOIN LATERAL (SELECT max(round) AS latest FROM (SELECT min(block_number) AS fb, round FROM stk GROUP BY round) r WHERE r.fb <= b.block_number) ON true")
def w12_round_at_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest round that had begun at the block of each bond: as of the block, dealt by ranges of blocks."""
    w = W.orderBy("block_number").rowsBetween(W.unboundedPreceding, 0)  # one row a round: a few thousand in all
    begun = rounds(spark, sf_dir).groupBy(F.col("first_block").alias("block_number")).agg(F.max("round").alias("round"))
    starts = begun.select(F.lit(1).alias("chain"), "block_number", F.max("round").over(w).alias("latest"))
    blocks = P.protocol_events(spark, sf_dir).where("event_name = 'Bond'").select(F.col("id").alias("event_id"), "block_number", F.lit(1).alias("chain"))
    return as_of_join(blocks, starts, ["chain"], ["block_number"], ["latest"], AS_OF_BLOCKS).select("event_id", "latest")


@query("SELECT address, round, raw_reward_cut + 1 AS new_cut FROM stk WHERE round % 6 = 1 AND round > 3")
def p15_cuts_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose cuts the chain's state changes; what was never rewarded stays."""
    s = P.stake_rounds(spark, sf_dir)
    state = s.selectExpr("address", "round", "cast(raw_reward_cut as bigint) + if(round % 6 = 1, 1, 0) as new_cut", "if(round <= 3, 0, round) as last_reward_round")
    j = s.join(state, ["address", "round"]).where("last_reward_round <> 0 and not (cast(raw_reward_cut as bigint) <=> new_cut)")
    return j.select("address", "round", "new_cut")


@query("SELECT gateway, claimant, block_number, CAST(amount AS DOUBLE) AS amount FROM (SELECT from_address AS gateway, to_address AS claimant, block_number, log_index, amount_normalized AS amount, row_number() OVER (PARTITION BY from_address, to_address ORDER BY block_number DESC, log_index DESC) AS n FROM bev WHERE event_name IN ('WinningTicketRedeemed', 'WinningTicketTransfer', 'ReserveClaimed') AND to_address IS NOT NULL AND is_canonical AND block_number <= 1700) WHERE n = 1")
def p13_w5_claimants_at_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flow_events(spark, sf_dir).where("claimant is not null and block_number <= 1700").select(F.col("from_address").alias("gateway"), "claimant", "block_number", "log_index", F.col("amount_normalized").alias("amount"))
    return latest_by(e, ["gateway", "claimant"], ["block_number", "log_index"]).selectExpr("gateway", "claimant", "block_number", *dbl("amount"))


@query("SELECT t.from_address AS gateway, t.block_number, CAST(b.deposit AS DOUBLE) AS deposit FROM (SELECT DISTINCT from_address, block_number FROM ev WHERE is_canonical AND event_name = 'WinningTicketRedeemed') t LEFT JOIN LATERAL (SELECT deposit FROM bal WHERE bal.gateway = t.from_address AND bal.block_number <= t.block_number ORDER BY bal.block_number DESC LIMIT 1) b ON true")
def p12_balance_at_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each touch of a gateway with the deposit that the chain's state had by its block."""
    t = P.protocol_events(spark, sf_dir).where("is_canonical and event_name = 'WinningTicketRedeemed'").select(F.col("from_address").alias("gateway"), "block_number").distinct()
    return as_of_join(t, P.gateway_balances(spark, sf_dir).select("gateway", "block_number", "deposit"), ["gateway"], ["block_number"], ["deposit"], AS_OF_BLOCKS).selectExpr("gateway", "block_number", *dbl("deposit"))


@query("SELECT contract_name AS name, greatest(max(block_number), 2000) AS last_block FROM ev GROUP BY 1")
def s17_monotone_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints never move back, whatever is written."""
    new = P.protocol_events(spark, sf_dir).groupBy(F.col("contract_name").alias("name")).agg(F.max("block_number").alias("block"))
    old = new.select("name", F.lit(2000).cast("bigint").alias("was"))
    return old.join(new, "name", "full_outer").select("name", F.greatest("was", "block").alias("last_block"))


@query("SELECT 'o' || s_suppkey AS address, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name FROM supplier")
def s25_names_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name counts only if it resolves to the address that it came from."""
    s = P._read(spark, sf_dir, "supplier")
    back = s.selectExpr("concat('o', s_suppkey) as address", "s_name as name")
    forward = s.selectExpr("s_name as name", "concat('o', if(s_suppkey % 4 = 0, s_suppkey + 1, s_suppkey)) as resolved")
    j = back.join(forward, "name", "left")
    return j.select("address", F.when(F.col("resolved") == F.col("address"), F.col("name")).alias("name"))


@query("SELECT id, tx_hash FROM ev WHERE tx_hash IN ('t3', 't17', 't99')")
def j19_lookup_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("select explode(array('t3', 't17', 't99')) as tx_hash")
    return P.protocol_events(spark, sf_dir).join(F.broadcast(wanted), "tx_hash", "left_semi").select("id", "tx_hash")


@query("SELECT id, k % 3 = 0 AS valid, CASE WHEN k % 3 = 0 THEN '0x' || repeat('a', 40) END AS address FROM ev")
def f6_f7_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in lower case if they are 0x and forty hexadecimal digits."""
    e = P.protocol_events(spark, sf_dir).selectExpr("id", "case k % 3 when 0 then concat('0x', repeat('A', 40)) when 1 then concat('0x', repeat('A', 39)) else 'none' end as raw")
    valid = F.lower("raw").rlike("^0x[0-9a-f]{40}$")
    return e.select("id", valid.alias("valid"), F.when(valid, F.lower("raw")).alias("address"))


@query("SELECT DISTINCT address, entity FROM (SELECT 'o' || (k % 20) AS address, 'orchestrator' AS entity FROM ev WHERE k % 20 < 3 UNION ALL SELECT 'g' || user_id, 'gateway' FROM ev WHERE user_id < 3)")
def p27_changed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses whose nodes a change log names: by equality of nodes, each once."""
    e = P.protocol_events(spark, sf_dir)
    nodes = e.selectExpr("to_address as address", "'orchestrator' as entity", "k % 20 as node").unionByName(e.selectExpr("from_address as address", "'gateway' as entity", "cast(user_id as int) as node"))
    changed = spark.range(3).select(F.col("id").cast("int").alias("node"))
    return nodes.join(F.broadcast(changed), "node", "left_semi").select("address", "entity").distinct()
