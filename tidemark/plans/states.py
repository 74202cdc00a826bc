"""What the contracts' own state tells at a block: gateways, claimants, pending stake, cuts; and profiles that are refreshed.

Answers to calls lie in the memo. Where the given tables have none, the queries derive them from events and orders, some of them missing or
broken, so that every outcome occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.abi import encoded
from tidemark.functions.money import inverse_percent, percent, wei
from tidemark.operators.core import latest_by
from tidemark.operators.reads import Call, answered, hash_of
from tidemark.plans.entities import TOUCHES, _FLOWS, flow_events, gateway_profiles
from tidemark.plans.registry import dbl, query
from tidemark.plans.stake import _REPLAY, stake
from tidemark.sources import commits
from tidemark.sources import protocol as P
from tidemark.sources.cubes import refreshed
from tidemark.sources.storage import shared_path

#: Names of the contracts that are asked.
BROKER, BONDING = "broker", "bonding"
#: What the contracts' views are asked, and what they return, in order.
SENDER = Call("sender", "aabbcc01", (("address", "gateway_hex"),), (("deposit", "uint256"), ("withdraw_round", "uint256"), ("reserve", "uint256"), ("claimed_in_round", "uint256")))
UNLOCK = Call("unlock", "aabbcc02", (("address", "gateway_hex"),), (("in_progress", "bool"),))
CLAIMABLE = Call("claimable", "aabbcc03", (("address", "gateway_hex"), ("address", "claimant_hex")), (("amount", "uint256"),))
CLAIMED = Call("claimed", "aabbcc04", (("address", "gateway_hex"), ("address", "claimant_hex")), (("amount", "uint256"),))
PENDING_STAKE = Call("pending_stake", "aabbcc05", (("address", "delegator_hex"), ("uint256", "end_round")), (("amount", "uint256"),))
PENDING_FEES = Call("pending_fees", "aabbcc06", (("address", "delegator_hex"), ("uint256", "end_round")), (("amount", "uint256"),))
TRANSCODER = Call("transcoder", "aabbcc07", (("address", "address_hex"),), (("last_reward_round", "uint256"), ("reward_cut", "uint256"), ("fee_share", "uint256")))
#: The largest round that a table holds; the contracts' own infinity is beyond it.
MOST = 2**63 - 1


def address(of: str) -> str:
    """SQL of twenty bytes for a name, as the tables' names are no addresses."""
    return f"concat('0x', left(sha2({of}, 256), 40))"


def memo_of(rows: DataFrame, call: Call, contract: str, returns: list[str], broken: str = "false", told: str = "_r") -> DataFrame:
    """Answers (call_hash, response) that return some SQL of each row, of rows that each ask something else; where ``broken`` the last word is cut short.

    ``told`` is SQL of what is told instead of the encoded answer ``_r``.
    """
    kinds = [k for _, k in call.gives]
    made = rows.select(hash_of(call, contract).alias("call_hash"), F.concat(F.lit("0x"), encoded(kinds, returns)).alias("_r"), F.expr(broken).alias("_broken"), "*")
    made = made.selectExpr("call_hash", f"{told} as _r", "_broken").selectExpr("call_hash", "if(_broken, left(_r, length(_r) - 8), _r) as response")
    # an array of one: what a join asks of hashes stays above it, else each memo would hash at the scan and read its rows for itself
    return made.select(F.inline(F.array(F.struct("call_hash", "response"))))


def gateway_states(touches: DataFrame, memo: DataFrame) -> DataFrame:
    """Deposit, reserve, what is claimed of it in the round, the round of withdrawal and whether an unlock goes on, of each touch (gateway, gateway_hex, block_number) whose calls are both answered."""
    a = answered(touches, [SENDER, UNLOCK], BROKER, memo).where("missing = '' and unfit = ''")
    amount = lambda c: wei(f"sender.{c}")
    return a.select("gateway", "block_number", amount("deposit").alias("deposit"), amount("reserve").alias("reserve"), amount("claimed_in_round").alias("claimed_in_round"), F.expr(f"coalesce(try_cast(sender.withdraw_round as bigint), {MOST}L)").alias("withdraw_round"), (F.col("unlock.in_progress") == "true").alias("unlock_in_progress"))


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last touch of each gateway and block. Block and log index tell the id, so it has no ties; the id is asked for by all readers, who so share one shuffle."""
    e = P.broker_events(spark, sf_dir).where("is_canonical and from_address is not null").where(F.col("event_name").isin(*TOUCHES))
    last = e.groupBy(F.col("from_address").alias("gateway"), "block_number").agg(F.max_by("id", "log_index").alias("id")).where("id is not null")
    return last.withColumn("gateway_hex", F.expr(address("gateway")))


@query("""SELECT from_address AS gateway, block_number, CAST(block_number % 9000 AS DOUBLE) / 1000 AS deposit, CAST(id % 9000 AS DOUBLE) / 1000 AS reserve, CAST(id % 7 AS DOUBLE) / 1000 AS claimed_in_round,
  CASE WHEN id % 5 = 0 THEN 9223372036854775807 ELSE id % 1000 END AS withdraw_round, id % 4 = 0 AS unlock_in_progress
FROM (SELECT *, row_number() OVER (PARTITION BY from_address, block_number ORDER BY log_index DESC) AS n FROM bev WHERE is_canonical) WHERE n = 1 AND id % 9 <> 3 AND id % 11 <> 6""")
def p12_gateway_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all touched gateways; some calls have no answer, some a broken one."""
    t = _touches(spark, sf_dir)
    milli = lambda c: f"cast({c} as bigint) * 1000000000000000"
    # where an answer is infinite, the word is written by hand, as it is wider than a number
    endless = "if(id % 5 = 0, concat(left(_r, 66), repeat('f', 64), substring(_r, 131)), _r)"
    sender = memo_of(t.where("id % 9 <> 3"), SENDER, BROKER, [milli("block_number % 9000"), "id % 1000", milli("id % 9000"), milli("id % 7")], "id % 11 = 6", endless)
    unlock = memo_of(t, UNLOCK, BROKER, ["id % 4 = 0"])
    return gateway_states(t, sender.unionByName(unlock)).selectExpr("gateway", "block_number", *dbl("deposit", "reserve", "claimed_in_round"), "withdraw_round", "unlock_in_progress")


def claimant_states(claims: DataFrame, memo: DataFrame) -> DataFrame:
    """Claimable and claimed reserve of each (gateway, claimant, block_number) whose calls are both answered."""
    a = answered(claims, [CLAIMABLE, CLAIMED], BROKER, memo).where("missing = '' and unfit = ''")
    return a.select("gateway", "claimant", "block_number", wei("claimable.amount").alias("claimable"), wei("claimed.amount").alias("claimed"))


@query("WITH " + _FLOWS + """SELECT DISTINCT gateway, claimant, block_number, CAST(block_number % 900 AS DOUBLE) / 100 AS claimable, CAST(block_number % 13 AS DOUBLE) / 100 AS claimed FROM flow WHERE claimant IS NOT NULL AND block_number % 6 <> 1""")
def p13_claimant_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserves of all pairs of a gateway and a claimant at the blocks of their claims; every sixth block has no answer."""
    c = flow_events(spark, sf_dir).where("claimant is not null").select(F.col("from_address").alias("gateway"), "claimant", "block_number").distinct()
    c = c.withColumn("gateway_hex", F.expr(address("gateway"))).withColumn("claimant_hex", F.expr(address("claimant")))
    known = c.where("block_number % 6 <> 1")
    memo = memo_of(known, CLAIMABLE, BROKER, ["(block_number % 900) * 10000000000000000"]).unionByName(memo_of(known, CLAIMED, BROKER, ["(block_number % 13) * 10000000000000000"]))
    return claimant_states(c, memo).selectExpr("gateway", "claimant", "block_number", *dbl("claimable", "claimed"))


def pending(rows: DataFrame, claims: DataFrame, memo: DataFrame) -> DataFrame:
    """Stake rows with the pending stake and fees that the contract told at a claim in their block; rows without a claim that is answered stay as they are.

    ``claims`` are (delegator, delegator_hex, block_number, end_round); of two claims in a block the later round counts.
    """
    a = answered(claims, [PENDING_STAKE, PENDING_FEES], BONDING, memo).where("missing = '' and unfit = ''")
    told = a.select("delegator", "block_number", F.col("end_round").alias("pending_round"), wei("pending_stake.amount").alias("pending_stake"), wei("pending_fees.amount").alias("pending_fees"))
    told = latest_by(told, ["delegator", "block_number"], ["pending_round"])
    j = rows.join(told, ["delegator", "block_number"], "left")
    return j.withColumn("source", F.when(F.col("pending_round").isNotNull(), "both").otherwise(F.col("source")))


@query("WITH " + _REPLAY + """, claims AS (SELECT from_address AS delegator, block_number, max(rewards) AS end_round FROM sev WHERE event_name = 'EarningsClaimed' AND rewards % 8 <> 5 GROUP BY 1, 2)
SELECT delegator, block_number, CAST(balance AS DOUBLE) AS balance, CAST(end_round AS BIGINT) AS pending_round, CAST(end_round + 1 AS DOUBLE) / 100 AS pending_stake, CAST(end_round % 7 AS DOUBLE) / 100 AS pending_fees, CASE WHEN end_round IS NOT NULL THEN 'both' ELSE source END AS source
FROM srow LEFT JOIN claims USING (delegator, block_number)""")  # fmt: skip
def p9_pending_stake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stake with what is pending at the claims of its block; some calls have no answer."""
    e = P.stake_events(spark, sf_dir).where("event_name = 'EarningsClaimed'")
    c = e.selectExpr("from_address as delegator", "block_number", "cast(cast(rewards as decimal(38,0)) / cast(1e15 as decimal(20,0)) as bigint) as end_round", f"{address('from_address')} as delegator_hex").distinct()
    known = c.where("end_round % 8 <> 5")
    memo = memo_of(known, PENDING_STAKE, BONDING, ["(end_round + 1) * 10000000000000000"]).unionByName(memo_of(known, PENDING_FEES, BONDING, ["(end_round % 7) * 10000000000000000"]))
    return pending(stake(spark, sf_dir), c, memo).selectExpr("delegator", "block_number", *dbl("balance"), "pending_round", *dbl("pending_stake", "pending_fees"), "source")


#: Cuts that a row of a round has, as percentages.
CUTS = ("reward_cut", "fee_share", "fee_cut")


def cuts_told(rows: DataFrame, memo: DataFrame) -> DataFrame:
    """Rows (address, address_hex, round, block_number, CUTS) with what the contract tells of their cuts and what became of them.

    ``outcome`` is error without an answer, skipped where the contract knows of no reward ever, unchanged or changed; new cuts are there for the last two alone.
    """
    a = answered(rows, [TRANSCODER], BONDING, memo)
    new = {"reward_cut": percent("transcoder.reward_cut"), "fee_share": percent("transcoder.fee_share"), "fee_cut": inverse_percent("transcoder.fee_share")}
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(new[c]) for c in CUTS])
    outcome = F.when(F.col("transcoder").isNull(), "error").when(F.col("transcoder.last_reward_round") == "0", "skipped").when(same, "unchanged").otherwise("changed")
    a = a.withColumn("outcome", outcome)
    told = F.col("outcome").isin("changed", "unchanged")
    return a.select("address", "round", "block_number", "outcome", *[F.col(c).alias(f"old_{c}") for c in CUTS], *[F.when(told, new[c]).alias(f"new_{c}") for c in CUTS])


def cuts_updated(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The rows with the cuts that have changed."""
    new = told.where("outcome = 'changed'").select("address", "round", *[f"new_{c}" for c in CUTS])
    j = rows.join(new, ["address", "round"], "left")
    return j.withColumns({c: F.coalesce(f"new_{c}", c) for c in CUTS}).drop(*[f"new_{c}" for c in CUTS])


def _cut_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.stake_rounds(spark, sf_dir).withColumn("address_hex", F.expr(address("address")))
    return s.select("address", "address_hex", "round", "block_number", percent("raw_reward_cut").alias("reward_cut"), percent("raw_fee_share").alias("fee_share"), inverse_percent("raw_fee_share").alias("fee_cut"), "raw_reward_cut", "raw_fee_share")


def _cut_memo(rows: DataFrame) -> DataFrame:
    known = rows.where("round % 7 <> 2")
    return memo_of(known, TRANSCODER, BONDING, ["if(round <= 3, 0, round)", "cast(raw_reward_cut as bigint) + if(round % 6 = 1, 1, 0)", "cast(raw_fee_share as bigint) + if(round % 6 = 4, 25, 0)"]).distinct()  # orders of one key can end two rounds in one block


_CUTS = """c AS (SELECT *, CASE WHEN round % 7 = 2 THEN 'error' WHEN round <= 3 THEN 'skipped' WHEN round % 6 IN (1, 4) THEN 'changed' ELSE 'unchanged' END AS outcome,
  raw_reward_cut + CASE WHEN round % 6 = 1 THEN 1 ELSE 0 END AS r, raw_fee_share + CASE WHEN round % 6 = 4 THEN 25 ELSE 0 END AS f FROM stk)
"""


@query("WITH " + _CUTS + """SELECT address, round, block_number, outcome, raw_reward_cut / 10000.0::DOUBLE AS old_reward_cut, raw_fee_share / 10000.0::DOUBLE AS old_fee_share, (1000000 - raw_fee_share) / 10000.0::DOUBLE AS old_fee_cut,
  CASE WHEN outcome IN ('changed', 'unchanged') THEN r / 10000.0::DOUBLE END AS new_reward_cut, CASE WHEN outcome IN ('changed', 'unchanged') THEN f / 10000.0::DOUBLE END AS new_fee_share, CASE WHEN outcome IN ('changed', 'unchanged') THEN (1000000 - f) / 10000.0::DOUBLE END AS new_fee_cut FROM c""")  # fmt: skip
def p15_cuts_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of rounds against the contract's three cuts, and what became of each."""
    rows = _cut_rows(spark, sf_dir)
    return cuts_told(rows, _cut_memo(rows)).selectExpr("address", "round", "block_number", "outcome", *dbl(*[f"{w}_{c}" for w in ("old", "new") for c in CUTS]))


@query("WITH " + _CUTS + """SELECT address, round, CASE WHEN outcome = 'changed' THEN r ELSE raw_reward_cut END / 10000.0::DOUBLE AS reward_cut, CASE WHEN outcome = 'changed' THEN f ELSE raw_fee_share END / 10000.0::DOUBLE AS fee_share,
  (1000000 - CASE WHEN outcome = 'changed' THEN f ELSE raw_fee_share END) / 10000.0::DOUBLE AS fee_cut FROM c""")  # fmt: skip
def p15_cuts_after_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cut_rows(spark, sf_dir)
    return cuts_updated(rows, cuts_told(rows, _cut_memo(rows))).selectExpr("address", "round", *dbl(*CUTS))


@query("SELECT gateway, block_number, CAST(deposit AS DOUBLE) AS deposit, coalesce(kind, 'transcoding') AS kind FROM (SELECT *, row_number() OVER (PARTITION BY gateway ORDER BY block_number DESC) AS n FROM bal) LEFT JOIN cls USING (gateway) WHERE n = 1")
def s19_refreshed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles of gateways after balances came in two parts, the second one late for some: only gateways that it touches are derived again."""
    root, b = shared_path(spark, "profiles"), P.gateway_balances(spark, sf_dir)
    late = F.col("block_number") % 5 == 0
    refreshed(spark, root, "gateway", b.where(~late).select("gateway").distinct(), lambda keys: gateway_profiles(spark, sf_dir, keys, b.where(~late)))
    refreshed(spark, root, "gateway", b.where(late).select("gateway").distinct(), lambda keys: gateway_profiles(spark, sf_dir, keys, b))
    return commits.read(spark, root, "rows").selectExpr("gateway", "block_number", *dbl("deposit"), "kind")
