"""Stake replayed from bonding events by windows, and what delegators' snapshots answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.money import shifted
from tidemark.operators.core import keyset_page, latest_by
from tidemark.plans.registry import dbl, query
from tidemark.sources import protocol as P
from tidemark.sources.cubes import stored


def by_delegator(events: DataFrame) -> DataFrame:
    """One row per event and delegator it concerns: both sides of a transfer, once if they are one."""
    both = F.array_distinct(F.filter(F.array("from_address", "to_address"), lambda a: a.isNotNull()))
    who = F.when(F.col("event_name") == "TransferBond", both).otherwise(F.array("from_address"))
    return events.withColumn("delegator", F.explode(who)).withColumn("is_to", F.col("to_address").eqNullSafe(F.col("delegator"))).where("delegator is not null")


#: Blocks of one delegator's events that a task takes at most.
REPLAY_BLOCKS = 1_000_000

_DELTA = f"case when skipped then 0 when event_name in ('Bond', 'Rebond') then coalesce(amount_normalized, 0) when event_name = 'Unbond' then -coalesce(amount_normalized, 0) when event_name = 'EarningsClaimed' then coalesce({shifted('rewards')}, 0) else 0 end"


def _carried(df: DataFrame, **sums) -> DataFrame:
    """What the ranges before each (delegator, part) leave: one row a range, by a window over those."""
    before = W.partitionBy("delegator").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    one = df.groupBy("delegator", "part").agg(*[part.alias(n) for n, (part, _) in sums.items()])
    return one.select("delegator", "part", *[whole(n).over(before).alias(f"in_{n}") for n, (_, whole) in sums.items()])


def replayed(events: DataFrame, span: int = REPLAY_BLOCKS) -> DataFrame:
    """Balance and delegate after each event that counts, in (block_number, log_index) order.

    Events that take stake away, move or restore it before the delegator is registered are skipped. The
    running values are windows over ranges of ``span`` blocks, into which what earlier ranges leave is
    carried, so that one delegator with a large part of all events is the work of many tasks. Null amounts count as 0.
    """
    e = by_delegator(events).withColumn("part", F.floor(F.col("block_number") / span))
    e = e.withColumn("registers", F.expr("(event_name = 'Bond') or (event_name = 'TransferBond' and is_to)"))
    w = W.partitionBy("delegator", "part").orderBy("block_number", "log_index", "event_id")
    past, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    e = e.join(_carried(e, reg=(F.max("registers"), F.max)), ["delegator", "part"])
    e = e.withColumn("before", F.coalesce("in_reg", F.lit(False)) | F.coalesce(F.max("registers").over(past), F.lit(False)))
    e = e.withColumn("skipped", F.expr("not before and (event_name in ('Unbond', 'WithdrawStake', 'Rebond') or (event_name = 'TransferBond' and not is_to))"))
    e = e.withColumn("delta", F.expr(f"cast({_DELTA} as decimal(24,18))"))
    e = e.withColumn("points", F.expr("case when not skipped and event_name in ('Bond', 'Unbond', 'Rebond', 'EarningsClaimed') then to_address end"))
    newest = F.max(F.when(F.col("points").isNotNull(), F.struct("block_number", "log_index", "event_id", "points")))
    e = e.join(_carried(e, sum=(F.sum("delta"), F.sum), last=(newest, lambda n: F.last(n, ignorenulls=True))), ["delegator", "part"])
    e = e.withColumn("balance", F.coalesce("in_sum", F.lit(0)).cast("decimal(34,18)") + F.sum("delta").over(upto).cast("decimal(34,18)"))
    e = e.withColumn("delegate", F.coalesce(F.last("points", ignorenulls=True).over(upto), F.col("in_last.points"), F.lit(P.ZERO)))
    return e.withColumn("source", F.expr("if(event_name = 'EarningsClaimed' and not before, 'earnings_claimed_bootstrap', 'flow_derived')"))


def stake_rows(events: DataFrame, span: int = REPLAY_BLOCKS) -> DataFrame:
    """The state after the last event that counts of each delegator and block."""
    r = replayed(events, span).where("not skipped").select("delegator", "block_number", "log_index", "event_id", "balance", "delegate", "source")
    return latest_by(r, ["delegator", "block_number"], ["log_index", "event_id"])


def registry(events: DataFrame, span: int = REPLAY_BLOCKS) -> DataFrame:
    """Delegators that were ever registered: first registration, last event, whether stake is left."""
    r = replayed(events, span).where("not skipped")
    g = r.groupBy("delegator").agg(F.min(F.when(F.col("registers"), F.struct("block_number", "log_index"))).alias("first"), F.max(F.struct("block_number", "log_index", "balance")).alias("last"), F.count("*").alias("events"))
    return g.where("first is not null").selectExpr("delegator", "first.block_number as first_block", "last.block_number as last_block", "last.balance as balance", "last.balance > 0 as is_active", "events")


_REPLAY = """
bth AS (SELECT *, unnest(CASE WHEN event_name <> 'TransferBond' THEN [from_address] WHEN to_address IS NULL OR to_address = from_address THEN [from_address] ELSE [from_address, to_address] END) AS delegator FROM sev),
r1 AS (SELECT *, coalesce(to_address = delegator, false) AS is_to, event_name = 'Bond' OR (event_name = 'TransferBond' AND coalesce(to_address = delegator, false)) AS registers FROM bth),
r2 AS (SELECT *, (SELECT count(*) FROM r1 x WHERE x.delegator = r1.delegator AND x.registers AND x.event_id < r1.event_id) > 0 AS before FROM r1),
r3 AS (SELECT *, NOT before AND (event_name IN ('Unbond', 'WithdrawStake', 'Rebond') OR (event_name = 'TransferBond' AND NOT is_to)) AS skipped FROM r2),
r4 AS (SELECT *, CASE WHEN event_name IN ('Bond', 'Rebond') THEN coalesce(amount_normalized, 0) WHEN event_name = 'Unbond' THEN -coalesce(amount_normalized, 0) WHEN event_name = 'EarningsClaimed' THEN CAST(CAST(coalesce(rewards, 0) AS DECIMAL(9,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(24,18)) ELSE 0 END AS delta FROM r3 WHERE NOT skipped),
r5 AS (SELECT *, sum(CAST(delta AS DECIMAL(24,18))) OVER w AS balance, coalesce(last_value(CASE WHEN event_name IN ('Bond', 'Unbond', 'Rebond', 'EarningsClaimed') THEN to_address END IGNORE NULLS) OVER w, '0x0000000000000000000000000000000000000000') AS delegate,
  CASE WHEN event_name = 'EarningsClaimed' AND NOT before THEN 'earnings_claimed_bootstrap' ELSE 'flow_derived' END AS source
  FROM r4 WINDOW w AS (PARTITION BY delegator ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
srow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator, block_number ORDER BY event_id DESC) AS n FROM r5) WHERE n = 1)
"""


def stake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored replay: a delegator's state after each of its blocks."""
    return stored(spark, sf_dir, "stake", lambda s, d: stake_rows(P.stake_events(s, d)))


@query("WITH " + _REPLAY + "SELECT delegator, block_number, log_index, event_id, CAST(balance AS DOUBLE) AS balance, delegate, source FROM srow")
def p7_stake_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stake_rows(P.stake_events(spark, sf_dir)).selectExpr("delegator", "block_number", "log_index", "event_id", *dbl("balance"), "delegate", "source")


@query("WITH " + _REPLAY + """, g AS (SELECT delegator, min(event_id) FILTER (registers) AS f, min(block_number) FILTER (registers) AS first_block, max(block_number) AS last_block, max_by(balance, event_id) AS balance, count(*) AS events FROM r5 GROUP BY 1)
SELECT delegator, first_block, last_block, CAST(balance AS DOUBLE) AS balance, balance > 0 AS is_active, events FROM g WHERE f IS NOT NULL""")  # fmt: skip
def p7_delegator_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(P.stake_events(spark, sf_dir)).selectExpr("delegator", "first_block", "last_block", *dbl("balance"), "is_active", "events")


def current_stake(rows: DataFrame) -> DataFrame:
    return latest_by(rows, ["delegator"], ["block_number"])


@query("WITH " + _REPLAY + "SELECT delegator, block_number, delegate, CAST(balance AS DOUBLE) AS balance FROM (SELECT *, row_number() OVER (PARTITION BY delegator ORDER BY block_number DESC) AS m FROM srow) WHERE m = 1 ORDER BY balance DESC, delegator LIMIT 20")
def w3_k7_delegators_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = current_stake(stake(spark, sf_dir))
    return keyset_page(c, [("balance", True), ("delegator", False)], None, 20).selectExpr("delegator", "block_number", "delegate", *dbl("balance"))


@query("WITH " + _REPLAY + ", cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator ORDER BY block_number DESC) AS m FROM srow WHERE block_number <= 1500) WHERE m = 1) SELECT delegate, count(*) AS delegators, CAST(sum(balance) AS DOUBLE) AS principal FROM cur WHERE balance > 0 GROUP BY 1")
def j8_a22_delegators_at_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By delegate those whose last row by block 1500 is with it and holds stake, from the stored replay: a row is the state after its block, so later ones change nothing."""
    c = current_stake(stake(spark, sf_dir).where("block_number <= 1500")).where("balance > 0")
    return c.groupBy("delegate").agg(F.count("*").alias("delegators"), F.sum("balance").cast("double").alias("principal"))


@query("WITH " + _REPLAY + """, pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator, delegate ORDER BY block_number DESC) AS m FROM srow) WHERE m = 1),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator ORDER BY block_number DESC) AS m FROM srow) WHERE m = 1)
SELECT (SELECT count(*) FROM pairs WHERE balance > 0) AS pairs_with_stake, (SELECT count(*) FROM cur WHERE balance > 0) AS delegators_with_stake""")  # fmt: skip
def w6_q8_delegation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that ever were, as the protocol's statistics count them, and the delegators behind them."""
    rows = stake(spark, sf_dir)
    pairs = latest_by(rows, ["delegator", "delegate"], ["block_number"]).agg(F.count_if(F.col("balance") > 0).alias("pairs_with_stake"))
    return pairs.crossJoin(current_stake(rows).agg(F.count_if(F.col("balance") > 0).alias("delegators_with_stake")))


@query("WITH " + _REPLAY + "SELECT delegator, max(block_number) AS block_number, CAST(max_by(balance, block_number) AS DOUBLE) AS balance, 1200 - max(block_number) AS staleness FROM srow WHERE block_number <= 1200 GROUP BY 1")
def j7_stake_at_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = current_stake(stake(spark, sf_dir).where("block_number <= 1200"))
    return c.selectExpr("delegator", "block_number", *dbl("balance"), "1200 - block_number as staleness")


@query("WITH " + _REPLAY + ", cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delegator ORDER BY block_number DESC) AS m FROM srow) WHERE m = 1) SELECT delegator, block_number, CAST(balance AS DOUBLE) AS balance FROM cur WHERE balance > 0 AND block_number < 2490")
def p8_w4_refresh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delegators whose last row holds stake and is older than an anchor; both are asked of the last row only."""
    return current_stake(stake(spark, sf_dir)).where("balance > 0 and block_number < 2490").selectExpr("delegator", "block_number", *dbl("balance"))


@query("WITH " + _REPLAY + """, claims AS (SELECT from_address AS delegator, block_number, max(rewards) AS end_round FROM sev WHERE event_name = 'EarningsClaimed' GROUP BY 1, 2)
SELECT delegator, block_number, CAST(balance AS DOUBLE) AS balance, coalesce(end_round, 0) AS end_round, CASE WHEN c.delegator IS NOT NULL THEN 'both' ELSE source END AS source FROM srow LEFT JOIN claims c USING (delegator, block_number)""")  # fmt: skip
def p9_pending_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a claim in their block adds to."""
    e = P.stake_events(spark, sf_dir)
    claims = e.where("event_name = 'EarningsClaimed'").groupBy(F.col("from_address").alias("delegator"), "block_number").agg(F.max(F.expr("cast(cast(rewards as decimal(38,0)) / cast(1e15 as decimal(20,0)) as int)")).alias("end_round"))
    return stake_rows(e).join(claims, ["delegator", "block_number"], "left").selectExpr("delegator", "block_number", *dbl("balance"), "coalesce(end_round, 0) as end_round", "if(end_round is not null, 'both', source) as source")


def reconciled_stake(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the principal and the delegate that the chain's state tells for them; without a state they stay."""
    s = state.select("delegator", "block_number", F.col("bonded").alias("_b"), F.lower("delegate").alias("_d"))
    return rows.join(s, ["delegator", "block_number"], "left").withColumn("balance", F.coalesce("_b", "balance")).withColumn("delegate", F.coalesce("_d", "delegate")).drop("_b", "_d")


@query("WITH " + _REPLAY + "SELECT delegator, block_number, CAST(CASE WHEN block_number % 3 = 0 THEN balance + 7 ELSE balance END AS DOUBLE) AS balance, CASE WHEN block_number % 3 = 0 THEN 'x' || delegator ELSE delegate END AS delegate FROM srow")
def p9b_exact_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain answers for every third block, with other stakes and delegates."""
    rows = stake(spark, sf_dir)
    state = rows.where("block_number % 3 = 0").selectExpr("delegator", "block_number", "balance + 7 as bonded", "concat('X', delegator) as delegate")
    return reconciled_stake(rows, state).selectExpr("delegator", "block_number", *dbl("balance"), "delegate")


@query("WITH k AS (SELECT to_address AS orchestrator, min(block_number) AS since FROM ev WHERE contract_name = 'BondingManager' GROUP BY 1), r AS (SELECT round, max(block_number) AS block FROM stk GROUP BY 1) SELECT r.round, k.orchestrator, CAST(s.total_stake AS DOUBLE) AS total_stake, coalesce(s.is_active, false) AS in_pool FROM r JOIN k ON k.since <= r.block LEFT JOIN stk s ON s.address = k.orchestrator AND s.round = r.round")
def p14_orchestrators_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each round every orchestrator that was seen before its end, with its state where it has one.

    Rounds are explored from the first that an orchestrator belongs to, so no pair that does not count is made.
    """
    seen = P.protocol_events(spark, sf_dir).where("contract_name = 'BondingManager'").groupBy(F.col("to_address").alias("orchestrator")).agg(F.min("block_number").alias("since"))
    s = P.stake_rounds(spark, sf_dir)
    ends = s.groupBy("round").agg(F.max("block_number").alias("block")).agg(F.collect_list(F.struct("round", "block")).alias("ends"))  # one row; a few thousand rounds in all
    pairs = seen.crossJoin(F.broadcast(ends)).select("orchestrator", F.explode(F.expr("filter(ends, e -> e.block >= since).round")).alias("round"))
    state = s.select("round", F.col("address").alias("orchestrator"), "total_stake", "is_active")
    return pairs.join(state, ["round", "orchestrator"], "left").selectExpr("round", "orchestrator", *dbl("total_stake"), "coalesce(is_active, false) as in_pool")
