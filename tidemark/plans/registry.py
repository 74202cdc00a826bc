"""Where the queries and their SQL are kept; the SQL starts from the same projections as ``sources/protocol.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PROJECTIONS = """
ev AS (SELECT event_id AS id, event_id // 4 AS block_number, CAST(event_id % 4 AS INTEGER) AS log_index, ts AS block_timestamp, 't' || (event_id // 2) AS tx_hash,
  'h' || (event_id // 4) AS block_hash, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE event_type WHEN 'purchase' THEN 'WinningTicketRedeemed' WHEN 'click' THEN 'Reward' WHEN 'signup' THEN 'Bond' WHEN 'error' THEN 'Unbond' ELSE 'TranscoderUpdate' END AS event_name,
  CASE WHEN event_type = 'purchase' THEN 'TicketBroker' ELSE 'BondingManager' END AS contract_name,
  'g' || user_id AS from_address, 'o' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) AS to_address,
  CASE event_type WHEN 'purchase' THEN 'ETH' WHEN 'view' THEN NULL ELSE 'LPT' END AS asset,
  CASE WHEN event_type <> 'view' THEN CAST(CAST(value AS DECIMAL(12,2)) AS DECIMAL(24,18)) END AS amount_normalized,
  event_type <> 'view' AS is_valuable, CAST(json_extract_string(props, '$.k') AS INTEGER) % 50 <> 0 AS is_canonical,
  CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) * 10000 END AS fee_share,
  CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 'finalized' WHEN ts < TIMESTAMP '2024-01-28' THEN 'l1_posted' ELSE 'tentative' END AS finality,
  CASE WHEN ts < TIMESTAMP '2024-01-25' THEN ts + INTERVAL 20 MINUTE END AS finalized_at FROM events),
val0 AS (SELECT *, unnest(CASE WHEN k % 10 = 0 THEN ['v1', 'v1_degraded'] ELSE ['v1'] END) AS valuation_version,
  CASE WHEN k % 17 <> 0 THEN CAST(2 + CAST(day(block_timestamp) AS DECIMAL(4,2)) / 100 AS DECIMAL(12,2)) END AS native_usd_price FROM ev WHERE is_valuable),
val AS (SELECT id AS event_id, valuation_version, asset, block_number, native_usd_price, CAST(amount_normalized * native_usd_price AS DECIMAL(38,18)) AS amount_usd,
  CASE WHEN k % 17 = 0 THEN 'failed_missing_oracle' ELSE 'priced' END AS status, tx_hash, block_timestamp FROM val0),
price AS (SELECT 'ETH' AS asset, 'USD' AS quote, block_number, source, block_timestamp, CAST(2 + CAST(day(block_timestamp) AS DECIMAL(4,2)) / 100 + CASE WHEN source = 'chainlink' THEN 0 ELSE 1 END AS DECIMAL(12,2)) AS price
  FROM (SELECT *, unnest(CASE WHEN block_number % 5 = 0 THEN ['chainlink', 'uniswap_v3_twap_30min'] ELSE ['chainlink'] END) AS source
        FROM (SELECT event_id // 4 AS block_number, min(ts) AS block_timestamp FROM events GROUP BY 1))),
seed AS (SELECT id AS event_id, asset, CAST(1.5 AS DECIMAL(12,2)) AS asset_usd_price FROM ev WHERE k % 3 = 0 AND asset IS NOT NULL),
cls AS (SELECT DISTINCT 'g' || user_id AS gateway, 'ai' AS kind FROM events WHERE user_id % 7 = 0),
nam AS (SELECT 'o' || s_suppkey AS address, s_name AS ens_name, CASE WHEN s_suppkey % 2 = 0 THEN 'the ' || s_name END AS override_name FROM supplier),
rcpt AS (SELECT 't' || l_orderkey AS tx_hash, CAST(max(l_partkey) + 21000 AS DECIMAL(18,0)) AS gas_used, CASE WHEN l_orderkey % 3 <> 0 THEN CAST(max(l_suppkey) + 1 AS DECIMAL(18,0)) * CAST(1000000000 AS DECIMAL(10,0)) END AS effective_gas_price,
  CAST(max(l_suppkey) + 2 AS DECIMAL(18,0)) * CAST(1000000000 AS DECIMAL(10,0)) AS gas_price FROM lineitem GROUP BY l_orderkey),
stk AS (SELECT 'o' || (o_custkey % 50) AS address, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS round, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,18)) AS total_stake,
  max(o_orderdate) AS snapshot_at, max(o_orderkey) AS block_number, count(*) % 3 <> 0 AS is_active, max(o_orderkey) % 1000000 AS raw_reward_cut, min(o_orderkey) % 1000000 AS raw_fee_share FROM orders GROUP BY 1, 2),
bal AS (SELECT 'g' || o_custkey AS gateway, o_orderkey AS block_number, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,18)) AS deposit, o_orderdate AS observed_at FROM orders),
prop AS (SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id, o_orderkey AS block_number, 'o' || (o_custkey % 50) AS proposer, o_orderdate AS proposed_at, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 7 END AS executed_block FROM orders),
vote AS (SELECT l_orderkey AS block_number, l_linenumber AS log_index, 'g' || (l_partkey % 100) AS voter, CAST(l_orderkey AS VARCHAR) AS proposal_id, l_linenumber % 3 AS support, CAST(l_quantity AS INTEGER) AS weight, l_partkey, l_suppkey FROM lineitem),
bev AS (SELECT id, block_number, log_index, block_timestamp,
  CASE event_name WHEN 'Bond' THEN CASE WHEN k % 2 = 0 THEN 'DepositFunded' ELSE 'ReserveFunded' END WHEN 'Unbond' THEN CASE k % 3 WHEN 0 THEN 'Withdrawal' WHEN 1 THEN 'Unlock' ELSE 'UnlockCancelled' END
    ELSE CASE k % 4 WHEN 0 THEN 'WinningTicketTransfer' WHEN 1 THEN 'ReserveClaimed' ELSE 'WinningTicketRedeemed' END END AS event_name,
  from_address, CASE WHEN event_name = 'WinningTicketRedeemed' AND k % 9 <> 0 THEN to_address END AS to_address, asset, amount_normalized, is_canonical, finality
  FROM ev WHERE event_name IN ('WinningTicketRedeemed', 'Bond', 'Unbond')),
sev AS (SELECT id AS event_id, block_number, log_index, block_timestamp,
  CASE event_name WHEN 'Bond' THEN 'Bond' WHEN 'Unbond' THEN CASE WHEN k % 4 = 0 THEN 'WithdrawStake' ELSE 'Unbond' END WHEN 'TranscoderUpdate' THEN 'EarningsClaimed' ELSE CASE WHEN k % 2 = 0 THEN 'Rebond' ELSE 'TransferBond' END END AS event_name,
  'd' || (user_id % 40) AS from_address, CASE WHEN k % 9 = 0 THEN NULL ELSE 'd' || (k % 40) END AS to_address,
  CASE WHEN k % 11 <> 0 THEN amount_normalized END AS amount_normalized, CASE WHEN event_name = 'TranscoderUpdate' THEN k END AS rewards
  FROM ev WHERE contract_name = 'BondingManager' AND is_canonical)
"""


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that may use the projections."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {PROJECTIONS}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {PROJECTIONS} {sql.strip()}"
        return f

    return keep


def dbl(*cols: str) -> list[str]:
    """Select expressions that turn exact sums into doubles, at the very end."""
    return [f"cast({c} as double) as {c}" for c in cols]
