"""Hashes by which two states of all tables are compared, and which tell where they differ.

A table's rows lie in ranges of their key. A range's hash is that of its rows' hashes in the order of the key; ranges in order make
groups, and groups the table, so a change of one column of one row changes the hashes of its range, its group and its table and no other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.core import latest_by, range_hashes, whole_hash
from tidemark.plans import operations, routes, stake, valuation
from tidemark.plans.entities import gateway_profiles
from tidemark.plans.registry import PROJECTIONS, SQL, query
from tidemark.plans.rollups import _REW, _TIX, cube
from tidemark.sources import protocol as P
from tidemark.sources.cubes import stored


class Hashed(NamedTuple):
    """``columns`` are all of a table's: ``name``, a time ``name~`` as microseconds, an amount ``name#`` at 18 places; the first ``keys`` of them order it, then the row's hash.

    ``per`` keys make a range if the first one is a number; else a range is a prefix of its hash. ``other`` has SQL for columns that a projection lacks."""

    make: Callable[[SparkSession, str], DataFrame]
    columns: str
    keys: int
    per: int | None = None
    other: dict[str, str] = {}


def _kept(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A derived table that is stored like those it comes from."""
    return lambda spark, sf_dir: stored(spark, sf_dir, name, make)


def _orchestrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(P.stake_rounds(spark, sf_dir), ["address"], ["round"]).join(P.names(spark, sf_dir), "address", "left")


TABLES = {
    "ev": Hashed(P.protocol_events, "id block_number log_index block_timestamp~ tx_hash block_hash user_id k event_name contract_name from_address to_address asset amount_normalized is_valuable is_canonical fee_share finality finalized_at~", 1, 1000),
    "fail": Hashed(_kept("failures", lambda s, d: operations.s4_s12_decode_and_dead_letters(s, d).where("error is not null")), "id event error", 1, 1000),
    "val": Hashed(P.valuations, "event_id valuation_version asset block_number native_usd_price amount_usd status tx_hash block_timestamp~", 3, 1000),
    "att": Hashed(_kept("attempts", valuation.p6c_w9_attempt_numbers), "event_id version attempt status detail tie", 3, 1000),
    "price": Hashed(P.prices, "block_number asset quote source block_timestamp~ price", 4, 500),
    "srow": Hashed(stake.stake, "delegator block_number log_index event_id balance# delegate source", 2),
    "reg": Hashed(_kept("registry", lambda s, d: stake.registry(P.stake_events(s, d))), "delegator first_block last_block balance# is_active events", 1),
    "orch": Hashed(_orchestrators, "address round total_stake snapshot_at~ block_number is_active raw_reward_cut raw_fee_share ens_name override_name", 1),
    "gate": Hashed(gateway_profiles, "gateway block_number deposit reserve# observed_at~ kind", 1, other={"reserve": "CAST(deposit AS DECIMAL(12,2)) * CAST(0.25 AS DECIMAL(3,2))"}),
    "pay": Hashed(lambda s, d: cube(s, d, "payouts"), "orchestrator day valuation_version kind payouts face# commission# face_usd# commission_usd# gateways priced last_event", 4),
    "rew": Hashed(lambda s, d: cube(s, d, "rewards"), "orchestrator day valuation_version rewards total# own# total_usd# own_usd# priced last_event", 3),
    "tix": Hashed(lambda s, d: cube(s, d, "tickets"), "kind day tickets orchestrators gateways", 2),
    "reorg": Hashed(_kept("reorganisations", routes.p17_reorg_audit), "divergence_block old_hash depth new_hash affected", 2, 100),
    "seed": Hashed(P.seeds, "event_id asset asset_usd_price", 2, 1000),
    "cls": Hashed(P.classifications, "gateway kind", 1),
    "nam": Hashed(P.names, "address ens_name override_name", 1),
    "stk": Hashed(P.stake_rounds, "address round total_stake snapshot_at~ block_number is_active raw_reward_cut raw_fee_share", 2),
    "bal": Hashed(P.gateway_balances, "block_number gateway deposit reserve# observed_at~", 2, 1000, {"reserve": "CAST(deposit AS DECIMAL(12,2)) * CAST(0.25 AS DECIMAL(3,2))"}),
    "prop": Hashed(P.proposals, "block_number proposal_id proposer proposed_at~ executed_block", 1, 1000),
    "vote": Hashed(P.votes, "block_number log_index l_partkey l_suppkey voter decoded", 4, 1000, {"decoded": """'{"proposalId":"' || proposal_id || '","support":' || support || ',"weight":"' || weight || '"}'"""}),
    "sev": Hashed(P.stake_events, "event_id block_number log_index block_timestamp~ event_name from_address to_address amount_normalized rewards", 1, 1000, {"rewards": "rewards || '000000000000000'"}),
}


def _told(column: str, spark: bool, other: dict[str, str]) -> str:
    name = column.rstrip("~#")
    if column.endswith("~"):
        return f"unix_micros(cast({name} as timestamp))" if spark else f"epoch_us({name})"
    value = name if spark else other.get(name, name)
    return f"cast({value} as decimal(38,18))" if column.endswith("#") else value


def ranges(df: DataFrame, table: Hashed) -> DataFrame:
    """(range, n_rows, hash) of a table's state."""
    columns = table.columns.split()
    return range_hashes(df, [_told(c, True, table.other) for c in columns], columns[: table.keys], table.per)


def _every(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [of(ranges(t.make(spark, sf_dir), t)).select(F.lit(name).alias("table_name"), "*") for name, t in TABLES.items()])


def _ranges_sql(name: str, table: Hashed) -> str:
    columns = table.columns.split()
    row = "md5(concat_ws('§', " + ", ".join(f"coalesce('=' || CAST({_told(c, False, table.other)} AS VARCHAR), 'null')" for c in columns) + "))"
    part = f"CAST({columns[0]} AS BIGINT) // {table.per}" if table.per else f"CAST('0x' || substr(md5({columns[0]}), 1, 4) AS BIGINT)"
    return f"SELECT '{name}' AS table_name, {part} AS range, count(*) AS n_rows, md5(string_agg({row}, '' ORDER BY {', '.join(columns[: table.keys])}, {row})) AS hash FROM {name} GROUP BY 2"


def _body(name: str) -> str:
    """The SQL of another query, without the projections that come first."""
    return SQL[name].removeprefix(f"WITH {PROJECTIONS}").removeprefix(", ").strip()


_MADE = f"""
fail AS (SELECT id, event, error FROM (WITH {_body('s4_s12_decode_and_dead_letters')}) WHERE error IS NOT NULL),
att AS (WITH {_body('p6c_w9_attempt_numbers')}),
g AS (SELECT delegator, min(event_id) FILTER (registers) AS f, min(block_number) FILTER (registers) AS first_block, max(block_number) AS last_block, max_by(balance, event_id) AS balance, count(*) AS events FROM r5 GROUP BY 1),
reg AS (SELECT *, balance > 0 AS is_active FROM g WHERE f IS NOT NULL),
orch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY round DESC) AS n FROM stk) LEFT JOIN nam USING (address) WHERE n = 1),
gate AS (SELECT gateway, block_number, deposit, observed_at, coalesce(kind, 'transcoding') AS kind FROM (SELECT *, row_number() OVER (PARTITION BY gateway ORDER BY block_number DESC) AS n FROM bal) LEFT JOIN cls USING (gateway) WHERE n = 1),
reorg AS (WITH {_body('p17_reorg_audit')}),
hashed AS ({" UNION ALL ".join(_ranges_sql(n, t) for n, t in TABLES.items())})
"""
_HASHED = "WITH " + _REW + "," + _TIX + "," + stake._REPLAY + "," + _MADE


@query(_HASHED + "SELECT * FROM hashed")
def a28_a29_range_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and hash of each range of all tables: where two runs differ."""
    return _every(spark, sf_dir, lambda r: r)


@query(_HASHED + """, grouped AS (SELECT table_name, range // 1000 AS g, sum(n_rows) AS n_rows, md5(string_agg(hash, '' ORDER BY range)) AS hash FROM hashed GROUP BY 1, 2)
SELECT table_name, CAST(sum(n_rows) AS BIGINT) AS n_rows, md5(string_agg(hash, '' ORDER BY g)) AS hash FROM grouped GROUP BY 1""")  # fmt: skip
def a28_a29_table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and ordered hash of each table, over all of its columns; equal runs end in equal hashes."""
    return _every(spark, sf_dir, whole_hash)

