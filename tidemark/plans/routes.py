"""What routes take as parameters, and what a reorganisation, a second valuation and governance leave behind."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.core import keyset_page
from tidemark.plans.entities import _FLOWS, ledger
from tidemark.plans.operations import limit_of, page_of, reorganised
from tidemark.plans.registry import dbl, query
from tidemark.plans.rollups import _EV_AS_OF, payout_summary
from tidemark.sources import protocol as P
from tidemark.sources.storage import file_hashes, shared_path

# --- parameters -----------------------------------------------------------------------------------

#: Routes and what is asked of them: nothing, too much, nothing at all.
_ASKED = [("events", None), ("events", 5000), ("delegators", None), ("delegators", 5000), ("rounds", 70), ("votes", 0), ("prices", None), ("prices", 50000)]


@query("SELECT route, asked, least(lim, (SELECT count(*) FROM ev)) AS n FROM (VALUES ('events', 'usual', 100), ('events', '5000', 1000), ('delegators', 'usual', 50), ('delegators', '5000', 500), ('rounds', '70', 70), ('votes', '0', 0), ('prices', 'usual', 1000), ('prices', '50000', 10000)) v(route, asked, lim)")
def f22_page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a page of each route holds."""
    e = P.protocol_events(spark, sf_dir).select("id")
    one = lambda r, a: keyset_page(e, [("id", False)], None, limit_of(r, a)).agg(F.lit(r).alias("route"), F.lit("usual" if a is None else str(a)).alias("asked"), F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [one(r, a) for r, a in _ASKED])


def job_type(text: str | None = None) -> str | None:
    """The kind of gateways that is asked for; none stands for both."""
    if text not in (None, "ai", "transcoding", "both"):
        raise ValueError(f"{text!r} is none of ai, transcoding, both")
    return None if text == "both" else text


@query("WITH " + _EV_AS_OF + """SELECT j.t AS job_type, CAST(coalesce(sum(payouts), 0) AS BIGINT) AS payouts, CAST(coalesce(sum(face), 0) AS DOUBLE) AS face
FROM (VALUES ('ai'), ('transcoding'), ('both')) j(t) LEFT JOIN pay ON day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND valuation_version = 'v1' AND (j.t = 'both' OR kind = j.t) GROUP BY 1""")  # fmt: skip
def f23_payouts_by_job_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: payout_summary(spark, sf_dir, date(2024, 1, 1), date(2024, 1, 31), job_type(t)).selectExpr(f"'{t}' as job_type", "payouts", *dbl("face"))
    return reduce(DataFrame.unionByName, [one(t) for t in ("ai", "transcoding", "both")])


def trailing(as_of: datetime, days: int | None, usual: int, most: int, clamp: bool = False) -> tuple[datetime, datetime]:
    """The last ``days`` up to a given time, both ends included; days out of range are refused, or moved into it."""
    days = usual if days is None else days
    if clamp:
        days = min(max(days, 1), most)
    if not 1 <= days <= most:
        raise ValueError(f"days must be between 1 and {most}")
    return as_of - timedelta(days=days), as_of


@query("WITH " + _FLOWS + """SELECT w.asked, flow_kind, count(*) AS flows, CAST(sum(amount_normalized) AS DOUBLE) AS amount FROM flow
JOIN (VALUES ('usual', TIMESTAMP '2024-01-13 12:00:00'), ('1', TIMESTAMP '2024-01-19 12:00:00'), ('3650', TIMESTAMP '2014-01-22 12:00:00')) w(asked, since) ON block_timestamp >= w.since AND block_timestamp <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""")  # fmt: skip
def f21_flows_of_last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the last days before noon of 2024-01-20: a week, a day, ten years."""
    def one(days: int | None) -> DataFrame:
        since, till = (F.lit(str(t)).cast("timestamp_ntz") for t in trailing(datetime(2024, 1, 20, 12), days, 7, 3650))
        flows = ledger(spark, sf_dir).where((F.col("block_timestamp") >= since) & (F.col("block_timestamp") <= till))
        return flows.groupBy("flow_kind").agg(F.count("*").alias("flows"), F.sum("amount_normalized").alias("amount")).select(F.lit("usual" if days is None else str(days)).alias("asked"), "flow_kind", "flows", F.col("amount").cast("double").alias("amount"))

    return one(None).unionByName(one(1)).unionByName(one(3650))


def avatar(address: str, override: str, stored: str, url: str) -> F.Column:
    """An override, else the path of a stored picture, else a web address; other addresses lead nowhere."""
    return F.expr(f"coalesce({override}, if({stored} is not null, concat('/api/v1/orchestrators/', {address}, '/avatar'), null), if({url} like 'http%', {url}, null))")


@query("SELECT address, CASE WHEN s % 5 = 0 THEN 'https://over/' || s WHEN s % 3 = 0 THEN '/api/v1/orchestrators/' || address || '/avatar' WHEN s % 2 = 0 THEN 'http://pictures/' || s END AS avatar_url FROM (SELECT s_suppkey AS s, 'o' || s_suppkey AS address FROM supplier)")
def f18_avatars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P._read(spark, sf_dir, "supplier").selectExpr("concat('o', s_suppkey) as address", "if(s_suppkey % 5 = 0, concat('https://over/', s_suppkey), null) as override", "if(s_suppkey % 3 = 0, 'png', null) as stored", "concat(if(s_suppkey % 2 = 0, 'http', 'ipfs'), '://pictures/', s_suppkey) as url")
    return s.select("address", avatar("address", "override", "stored", "url").alias("avatar_url"))


# --- reorganisations ------------------------------------------------------------------------------


def rewritten(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events with those of reorganised blocks no longer canonical."""
    gone = found.select("block_number", F.lit(True).alias("gone")).distinct()
    return events.join(gone, "block_number", "left").withColumn("is_canonical", F.col("is_canonical") & F.col("gone").isNull()).drop("gone")


def audited(events: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each reorganised hash: both hashes, and how many events ceased to be canonical, told once for a block."""
    lost = events.where("is_canonical").groupBy("block_number").agg(F.count("*").alias("lost"))
    first = F.row_number().over(W.partitionBy("block_number").orderBy("old_hash")) == 1
    rows = found.join(lost, "block_number").select("block_number", F.lit(1).alias("depth"), F.lower("block_hash").alias("old_hash"), F.lower("chain_hash").alias("new_hash"), "lost")
    return rows.select(F.col("block_number").alias("divergence_block"), "depth", "old_hash", "new_hash", F.when(first, F.col("lost")).otherwise(0).alias("affected"))


def _found(e: DataFrame) -> DataFrame:
    return reorganised(e, e.select("block_number", F.expr("case when block_number % 40 = 0 then concat('x', block_number) when block_number % 3 = 0 then upper(block_hash) else block_hash end").alias("block_hash")).distinct())


_BAD = "bad AS (SELECT DISTINCT block_number FROM ev WHERE is_canonical AND finality = 'tentative' AND block_number % 40 = 0 AND block_number >= (SELECT max(block_number) FROM ev) - 7500)"


@query(f"WITH {_BAD} SELECT id, is_canonical AND block_number NOT IN (SELECT block_number FROM bad) AS is_canonical FROM ev")
def p17_reorg_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    return rewritten(e, _found(e)).select("id", "is_canonical")


@query(f"WITH {_BAD} SELECT block_number AS divergence_block, 1 AS depth, 'h' || block_number AS old_hash, 'x' || block_number AS new_hash, count(*) AS affected FROM ev WHERE is_canonical AND block_number IN (SELECT block_number FROM bad) GROUP BY 1")
def p17_reorg_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.protocol_events(spark, sf_dir)
    return audited(e, _found(e))


# --- valuation ------------------------------------------------------------------------------------

#: The fields in which a second computation of a value must agree with the first.
DETERMINED = ("pricing_method", "source", "status", "amount_native", "native_usd_price", "amount_usd")


def departures(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Values that a second computation does not confirm, with the fields that differ; amounts are compared as numbers."""
    a, b = (df.select(*keys, F.struct(*DETERMINED).alias(s)) for df, s in ((stored, "x"), (again, "y")))
    differs = F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), c) for c in DETERMINED])
    j = a.join(b, keys, "full_outer").withColumn("differs", F.array_join(differs, ","))
    return j.where("differs <> ''").select(*keys, "differs")


@query("SELECT event_id, valuation_version, asset, CASE event_id % 100 WHEN 7 THEN 'amount_usd' WHEN 17 THEN 'native_usd_price' WHEN 27 THEN 'status' WHEN 37 THEN 'amount_native' WHEN 47 THEN 'pricing_method,source' END AS differs FROM val WHERE event_id % 100 IN (7, 17, 27, 37, 47) AND NOT (event_id % 100 IN (7, 17) AND status <> 'priced')")
def p6d_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values against a second computation that is off in a field for some ends of ids."""
    amounts = P.protocol_events(spark, sf_dir).select(F.col("id").alias("event_id"), F.col("amount_normalized").alias("amount_native"))
    a = P.valuations(spark, sf_dir).join(amounts, "event_id").selectExpr("*", "'oracle' as pricing_method", "'chainlink' as source", "event_id % 100 as end")
    off = {"amount_usd": (7, "cast(amount_usd + 1 as decimal(38,18))"), "native_usd_price": (17, "cast(native_usd_price + 1 as decimal(12,2))"), "status": (27, "'other'"), "amount_native": (37, "cast(amount_native + 1 as decimal(24,18))"), "pricing_method": (47, "'other'"), "source": (47, "'other'")}
    b = a.withColumns({c: F.expr(f"if(end = {at}, {new}, {c})") for c, (at, new) in off.items()})
    return departures(a, b, ["event_id", "valuation_version", "asset"])


@query("SELECT (SELECT max(event_id) FROM val WHERE valuation_version IN ('v1', 'v1_degraded') AND amount_usd IS NOT NULL) AS last_priced, (SELECT count(*) FROM val WHERE status LIKE 'failed_%' AND block_timestamp + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20') AS due")
def a27_priced_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest id with a value under either version, and failed attempts whose next one is due, an hour after the event."""
    v = P.valuations(spark, sf_dir)
    usable = F.col("valuation_version").isin(P.V1, P.DEGRADED) & F.col("amount_usd").isNotNull()
    due = F.expr("status like 'failed_%' and block_timestamp + interval 1 hour <= timestamp_ntz '2024-01-20'")
    return v.agg(F.max(F.when(usable, F.col("event_id"))).alias("last_priced"), F.count_if(due).alias("due"))


# --- governance -----------------------------------------------------------------------------------


def proposals_by_status(events: DataFrame, status: str = "all", limit: int | None = None) -> DataFrame:
    """Created proposals, newest first, joined to their execution on the id in the events' JSON."""
    if status not in ("executed", "not_executed", "active", "all"):
        raise ValueError(f"{status!r} is none of executed, not_executed, active, all")
    e = events.where("is_canonical").withColumn("proposal_id", F.get_json_object("raw_event", "$.decoded.proposalId")).where("proposal_id <> ''")
    made = e.where("event_name = 'ProposalCreated'").select("proposal_id", F.get_json_object("raw_event", "$.decoded.proposer").alias("proposer"), "block_number", "log_index")
    j = made.join(e.where("event_name = 'ProposalExecuted'").select("proposal_id", F.col("block_number").alias("executed_block")), "proposal_id", "left")
    j = j if status == "all" else j.where("executed_block is not null" if status == "executed" else "executed_block is null")
    return keyset_page(j, [("block_number", True), ("log_index", True)], None, limit_of("proposals", limit))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS status, proposal_id, proposer, block_number, executed_block FROM prop WHERE {w} ORDER BY block_number DESC LIMIT 100)" for s, w in (("all", "true"), ("executed", "executed_block IS NOT NULL"), ("active", "executed_block IS NULL"))))
def j15_proposals_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.governance_events(spark, sf_dir)
    return reduce(DataFrame.unionByName, [proposals_by_status(g, s).select(F.lit(s).alias("status"), "proposal_id", "proposer", "block_number", "executed_block") for s in ("all", "executed", "active")])


# --- scalars and files ----------------------------------------------------------------------------


def strip_nulls(json: str, schema: str) -> F.Column:
    """JSON without the fields that are null, however deep."""
    return F.to_json(F.from_json(json, schema), {"ignoreNullFields": "true"})


@query("SELECT id, TIMESTAMP '2024-01-01' + to_seconds(k * 3600) AS cutoff, block_timestamp <= TIMESTAMP '2024-01-01' + to_seconds(k * 3600) AS final, CASE WHEN k % 2 = 0 THEN '{\"a\":' || k || ',\"b\":{\"d\":' || k || '}}' ELSE '{\"b\":{\"d\":' || k || '}}' END AS stripped FROM ev")
def d6_j6_epochs_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time from seconds since 1970, in UTC whatever the session's zone, as a cut between final and other events; JSON without nulls."""
    raw = "concat('{\"a\":', if(k % 2 = 0, cast(k as string), 'null'), ',\"b\":{\"c\":null,\"d\":', k, '}}') as raw"
    e = P.protocol_events(spark, sf_dir).selectExpr("id", "block_timestamp", "timestamp_ntz '1970-01-01' + make_dt_interval(0, 0, 0, 1704067200 + k * 3600) as cutoff", raw)
    return e.select("id", "cutoff", (F.col("block_timestamp") <= F.col("cutoff")).alias("final"), strip_nulls("raw", "a bigint, b struct<c: bigint, d: bigint>").alias("stripped"))


@query("SELECT sha256(contract_name || chr(10)) AS sha256, CAST(length(contract_name) + 1 AS BIGINT) AS length FROM (SELECT DISTINCT contract_name FROM ev)")
def s22_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each contract, written and read back with its hash."""
    path = shared_path(spark, "registry")
    P.protocol_events(spark, sf_dir).select("contract_name", F.col("contract_name").alias("value")).distinct().repartition("contract_name").write.partitionBy("contract_name").text(path)
    return file_hashes(spark, path).select("sha256", "length")


def votes_page(votes: DataFrame, checkpoint: DataFrame, voter: str | None, proposal: str | None, after: tuple | None, limit: int | None = None) -> DataFrame:
    """A page of votes with whether more follow, each row's cursor, and up to which block the governor's log was read; ``covered`` is false where it was not."""
    rows = votes.withColumn("proposal_id", F.get_json_object("decoded", "$.proposalId"))
    rows = rows if voter is None else rows.where(F.col("voter") == voter)
    rows = rows if proposal is None else rows.where(F.col("proposal_id") == proposal)
    page = page_of(rows, [("block_number", True), ("log_index", True), ("l_partkey", False), ("l_suppkey", False)], after, limit_of("votes", limit))
    last = checkpoint.agg(F.max("block_number").alias("last_processed_block"))
    return page.crossJoin(F.broadcast(last)).withColumn("covered", F.col("last_processed_block").isNotNull()).withColumn("cursor", F.concat_ws(":", "block_number", "log_index"))  # one row


@query("""WITH p AS (SELECT * FROM vote WHERE voter = 'g5' ORDER BY block_number DESC, log_index DESC, l_partkey, l_suppkey LIMIT 21)
SELECT proposal_id, voter, CAST(support AS VARCHAR) AS support, CAST(weight AS VARCHAR) AS weight, block_number, log_index, (SELECT count(*) FROM p) > 20 AS has_more, block_number || ':' || log_index AS cursor, (SELECT max(block_number) FROM prop) AS last_processed_block, true AS covered
FROM p ORDER BY block_number DESC, log_index DESC, l_partkey, l_suppkey LIMIT 20""")
def k10_votes_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = votes_page(P.votes(spark, sf_dir), P.proposals(spark, sf_dir).select("block_number"), "g5", None, None, 20)
    field = lambda n: F.get_json_object("decoded", f"$.{n}").alias(n)
    return page.select("proposal_id", "voter", field("support"), field("weight"), "block_number", "log_index", "has_more", "cursor", "last_processed_block", "covered")
