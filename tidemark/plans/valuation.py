"""Values of events: seeds, oracles, pools, the two halves of a claim, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.money import mean_tick_sql, oracle_status, root_to_price_udf, tick_to_price_udf
from tidemark.operators.core import latest_by, without
from tidemark.plans.registry import dbl, query
from tidemark.sources import protocol as P


#: An oracle's answer has eight decimals; its value keeps them all.
ANSWER = "cast(cast(answer as decimal(18,0)) * cast(0.00000001 as decimal(9,8)) as decimal(14,8))"


def seed_valuations(events: DataFrame, seeds: DataFrame, val: DataFrame, version: str) -> DataFrame:
    """Events with a trusted price and no value in ``version`` yet."""
    have = val.where(F.col("valuation_version") == version).select(F.col("event_id").alias("id"), "asset")
    todo = without(events.where("is_valuable and asset is not null"), have, ["id", "asset"])
    return todo.join(seeds.withColumnRenamed("event_id", "id"), ["id", "asset"]).withColumn("amount_usd", F.expr("cast(amount_normalized * asset_usd_price as decimal(38,18))"))


@query("SELECT e.id, 'seed_lookup' AS method, CAST(e.amount_normalized * s.asset_usd_price AS DOUBLE) AS amount_usd FROM ev e JOIN seed s ON s.event_id = e.id AND s.asset = e.asset WHERE e.is_valuable AND NOT EXISTS (SELECT 1 FROM val v WHERE v.event_id = e.id AND v.asset = e.asset AND v.valuation_version = 'v1_degraded')")
def p1_j12_seed_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seed_valuations(P.protocol_events(spark, sf_dir), P.seeds(spark, sf_dir), P.valuations(spark, sf_dir), P.DEGRADED)
    return s.selectExpr("id", "'seed_lookup' as method", *dbl("amount_usd"))


def readings(spark: SparkSession, sf_dir: str, which: str = "is_valuable") -> DataFrame:
    """Oracle and pool readings at the blocks of events, spread over all outcomes by k; ``root`` is the pool's own root price, (1000 + k) / 4096."""
    return P.protocol_events(spark, sf_dir).where(which).selectExpr(
        "id", "k", "asset", "amount_normalized", "k % 23 = 0 as feed_empty", "k % 19 div 18 as sequencer_answer", "k % 29 = 0 as pool_empty", "k % 31 = 0 as aggregator_empty", "k as answered_in_round", "if(k % 13 = 0, k + 1, k) as round_id",
        "k * 1000 as age_s", "(k - 1) * 123456789L as answer", "cast(cast(1000 + k as decimal(10,0)) * cast(19342813113834066795298816 as decimal(26,0)) as string) as root", "100 + k as cardinality", "k % 37 = 0 as observe_failed", "cast((k - 50) * 100000 + user_id as bigint) as delta",
    )


_READ = """rd AS (SELECT id, k, asset, amount_normalized, k % 23 = 0 AS feed_empty, (k % 19) // 18 AS sequencer_answer, k % 29 = 0 AS pool_empty, k % 31 = 0 AS aggregator_empty, k AS answered_in_round, CASE WHEN k % 13 = 0 THEN k + 1 ELSE k END AS round_id,
  k * 1000 AS age_s, (CAST(k AS BIGINT) - 1) * 123456789 AS answer, 100 + k AS cardinality, k % 37 = 0 AS observe_failed, (k - 50) * 100000 + user_id AS delta FROM ev WHERE is_valuable)
"""
_LADDER = "CASE WHEN feed_empty THEN 'missing_oracle' WHEN sequencer_answer <> 0 THEN 'sequencer_outage' {a} WHEN aggregator_empty OR answered_in_round < round_id OR age_s > 86400 OR answer <= 0 THEN 'missing_oracle' {b} ELSE 'ok' END"


@query("WITH " + _READ + f"SELECT id, {_LADDER.format(a='', b='')} AS status, CASE WHEN {_LADDER.format(a='', b='')} = 'ok' THEN CAST(CAST(amount_normalized AS DECIMAL(12,2)) * (CAST(answer AS DECIMAL(15,0)) * CAST(0.00000001 AS DECIMAL(9,8))) AS DOUBLE) END AS amount_usd FROM rd WHERE asset = 'ETH'")
def p2_k5_k6_eth_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETH by the oracle's answer, which has eight decimals; what the checks reject stays, without a value."""
    r = readings(spark, sf_dir).where("asset = 'ETH'").withColumn("status", oracle_status(False))
    return r.selectExpr("id", "status", "case when status = 'ok' then cast(cast(amount_normalized as decimal(24,12)) * " + ANSWER + " as double) end as amount_usd")


@query("WITH " + _READ + f"SELECT id, {_LADDER.format(a=chr(10) + ' WHEN pool_empty THEN ' + chr(39) + 'missing_pool' + chr(39), b='WHEN cardinality < 144 THEN ' + chr(39) + 'degraded' + chr(39) + ' WHEN observe_failed THEN ' + chr(39) + 'missing_pool' + chr(39))} AS status, CAST(floor(delta / 1800.0) AS BIGINT) AS tick FROM rd WHERE asset = 'LPT'")
def p3_p4_k3_lpt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of checks for LPT with the mean tick, rounded toward minus infinity."""
    r = readings(spark, sf_dir).where("asset = 'LPT'").withColumn("status", oracle_status(True))
    return r.selectExpr("id", "status", f"{mean_tick_sql('delta')} as tick")


_ELIGIBLE = _LADDER.format(a=" WHEN pool_empty THEN 'missing_pool'", b="WHEN cardinality < 144 THEN 'degraded' WHEN observe_failed THEN 'missing_pool'")


@query("WITH " + _READ + f""", s AS (SELECT *, {_ELIGIBLE} AS status, CAST(floor(delta / 1800.0) AS BIGINT) AS mean FROM rd WHERE asset = 'LPT'),
e AS (SELECT *, CASE WHEN status = 'ok' THEN pow(1.0001::DOUBLE, mean) ELSE ((1000 + k) / 4096.0::DOUBLE) * ((1000 + k) / 4096.0::DOUBLE) END AS eth FROM s WHERE status IN ('ok', 'degraded'))
SELECT id, CASE WHEN status = 'ok' THEN mean END AS tick, CASE WHEN status = 'ok' THEN 'v1_lpt_weth_twap_30min_x_chainlink_eth' ELSE 'v1_degraded_spot_pre_cardinality' END AS valuation_version, round(eth, 6) AS eth, round(eth * answer / 1e8, 4) AS usd_price FROM e""")
def p3_k1_k2_k4_lpt_twap_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of ``lpt_prices`` rounded to what doubles in SQL can confirm."""
    return lpt_prices(readings(spark, sf_dir).where("asset = 'LPT'")).select("id", "tick", "valuation_version", F.round(F.col("eth").cast("double"), 6).alias("eth"), F.round(F.col("usd_price").cast("double"), 4).alias("usd_price"))


def lpt_prices(found: DataFrame) -> DataFrame:
    """(id, tick, valuation_version, eth, usd_price) of readings that can be priced, all 18 places of both prices.

    LPT by the pool's mean tick and ETH's price, each distinct tick priced once; where the pool looks back too little, by its own price of that block.
    """
    r = found.withColumn("status", oracle_status(True)).where("status in ('ok', 'degraded')").selectExpr("id", "status", "answer", f"if(status = 'ok', {mean_tick_sql('delta')}, null) as tick", "if(status = 'ok', null, root) as root")
    priced = r.select("tick", "root").distinct().withColumn("eth", F.coalesce(tick_to_price_udf("tick"), root_to_price_udf("root")).cast("decimal(36,18)"))
    version = F.when(F.col("status") == "ok", "v1_lpt_weth_twap_30min_x_chainlink_eth").otherwise("v1_degraded_spot_pre_cardinality")
    j = r.join(priced, r["tick"].eqNullSafe(priced["tick"]) & r["root"].eqNullSafe(priced["root"])).drop(priced["tick"])
    # ETH in dollars has eight places; the product is cut to eighteen by halves, so that it stays within 38 digits
    usd = F.expr(f"cast(cast(floor(eth) * {ANSWER} as decimal(36,18)) + cast(cast(eth - floor(eth) as decimal(18,18)) * {ANSWER} as decimal(33,26)) as decimal(38,18))")
    return j.select("id", "tick", version.alias("valuation_version"), "eth", usd.alias("usd_price"))


@query()
def p3_lpt_prices_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LPT in ETH and in dollars with all 18 places; doubles in SQL have fewer, so plain decimals in the tests hold them."""
    return lpt_prices(readings(spark, sf_dir).where("asset = 'LPT'"))


@query("""SELECT e.id, '{"steps":[{"asset":"' || e.asset || '","quote":"USD","price":"' || s.asset_usd_price || '","source":"seed_lookup","block_number":' || e.block_number || '}],"result":{"asset":"' || e.asset || '","quote":"USD","price":"' || s.asset_usd_price
  || '","amount_native":"' || e.amount_normalized || '","amount_usd":"' || CAST(e.amount_normalized * s.asset_usd_price AS DECIMAL(38,18)) || '"}}' AS pricing_chain
FROM ev e JOIN seed s ON s.event_id = e.id AND s.asset = e.asset WHERE e.is_valuable AND NOT EXISTS (SELECT 1 FROM val v WHERE v.event_id = e.id AND v.asset = e.asset AND v.valuation_version = 'v1_degraded')""")
def j4_pricing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each seeded value came about, as JSON: the steps and the result, amounts as text."""
    s = seed_valuations(P.protocol_events(spark, sf_dir), P.seeds(spark, sf_dir), P.valuations(spark, sf_dir), P.DEGRADED)
    text = lambda c: F.col(c).cast("string")
    step = F.struct("asset", F.lit("USD").alias("quote"), text("asset_usd_price").alias("price"), F.lit("seed_lookup").alias("source"), "block_number")
    result = F.struct("asset", F.lit("USD").alias("quote"), text("asset_usd_price").alias("price"), text("amount_normalized").alias("amount_native"), text("amount_usd").alias("amount_usd"))
    return s.select("id", F.to_json(F.struct(F.array(step).alias("steps"), result.alias("result"))).alias("pricing_chain"))


def _result(asset: str) -> F.Column:
    text = lambda c: F.col(c).cast("string").alias(c)
    return F.struct(F.lit(asset).alias("asset"), F.lit("USD").alias("quote"), F.col("usd_price").cast("string").alias("price"), text("amount_native"), text("amount_usd")).alias("result")


def _dollar_step(asset: str) -> F.Column:
    """The oracle's answer as a step, with what was read."""
    read = F.struct(*[F.col(c).cast("string").alias(c) for c in ("round_id", "answered_in_round", "answer")])
    return F.struct(F.lit(asset).alias("asset"), F.lit("USD").alias("quote"), F.expr(f"cast({ANSWER} as string)").alias("price"), F.lit("chainlink").alias("source"), F.expr("id div 4").alias("block_number"), read.alias("raw_round"))


_WHOLE = "CAST(CAST(answer AS DECIMAL(15,0)) * CAST(0.00000001 AS DECIMAL(9,8)) AS DECIMAL(14,8))"


@query("WITH " + _READ + f""", p AS (SELECT *, {_WHOLE} AS price FROM rd WHERE asset = 'ETH' AND {_LADDER.format(a='', b='')} = 'ok')
SELECT id, '{{"steps":[{{"asset":"ETH","quote":"USD","price":"' || price || '","source":"chainlink","block_number":' || (id // 4) || ',"raw_round":{{"round_id":"' || round_id || '","answered_in_round":"' || answered_in_round || '","answer":"' || answer || '"}}}}],"result":{{"asset":"ETH","quote":"USD","price":"' || price
  || '","amount_native":"' || amount_normalized || '","amount_usd":"' || CAST(CAST(amount_normalized AS DECIMAL(12,2)) * CAST(price AS DECIMAL(24,8)) AS DECIMAL(38,18)) || '"}}}}' AS pricing_chain FROM p""")
def j4_eth_pricing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each value of ETH by the oracle came about, as JSON."""
    r = readings(spark, sf_dir).where("asset = 'ETH'").withColumn("status", oracle_status(False)).where("status = 'ok'")
    r = r.withColumn("usd_price", F.expr(ANSWER)).withColumn("amount_native", F.col("amount_normalized")).withColumn("amount_usd", F.expr(f"cast(cast(amount_normalized as decimal(24,12)) * {ANSWER} as decimal(38,18))"))
    return r.select("id", F.to_json(F.struct(F.array(_dollar_step("ETH")).alias("steps"), _result("ETH"))).alias("pricing_chain"))


@query()
def j4_lpt_pricing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each value of LPT came about: the pool's price with what was observed, ETH in dollars, and the result, amounts with all places as text."""
    r = readings(spark, sf_dir).where("asset = 'LPT'")
    j = r.join(lpt_prices(r).select("id", "tick", "eth", "usd_price", "valuation_version"), "id").withColumn("amount_native", F.col("amount_normalized"))
    j = j.withColumn("amount_usd", F.expr("cast(cast(amount_normalized as decimal(12,2)) * cast(usd_price as decimal(24,18)) as decimal(38,18))"))
    seen = F.struct(F.when(F.col("tick").isNotNull(), F.col("delta")).cast("string").alias("delta"), F.col("tick").alias("arithmetic_mean_tick"), F.when(F.col("tick").isNull(), F.col("root")).alias("sqrt_price_x96"))
    source = F.when(F.col("tick").isNotNull(), "uniswap_v3_twap_30min").otherwise("uniswap_v3_spot")
    pool = F.struct(F.lit("LPT").alias("asset"), F.lit("WETH").alias("quote"), F.col("eth").cast("string").alias("price"), source.alias("source"), F.expr("id div 4").alias("block_number"), F.to_json(seen).alias("raw"))
    steps = F.concat(F.lit('{"steps":['), F.to_json(pool), F.lit(","), F.to_json(_dollar_step("WETH")), F.lit('],"result":'), F.to_json(_result("LPT")), F.lit("}"))
    return j.select("id", "valuation_version", steps.alias("pricing_chain"))


def halves(claims: DataFrame) -> DataFrame:
    """A claim's two valuations; a zero amount is a priced row of nothing."""
    both = F.explode(F.array(F.struct(F.lit("LPT").alias("asset"), F.col("rewards").alias("amount")), F.struct(F.lit("ETH").alias("asset"), F.col("fees").alias("amount"))))
    return claims.withColumn("h", both).select("id", "h.asset", "h.amount", F.when(F.col("h.amount") == 0, "no_amount").otherwise("priced").alias("method"))


@query("SELECT id, asset, amount, CASE WHEN amount = 0 THEN 'no_amount' ELSE 'priced' END AS method FROM (SELECT id, unnest(['LPT', 'ETH']) AS asset, unnest([k % 5, k % 3]) AS amount FROM ev WHERE event_name = 'TranscoderUpdate')")
def p5_multi_asset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halves(P.protocol_events(spark, sf_dir).where("event_name = 'TranscoderUpdate'").selectExpr("id", "k % 5 as rewards", "k % 3 as fees"))


_USD = "usd AS (SELECT block_number, CASE WHEN source = 'chainlink' THEN 'ETH' ELSE 'LPT' END AS asset, price FROM price)"


@query(f"""WITH h AS (SELECT id, block_number, unnest(['LPT', 'ETH']) AS asset, unnest([k % 5, k % 3]) AS amount FROM ev WHERE event_name = 'TranscoderUpdate'), {_USD}
SELECT h.id, h.asset, h.amount, CASE WHEN h.amount = 0 THEN 0 ELSE CAST(h.amount * u.price AS DOUBLE) END AS amount_usd, CASE WHEN h.amount = 0 THEN 'no_amount' WHEN u.price IS NULL THEN 'failed_missing_price' ELSE 'priced' END AS status
FROM h LEFT JOIN usd u ON u.block_number = h.block_number AND u.asset = h.asset""")
def p5_valued_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each claim by their own asset's price in its block; a half of nothing is worth nothing, one without a price has failed."""
    claims = P.protocol_events(spark, sf_dir).where("event_name = 'TranscoderUpdate'").selectExpr("id", "block_number", "k % 5 as rewards", "k % 3 as fees")
    h = halves(claims).join(claims.select("id", "block_number"), "id")
    usd = P.prices(spark, sf_dir).selectExpr("block_number", "if(source = 'chainlink', 'ETH', 'LPT') as asset", "price")
    j = h.join(usd, ["block_number", "asset"], "left")
    return j.selectExpr("id", "asset", "amount", "if(amount = 0, 0D, cast(amount * price as double)) as amount_usd", "case when amount = 0 then 'no_amount' when price is null then 'failed_missing_price' else 'priced' end as status")


def halves_by_ladders(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Both halves of claims (id, rewards, fees) by the ladders that other events go through: LPT by the pool and the oracle, ETH by the oracle.

    A half of nothing is priced at nothing, whatever the readings; one whose checks fail is a terminal row that names the check. ``found`` are the readings at the claims.
    """
    lpt = lpt_prices(found).select("id", F.lit("LPT").alias("asset"), "usd_price", "valuation_version")
    eth = found.withColumn("status", oracle_status(False)).where("status = 'ok'").select("id", F.lit("ETH").alias("asset"), F.expr(f"cast({ANSWER} as decimal(38,18))").alias("usd_price"), F.lit("v1_chainlink_eth").alias("valuation_version"))
    status = F.explode(F.array(F.struct(F.lit("LPT").alias("asset"), oracle_status(True).alias("status")), F.struct(F.lit("ETH").alias("asset"), oracle_status(False).alias("status"))))
    checked = found.withColumn("s", status).select("id", "s.asset", "s.status")
    j = halves(claims).join(checked, ["id", "asset"], "left").join(lpt.unionByName(eth), ["id", "asset"], "left")
    zero = F.col("amount") == 0
    return j.select(
        "id", "asset", "amount", F.when(zero, "no_amount").otherwise(F.coalesce("valuation_version", F.lit(P.DEGRADED))).alias("valuation_version"),
        F.when(zero, "priced").when(F.col("usd_price").isNotNull(), "priced").otherwise(F.concat(F.lit("failed_"), F.coalesce("status", F.lit("missing_oracle")))).alias("status"),
        F.when(zero, F.lit(0).cast("decimal(38,18)")).otherwise(F.expr("cast(amount * cast(usd_price as decimal(30,18)) as decimal(38,18))")).alias("amount_usd"),
    )


_CLAIMS = _READ.replace("WHERE is_valuable", "WHERE event_name = 'TranscoderUpdate'")
_ETH_OK = _LADDER.format(a="", b="")


@query("WITH " + _CLAIMS + f""", s AS (SELECT *, {_ELIGIBLE} AS lpt, {_ETH_OK} AS eth, CAST(floor(delta / 1800.0) AS BIGINT) AS mean FROM rd),
h AS (SELECT *, unnest(['LPT', 'ETH']) AS half, unnest([k % 5, k % 3]) AS amount, unnest([lpt, eth]) AS st FROM s)
SELECT id, half AS asset, amount, CASE WHEN amount = 0 THEN 'no_amount' WHEN half = 'ETH' AND st = 'ok' THEN 'v1_chainlink_eth' WHEN st = 'ok' THEN 'v1_lpt_weth_twap_30min_x_chainlink_eth' WHEN st = 'degraded' THEN 'v1_degraded_spot_pre_cardinality' ELSE 'v1_degraded' END AS valuation_version,
  CASE WHEN amount = 0 OR st IN ('ok', 'degraded') THEN 'priced' ELSE 'failed_' || st END AS status,
  CASE WHEN amount = 0 THEN 0 WHEN half = 'ETH' AND st = 'ok' THEN round(amount * (answer / 1e8::DOUBLE), 3) WHEN st = 'ok' THEN round(amount * pow(1.0001::DOUBLE, mean) * (answer / 1e8::DOUBLE), 3) WHEN st = 'degraded' THEN round(amount * ((1000 + k) / 4096.0::DOUBLE) * ((1000 + k) / 4096.0::DOUBLE) * (answer / 1e8::DOUBLE), 3) END AS amount_usd FROM h""")
def p5_halves_by_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of all claims through the ladders of single events; amounts are rounded to what doubles in SQL can confirm."""
    claims = P.protocol_events(spark, sf_dir).where("event_name = 'TranscoderUpdate'").selectExpr("id", "k % 5 as rewards", "k % 3 as fees")
    h = halves_by_ladders(claims, readings(spark, sf_dir, "event_name = 'TranscoderUpdate'"))
    return h.withColumn("amount_usd", F.round(F.col("amount_usd").cast("double"), 3))


_TERMINAL = _LADDER.format(a=" WHEN pool_empty AND asset = 'LPT' THEN 'missing_pool'", b="WHEN asset = 'LPT' AND cardinality < 144 THEN 'degraded' WHEN asset = 'LPT' AND observe_failed THEN 'missing_pool'")


@query("WITH " + _READ + f", s AS (SELECT id, asset, {_TERMINAL} AS status FROM rd) SELECT id, asset, 'v1_degraded' AS valuation_version, 'failed_' || status AS status, CAST(NULL AS DOUBLE) AS amount_usd FROM s WHERE status NOT IN ('ok', 'degraded')")
def p6_terminal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a value for each event that no later run can price, so that it is not tried again."""
    r = readings(spark, sf_dir)
    told = r.withColumn("status", F.when(F.col("asset") == "LPT", oracle_status(True)).otherwise(oracle_status(False))).where("status not in ('ok', 'degraded')")
    return told.selectExpr("id", "asset", f"'{P.DEGRADED}' as valuation_version", "concat('failed_', status) as status", "cast(null as double) as amount_usd")


@query("SELECT id FROM ev WHERE event_name = 'TranscoderUpdate' AND (k % 3 = 0 OR k % 4 = 0)")
def j11_claims_half_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of which one half or both have no value: half by half against what there is."""
    e = P.protocol_events(spark, sf_dir).where("event_name = 'TranscoderUpdate'")
    need = e.select("id", F.explode(F.array(F.lit("LPT"), F.lit("ETH"))).alias("asset"))
    have = e.where("k % 3 <> 0").select("id", F.lit("LPT").alias("asset")).union(e.where("k % 4 <> 0").select("id", F.lit("ETH").alias("asset")))
    return without(need, have, ["id", "asset"]).select("id").distinct()


@query("SELECT status, count(*) AS n, count(amount_usd) AS with_usd FROM val GROUP BY 1")
def p6_a25_terminal_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.valuations(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count("amount_usd").alias("with_usd"))


@query("SELECT DISTINCT block_number FROM val WHERE asset = 'LPT' AND block_number NOT IN (SELECT block_number FROM price WHERE source = 'uniswap_v3_twap_30min')")
def p6b_price_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = P.valuations(spark, sf_dir).where("asset = 'LPT'").select("block_number").distinct()
    return without(need, P.prices(spark, sf_dir).where("source = 'uniswap_v3_twap_30min'").select("block_number"), ["block_number"])


def numbered(attempts: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New attempts numbered after the largest old number of their key, by status and detail, null details first."""
    last = old.groupBy(*keys).agg(F.max("attempt").alias("last"))
    w = W.partitionBy(*keys).orderBy("status", F.asc_nulls_first("detail"), "tie")
    return attempts.withColumn("n", F.row_number().over(w)).join(last, keys, "left").withColumn("attempt", F.coalesce("last", F.lit(0)) + F.col("n")).drop("n", "last")


@query("""WITH new AS (SELECT id // 10 AS event_id, 'v1' AS version, status, CASE WHEN id % 3 = 0 THEN NULL ELSE 'd' || (id % 4) END AS detail, id AS tie FROM (SELECT event_id AS id, status FROM val WHERE valuation_version = 'v1')),
old AS (SELECT DISTINCT id // 10 AS event_id, 'v1' AS version, 3 AS attempt FROM ev WHERE k % 2 = 0)
SELECT event_id, version, status, detail, tie, coalesce((SELECT max(attempt) FROM old o WHERE o.event_id = new.event_id), 0) + row_number() OVER (PARTITION BY event_id, version ORDER BY status, detail NULLS FIRST, tie) AS attempt FROM new""")  # fmt: skip
def p6c_w9_attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.valuations(spark, sf_dir).where("valuation_version = 'v1'")
    new = v.selectExpr("event_id div 10 as event_id", "'v1' as version", "status", "if(event_id % 3 = 0, null, concat('d', event_id % 4)) as detail", "event_id as tie")
    old = P.protocol_events(spark, sf_dir).where("k % 2 = 0").selectExpr("id div 10 as event_id", "'v1' as version", "3 as attempt").distinct()
    return numbered(new, old, ["event_id", "version"]).select("event_id", "version", "status", "detail", "tie", F.col("attempt").cast("bigint").alias("attempt"))


@query("SELECT event_id // 10 AS grp, max(event_id) AS attempt, max_by(status, event_id) AS status FROM val WHERE valuation_version = 'v1' GROUP BY 1")
def w8_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.valuations(spark, sf_dir).where("valuation_version = 'v1'").selectExpr("event_id div 10 as grp", "event_id as attempt", "status")
    return latest_by(v, ["grp"], ["attempt"])


@query("SELECT v.event_id, v.valuation_version, v.asset FROM val v WHERE v.status = 'priced' AND v.event_id % 100 = 7")
def p6d_determinism_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a second computation does not confirm: here every hundredth is told to be off."""
    a = P.valuations(spark, sf_dir)
    b = a.withColumn("amount_usd", F.expr("cast(if(event_id % 100 = 7, amount_usd + 1, amount_usd) as decimal(38,18))"))
    keys, cols = ["event_id", "valuation_version", "asset"], ["amount_usd", "native_usd_price", "status"]
    j = a.select(*keys, F.struct(*cols).alias("x")).join(b.select(*keys, F.struct(*cols).alias("y")), keys, "full_outer")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).select(*keys)


@query("SELECT e.id FROM ev e WHERE e.is_valuable AND e.is_canonical AND NOT EXISTS (SELECT 1 FROM val v WHERE v.event_id = e.id AND v.valuation_version = 'v1' AND v.status = 'priced') AND NOT EXISTS (SELECT 1 FROM val v WHERE v.event_id = e.id AND v.valuation_version = 'v1_degraded' AND v.status LIKE 'failed_%')")
def j9_j10_unpriced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = P.protocol_events(spark, sf_dir).where("is_valuable and is_canonical").select("id"), P.valuations(spark, sf_dir).withColumnRenamed("event_id", "id")
    return without(without(e, v.where("valuation_version = 'v1' and status = 'priced'").select("id"), ["id"]), v.where("valuation_version = 'v1_degraded' and status like 'failed_%'").select("id"), ["id"])
