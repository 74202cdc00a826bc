from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.functions import money as m


def test_tick_vectors():
    assert m.tick_to_sqrt_price(0) == 2**96
    assert m.tick_to_sqrt_price(-69945) == 2399491101333324816147508007
    assert m.tick_to_sqrt_price(-m.MAX_TICK) == 4295128739
    assert m.tick_to_sqrt_price(m.MAX_TICK) == 1461446703485210103287273052203988822378723970342
    assert m.tick_to_price(-69945).startswith("0.0009172")
    assert m.tick_to_price(None) is None


def test_tick_out_of_range():
    with pytest.raises(ValueError):
        m.tick_to_sqrt_price(m.MAX_TICK + 1)


@given(st.integers(-m.MAX_TICK + 1, m.MAX_TICK))
def test_ticks_rise(t):
    assert m.tick_to_sqrt_price(t) > m.tick_to_sqrt_price(t - 1)


def test_mean_tick_is_floored(spark):
    assert m.mean_tick(-1) == -1 and m.mean_tick(1801) == 1
    row = spark.sql("select -1L as d union all select 1801L union all select -3600L").select(F.expr(m.mean_tick_sql("d")).alias("t"))
    assert sorted(r.t for r in row.collect()) == [-2, -1, 1]


def test_commission_and_shares(spark):
    df = spark.sql("select cast(10 as decimal(24,18)) as a, 250000 as s, cast(null as int) as n")
    row = df.select(F.expr(m.commission("a", "s")).alias("c"), F.expr(m.part("a", "s")).alias("p"), F.expr(m.part("a", "n")).alias("n")).first()
    assert row.c == Decimal("7.5") and row.p == Decimal("2.5") and row.n is None


def test_wei_without_loss(spark):
    df = spark.createDataFrame([("1",), ("12345678901234567890123",), ("x",), (None,), ("9" * 60,)], "raw string")
    got = [r.w for r in df.select(m.wei("raw").alias("w")).collect()]
    assert got == [Decimal("0.000000000000000001"), Decimal("12345.678901234567890123"), None, None, None]
    assert m.wide_wei("9" * 60) == "9" * 42 + "." + "9" * 18


def test_gas_fee_is_exact(spark):
    df = spark.sql("select cast(21001 as decimal(20,0)) u, cast(null as decimal(20,0)) e, cast(1500000007 as decimal(20,0)) p")
    assert df.select(m.gas_fee("u", "e", "p").alias("f")).first().f == Decimal("0.000031501500147007")


def test_percents_and_text(spark):
    df = spark.sql("select '250000' as r, 'oops' as x, '12.3400' as d, '5.000' as i, '7' as w")
    row = df.select(m.percent("r").alias("a"), m.inverse_percent("r").alias("b"), m.percent("x").alias("c"), m.normalised("d").alias("d"), m.normalised("i").alias("e"), m.normalised("w").alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (Decimal("25"), Decimal("75"), None, "12.34", "5", "7")


def test_oracle_ladder_order(spark):
    base = "false feed_empty, 0 sequencer_answer, false pool_empty, false aggregator_empty, 5 answered_in_round, 5 round_id, 10 age_s, 100 answer, 200 cardinality, false observe_failed"
    cases = {"": "ok", "true feed_empty": "missing_oracle", "1 sequencer_answer": "sequencer_outage", "true pool_empty": "missing_pool", "4 answered_in_round": "missing_oracle", "86401 age_s": "missing_oracle", "0 answer": "missing_oracle", "143 cardinality": "degraded", "true observe_failed": "missing_pool"}
    for change, want in cases.items():
        cols = {c.split()[-1]: c for c in base.split(", ")} | ({change.split()[-1]: change} if change else {})
        assert spark.sql("select " + ", ".join(cols.values())).select(m.oracle_status(True).alias("s")).first().s == want


def test_buckets_in_a_zone(spark):
    df = spark.sql("select timestamp_ntz '2024-03-10 07:30:00' as t union all select timestamp_ntz '2024-03-11 03:59:00'")
    got = sorted(str(r.b) for r in df.select(m.tz_bucket("day", "t", "America/New_York").alias("b")).collect())
    assert got == ["2024-03-10 05:00:00", "2024-03-10 05:00:00"]


def test_words_of_256_bits_as_text(spark):
    r = __import__("random").Random(5)
    values = [0, 1, 2**64 - 1, 2**64, 2**64 + 5, 2**120 - 1, 2**120, 2**128, 10**38, 2**256 - 1] + [r.getrandbits(r.randint(1, 256)) for _ in range(300)]
    df = spark.createDataFrame([(str(v), f"{v:064x}") for v in values], "want string, w string")
    assert [(a, b) for a, b in df.selectExpr("want", f"{m.uint_text('w')} as got").collect() if a != b] == []


def test_price_by_the_pool_s_own_root():
    assert m.root_to_price(str(1 << 96)) == "1." + "0" * 30 and m.root_to_price(str(3 << 95)) == "2.25" + "0" * 28 and m.root_to_price(None) is None
    assert m.root_to_price(str(m.tick_to_sqrt_price(-777))) == m.tick_to_price(-777)


def test_answers_keep_their_eight_decimals(spark):
    from tidemark.plans.valuation import ANSWER

    df = spark.sql(f"select {ANSWER} as usd from values (12345678901L), (1L) as t(answer)")
    assert df.schema["usd"].dataType.simpleString() == "decimal(14,8)"
    assert [r.usd for r in df.collect()] == [Decimal("123.45678901"), Decimal("0.00000001")]  # as numbers: the smallest one arrives as 1.0E-8


def test_lpt_prices_have_all_places(spark, small):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    from tidemark.functions.money import root_to_price, tick_to_price
    from tidemark.plans import valuation

    found = {r.id: r for r in valuation.readings(spark, small).where("asset = 'LPT'").collect()}
    got = valuation.p3_lpt_prices_whole(spark, small).collect()
    assert len(got) > 50
    with localcontext() as c:
        c.prec = 90
        for r in got:
            f = found[r.id]
            eth = Decimal(tick_to_price(f.delta // 1800) if r.tick is not None else root_to_price(f.root)).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP)
            assert r.eth == eth and r.tick == (f.delta // 1800 if r.tick is not None else None)
            usd = eth * f.answer / 10**8
            assert abs(r.usd_price - usd) <= Decimal(1).scaleb(-18), (r, usd)


def test_chains_of_lpt_prices_lead_to_their_results(spark, small):
    import json
    from decimal import Decimal, localcontext

    from tidemark.plans import valuation

    rows = valuation.j4_lpt_pricing_chain(spark, small).collect()
    assert {json.loads(r.pricing_chain)["steps"][0]["source"] for r in rows} == {"uniswap_v3_twap_30min", "uniswap_v3_spot"}
    with localcontext() as c:
        c.prec = 90
        for r in rows:
            chain = json.loads(r.pricing_chain)
            pool, oracle, result = *chain["steps"], chain["result"]
            assert [(s["asset"], s["quote"]) for s in (pool, oracle, result)] == [("LPT", "WETH"), ("WETH", "USD"), ("LPT", "USD")]
            assert Decimal(oracle["price"]) == Decimal(oracle["raw_round"]["answer"]) / 10**8
            assert abs(Decimal(pool["price"]) * Decimal(oracle["price"]) - Decimal(result["price"])) <= Decimal(1).scaleb(-17)
            assert abs(Decimal(result["price"]) * Decimal(result["amount_native"]) - Decimal(result["amount_usd"])) <= Decimal(1).scaleb(-17)
