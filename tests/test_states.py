import hashlib

from tidemark.operators.reads import Call, answered, hash_of
from tidemark.plans import states

CALL = Call("info", "0badcafe", (("address", "who"), ("uint256", "n")), (("a", "uint256"), ("b", "bool")))


def test_a_call_is_hashed_by_its_data_contract_and_block(spark):
    df = spark.createDataFrame([("0x" + "ab" * 20, 5, 77)], "who string, n long, block_number long")
    params = '{"to":"c","data":"0x0badcafe' + "0" * 24 + "ab" * 20 + f"{5:064x}" + '"}'
    want = hashlib.sha256(b"eth_call\0" + params.encode() + b"\0" + (77).to_bytes(8, "big")).hexdigest()
    assert df.select(hash_of(CALL, "c")).first()[0] == want


def test_calls_without_an_answer_and_answers_that_do_not_fit(spark):
    df = spark.createDataFrame([(i, "0x" + "00" * 20, i, 1) for i in range(6)], "id int, who string, n long, block_number long")
    word = lambda n: f"{n:064x}"
    data = {0: "0x" + word(2**255) + word(1), 1: word(7) + word(0), 2: "0x" + word(7) + word(2), 3: "0x" + word(7), 4: None}
    hashes = {r.id: r.h for r in df.select("id", hash_of(CALL, "c").alias("h")).collect()}
    memo = spark.createDataFrame([(hashes[i], d) for i, d in data.items()], "call_hash string, response string")
    got = {r.id: r for r in answered(df, [CALL], "c", memo).collect()}
    assert got[0].info.a == str(2**255) and got[0].info.b == "true" and got[1].info.b == "false"
    assert [(got[i].missing, got[i].unfit) for i in range(6)] == [("", ""), ("", ""), ("", "info"), ("", "info"), ("", "info"), ("info", "")] and got[2].info is None


def test_an_endless_round_is_the_largest_one(spark):
    t = spark.createDataFrame([("g", "0x" + "01" * 20, 9)], "gateway string, gateway_hex string, block_number long")
    h = lambda c: t.select(hash_of(c, states.BROKER)).first()[0]
    memo = spark.createDataFrame([(h(states.SENDER), f"{10**18:064x}" + "f" * 64 + f"{1:064x}" + f"{0:064x}"), (h(states.UNLOCK), f"{1:064x}")], "call_hash string, response string")
    r = states.gateway_states(t, memo).first()
    assert (format(r.deposit, "f"), format(r.reserve, "f"), r.withdraw_round, r.unlock_in_progress) == ("1.000000000000000000", "0.000000000000000001", 2**63 - 1, True)


def test_calls_share_one_scan_of_touches_and_one_shuffle_of_the_memo(spark, small):
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        plan = states.p12_gateway_states(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    # a reused exchange is a leaf, so what is beneath it is counted once
    assert plan.count("FileScan parquet") == 1 and plan.count("Union") == 1 and plan.count("ReusedExchange") == 3
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_an_endless_answer_that_is_cut_short_does_not_fit(spark):
    rows = [("g", 4, 17), ("g", 5, 20), ("g", 4 * 7, 115)]  # 17 is broken, 20 endless, 115 both
    t = spark.createDataFrame(rows, "gateway string, block_number long, id long").withColumn("gateway_hex", states.F.expr(states.address("gateway")))
    told = "if(id % 5 = 0, concat(left(_r, 66), repeat('f', 64), substring(_r, 131)), _r)"
    memo = states.memo_of(t, states.SENDER, states.BROKER, ["id"] * 4, "id % 11 = 6 or id = 115", told)
    got = {r.id: r for r in answered(t, [states.SENDER, states.UNLOCK], states.BROKER, memo.unionByName(states.memo_of(t, states.UNLOCK, states.BROKER, ["id = 20"]))).collect()}
    assert {i: (r.missing, r.unfit) for i, r in got.items()} == {17: ("", "sender"), 20: ("", ""), 115: ("", "sender")}
    assert got[20].sender.withdraw_round == str(2**256 - 1) and got[20].sender.claimed_in_round == "20" and got[20].unlock.in_progress == "true"
