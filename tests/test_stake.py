import random
from decimal import Decimal

import pytest
from tidemark.plans.stake import registry, stake_rows
from tidemark.sources.protocol import ZERO

SCHEMA = "event_id long, block_number long, log_index int, event_name string, from_address string, to_address string, amount_normalized decimal(24,18), rewards string"


def frame(spark, events):
    return spark.createDataFrame([(i, b, l, n, f, t, None if a is None else Decimal(a), w) for i, b, l, n, f, t, a, w in events], SCHEMA)


def replay(events):
    """One event after the other, as plain Python."""
    state, rows, reg = {}, {}, {}
    for i, b, l, n, f, t, a, w in sorted(events, key=lambda e: e[1:3]):
        for d in dict.fromkeys([f, t] if n == "TransferBond" else [f]):
            if d is None:
                continue
            s = state.setdefault(d, {"bal": Decimal(0), "del": ZERO, "reg": False})
            to = t == d
            registers = n == "Bond" or (n == "TransferBond" and to)
            if not s["reg"] and (n in ("Unbond", "WithdrawStake", "Rebond") or (n == "TransferBond" and not to)):
                continue
            source = "earnings_claimed_bootstrap" if n == "EarningsClaimed" and not s["reg"] else "flow_derived"
            amount = Decimal(a or 0)
            s["bal"] += amount if n in ("Bond", "Rebond") else -amount if n == "Unbond" else Decimal(int(w or 0)) / 10**18 if n == "EarningsClaimed" else 0
            if n in ("Bond", "Unbond", "Rebond", "EarningsClaimed") and t is not None:
                s["del"] = t
            if registers and not s["reg"]:
                s["reg"], reg[d] = True, b
            rows[d, b] = (s["bal"], s["del"], source, i)
    return rows, reg, {d: s["bal"] for d, s in state.items()}


CASES = {
    "bond and claim": [(1, 100, 0, "Bond", "d", "a", 1000, None), (2, 200, 0, "EarningsClaimed", "d", "a", None, str(50 * 10**18))],
    "move": [(1, 100, 0, "Bond", "d", "a", 1000, None), (2, 200, 0, "Bond", "d", "b", 0, None)],
    "full unbond": [(1, 100, 0, "Bond", "d", "a", 1000, None), (2, 200, 0, "Unbond", "d", "a", 1000, None), (3, 300, 0, "WithdrawStake", "d", None, 1000, None)],
    "partial unbond": [(1, 100, 0, "Bond", "d", "a", 1000, None), (2, 200, 0, "Unbond", "d", "a", 400, None)],
    "rebond": [(1, 100, 0, "Bond", "d", "a", 1000, None), (2, 200, 0, "Unbond", "d", "a", 1000, None), (3, 300, 0, "Rebond", "d", "a", 1000, None)],
    "unbond before bond": [(1, 100, 0, "Unbond", "d", "a", 500, None), (2, 200, 0, "Bond", "d", "a", 1000, None)],
    "claim alone": [(1, 100, 0, "EarningsClaimed", "d", "a", None, str(10**18))],
    "transfer in": [(1, 100, 0, "TransferBond", "x", "d", 700, None)],
    "same block": [(1, 100, 0, "Bond", "d", "a", 1000, None), (2, 200, 0, "EarningsClaimed", "d", "a", None, str(10**19)), (3, 200, 1, "Bond", "d", "a", 90, None)],
    "late event": [(1, 100, 0, "Bond", "d", "a", 1000, None), (9, 150, 0, "Unbond", "d", "a", 1000, None), (3, 200, 0, "EarningsClaimed", "d", "a", None, "0")],
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    check(spark, CASES[case])


@pytest.mark.parametrize("span", [7, 40, 10**6])
def test_random_events(spark, span):
    r = random.Random(2)
    kinds = ["Bond", "Unbond", "Rebond", "WithdrawStake", "TransferBond", "EarningsClaimed"]
    who = ["d%d" % i for i in range(6)]
    check(spark, [(i, i // 3, i % 3, r.choice(kinds), r.choice(who), r.choice([*who, None]), r.choice([None, r.randint(0, 99)]), r.choice([None, str(r.randint(0, 10**19))])) for i in range(400)], span)


def check(spark, events, span=150):
    df = frame(spark, events)
    rows, reg, last = replay(events)
    got = {(x.delegator, x.block_number): (x.balance, x.delegate, x.source, x.event_id) for x in stake_rows(df, span).collect()}
    assert got == rows
    assert {x.delegator: (x.first_block, x.is_active) for x in registry(df, span).collect()} == {d: (b, last[d] > 0) for d, b in reg.items()}
