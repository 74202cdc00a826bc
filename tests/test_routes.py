from datetime import datetime

import pytest
from tidemark.plans import routes


def test_kinds_and_days_out_of_range_are_refused():
    at = datetime(2024, 3, 1)
    assert routes.job_type() is None and routes.job_type("both") is None and routes.job_type("ai") == "ai"
    assert routes.trailing(at, None, 7, 3650) == (datetime(2024, 2, 23), at)
    assert routes.trailing(at, 0, 30, 365, clamp=True)[0] == datetime(2024, 2, 29)
    assert routes.trailing(at, 999, 30, 365, clamp=True)[0] == datetime(2023, 3, 2)
    for days in 0, 3651:
        with pytest.raises(ValueError):
            routes.trailing(at, days, 7, 3650)
    with pytest.raises(ValueError):
        routes.job_type("x")


def test_a_block_with_two_hashes_loses_its_events_once(spark):
    events = spark.createDataFrame([(1, 7, True), (2, 7, True), (3, 8, True), (4, 7, False)], "id long, block_number long, is_canonical boolean")
    found = spark.createDataFrame([(7, "0xA", "0xc"), (7, "0xB", "0xc")], "block_number long, block_hash string, chain_hash string")
    assert {r.id: r.is_canonical for r in routes.rewritten(events, found).collect()} == {1: False, 2: False, 3: True, 4: False}
    assert sorted((r.old_hash, r.affected) for r in routes.audited(events, found).collect()) == [("0xa", 2), ("0xb", 0)]


def test_values_on_one_side_alone_depart(spark):
    columns = "id long, pricing_method string, source string, status string, amount_native decimal(9,2), native_usd_price decimal(9,2), amount_usd decimal(9,2)"
    a = spark.createDataFrame([(1, "m", "s", "priced", None, None, None), (2, "m", "s", "priced", None, None, None)], columns)
    b = spark.createDataFrame([(2, "m", "s", "priced", None, None, None)], columns)
    assert [tuple(r) for r in routes.departures(a, b, ["id"]).collect()] == [(1, "pricing_method,source,status")]


def test_proposals_without_an_id_are_left_out(spark):
    made = [(1, 0, "ProposalCreated", True, '{"decoded":{"proposalId":"a"}}'), (2, 0, "ProposalCreated", True, '{"decoded":{"proposalId":""}}'), (3, 0, "ProposalCreated", True, None), (4, 0, "ProposalCreated", False, '{"decoded":{"proposalId":"b"}}')]
    g = spark.createDataFrame(made, "block_number long, log_index int, event_name string, is_canonical boolean, raw_event string")
    assert [r.proposal_id for r in routes.proposals_by_status(g).collect()] == ["a"]
    with pytest.raises(ValueError):
        routes.proposals_by_status(g, "x")
