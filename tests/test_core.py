import random

import pytest
from tidemark.operators import core
from tidemark.plans import operations
from tidemark.plans.operations import guarded
from tidemark.plans.rollups import period, route


@pytest.mark.parametrize("span", [None, 1, 4, 100])
def test_as_of_join_against_a_loop(spark, span):
    r = random.Random(4)
    points = [(r.choice("abc"), r.randint(0, 30), r.randint(0, 2), r.choice([None, r.randint(0, 9)])) for _ in range(60)]
    points = list({p[:3]: p for p in points}.values())
    probes = [(i, r.choice(["a", "b", "c", "d", None]), r.randint(0, 32), r.randint(0, 2)) for i in range(150)]
    a, b = spark.createDataFrame(probes, "i int, k string, b int, l int"), spark.createDataFrame(points, "k string, b int, l int, v int")
    got = core.as_of_join(a, b, ["k"], ["b", "l"], ["v"], span)
    want = {i: max(((p[1:3], p[3]) for p in points if p[0] == k and p[1:3] <= (b, l)), key=lambda x: x[0], default=(0, None))[1] for i, k, b, l in probes}
    assert {x.i: x.v for x in got.collect()} == want


def test_as_of_join_takes_the_same_place(spark):
    points = spark.createDataFrame([("a", 5, 1, "x"), ("a", 5, 2, "y")], "k string, b int, l int, v string")
    probes = spark.createDataFrame([("a", 5, 1), ("a", 5, 0)], "k string, b int, l int")
    assert sorted(((r.l, r.v) for r in core.as_of_join(probes, points, ["k"], ["b", "l"], ["v"]).collect()), key=str) == [(0, None), (1, "x")]


def test_latest_by_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 1, "n")], "k string, o int, v string")
    assert sorted(map(tuple, core.latest_by(df, ["k"], ["o"]).collect()), key=str) == [("a", 2, None), (None, 1, "n")]


def test_keyset_pages_cover_all(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(23)], "v int, id int")
    seen, after = [], None
    while True:
        page = core.keyset_page(df, [("v", True), ("id", False)], after, 4).collect()
        if not page:
            break
        seen += [tuple(r) for r in page]
        after = tuple(page[-1])
    assert seen == sorted(((i % 5, i) for i in range(23)), key=lambda x: (-x[0], x[1]))


def test_reconciled(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "q"), (4, "w")], "k int, v string")
    got = {r.k: r.state for r in core.reconciled(a, b, ["k"], ["v"]).collect()}
    assert got == {1: "missing_right", 2: "matched", 3: "mismatch", 4: "missing_left"}


def test_periods_and_routes():
    from datetime import date

    assert period("weekly", date(2024, 1, 10)) == (date(2024, 1, 8), date(2024, 1, 14))
    assert period("monthly", date(2024, 2, 10)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert route(date(2024, 1, 1), date(2024, 1, 2)) == "rollup"
    assert route(date(2024, 1, 3), date(2024, 1, 2)) == route(date(2024, 1, 1), date(2024, 1, 2), address="a") == "raw"


def test_guard():
    assert guarded("select 1;") == "SELECT * FROM (select 1) LIMIT 1000"
    for bad in ("drop table x", "select 1; select 2", "with a as (select 1) delete from b"):
        with pytest.raises(ValueError):
            guarded(bad)


def test_pages_over_nulls_cover_all_rows_in_order(spark):
    rows = [(i, v) for i, v in enumerate([3, None, 1, 1, None, 2, None, 3])]
    df = spark.createDataFrame(rows, "id long, v int")
    for desc in True, False:
        after, seen = None, []
        while page := core.keyset_page(df, [("v", desc), ("id", False)], after, 3).collect():
            seen += [(r.id, r.v) for r in page]
            after = (page[-1].v, page[-1].id)
        assert seen == sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0) if desc else r[1] or 0, r[0]))
        after, seen = None, []
        while page := core.keyset_page(df, [("id", desc), ("v", False)], after, 3).collect():
            seen += [r.id for r in page]
            after = (page[-1].id, page[-1].v)
        assert seen == sorted(range(8), reverse=desc)


def test_a_page_tells_whether_more_follow(spark):
    df = spark.range(7)
    for after, want, more in (None, [0, 1, 2], True), ((2,), [3, 4, 5], True), ((3,), [4, 5, 6], False), ((6,), [], None):
        page = operations.page_of(df, [("id", False)], after, 3).orderBy("id").collect()
        assert [r.id for r in page] == want and {r.has_more for r in page} <= {more}


def test_words_in_literals_are_no_statements():
    for sql in "select 'drop table x; delete from y' as a", 'select "update" from t', "select 1 as `create table`", "with a as (select 1 -- insert into b\n) select * from a", "select last_update from t":
        assert guarded(sql).startswith("SELECT * FROM (")


def test_ends_are_blocks_or_days():
    from datetime import datetime

    assert operations.endpoint(None) == (None, None) and operations.endpoint("12") == (12, None)
    assert operations.endpoint("2024-02-29") == (None, datetime(2024, 2, 29))
    for bad in "", "2024-02-30", "x", "12.5":
        with pytest.raises(ValueError):
            operations.endpoint(bad)
    assert operations.limit_of("events") == 100 and operations.limit_of("events", 10**6) == 1000 and operations.limit_of("votes", 0) == 0 and operations.limit_of("delegators") == 50 and operations.limit_of("prices", 10**6) == 10000


def test_cubes_of_one_log_share_its_prints(spark, small, monkeypatch):
    from tidemark.plans import rollups
    from tidemark.sources import cubes

    taken, real = [], cubes.prints
    monkeypatch.setattr(cubes, "prints", lambda log, carried: taken.append(carried) or real(log, carried))
    assert rollups.p22_cubes_after_repair(spark, small).count() > 0
    assert sorted(taken) == sorted(2 * [rollups._UPDATES, "false"])  # of the log before and after
