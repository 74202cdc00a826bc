import random

import pytest
from pyspark.sql import functions as F
from tidemark.plans import operations, rollups
from tidemark.plans.catalogue import QUERIES
from tidemark.sources import commits, cubes, storage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, block_number long, contract_name string, event_name string, at string").withColumn("block_timestamp", F.col("at").cast("timestamp_ntz")).drop("at")


def test_blocks_choose_days_and_days_choose_partitions(spark, tmp_path):
    r, root = random.Random(3), str(tmp_path / "log")
    rows = [(i, i // 3, r.choice("AB"), r.choice("xyz"), f"2024-01-{1 + i // 60:02} 0{i // 30 % 2}:00:00") for i in range(600)]
    storage.write_events(events(spark, rows[:400]), root)
    storage.write_events(events(spark, rows[400:]), root)
    for first, last in (0, 10), (50, 120), (None, 30), (190, None), (500, 600), (None, None):
        got = storage.scan_logs(spark, root, "A", ["x", "y"], first, last)
        want = [i for i, b, c, n, _ in rows if c == "A" and n in "xy" and (first is None or b >= first) and (last is None or b <= last)]
        assert sorted(x.id for x in got.select("id").collect()) == want
        if first == 50:
            text = plan(got)
            assert "PartitionFilters: [isnotnull(day_utc" in text or "PartitionFilters: [day_utc" in text
            days = {f.split("day_utc=")[1][:10] for f in got.inputFiles()}
            assert storage.days_of_blocks(spark, root, 50, 120) == sorted({__import__("datetime").date.fromisoformat(x[4][:10]) for x in rows if 50 <= x[1] <= 120}) and len(days) >= 1
    w = storage.block_window(spark, root, 55, 130).first()
    assert str(w.first_at) == min(x[4] for x in rows if x[1] >= 55) and str(w.last_at) == max(x[4] for x in rows if x[1] <= 130)
    none = storage.block_window(spark, root, 10**6, -1).first()
    assert none.first_at is None and none.last_at is None


def test_reports_look_back_without_a_shuffle(spark, small):
    for name in "j5_rewards_report", "k10_ticket_history":
        text = plan(QUERIES[name](spark, small))
        above = text.partition("Window")[2].partition("Scan parquet")[0] or text
        assert "Exchange hashpartitioning" not in above, text
    assert "Exchange" not in plan(QUERIES["j5_rewards_report"](spark, small))


@pytest.mark.parametrize("span", [1, 40, 10**6])
def test_stored_shares_are_those_of_an_as_of_join(spark, small, monkeypatch, span):
    from tidemark.sources import protocol as P

    monkeypatch.setattr(rollups, "AS_OF_BLOCKS", span)
    rollups.report_log(spark, small, refresh=True)
    for name in rollups.REPORTED:
        got = {r.id: r.share for r in rollups.reported(spark, small, name).collect()}
        e = rollups.final_events(spark, small).where(f"event_name = '{name}'")
        assert got == {r.id: r.share for r in rollups.with_shares(e, P.protocol_events(spark, small)).collect()}
    monkeypatch.undo()
    rollups.report_log(spark, small, refresh=True)


def test_buckets_are_read_by_another_application(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(50).selectExpr("id % 7 as k", "id as v").write.parquet(f"{folder}/t.parquet")
    built = []
    build = lambda s, d: built.append(1) or s.read.parquet(f"{d}/t.parquet")
    one = sorted(map(tuple, cubes.bucketed(spark, folder, "b", build, ["k"], ["k", "v"]).collect()))
    cubes._TABLES.clear()
    two = cubes.bucketed(spark, folder, "b", build, ["k"], ["k", "v"])
    assert one == sorted(map(tuple, two.collect())) and len(one) == 50 and built == [1]
    assert "Exchange" not in plan(two.groupBy("k").agg(F.sum("v")))
    spark.range(9).selectExpr("id % 7 as k", "id as v").write.mode("append").parquet(f"{folder}/t.parquet")
    assert cubes.bucketed(spark, folder, "b", build, ["k"], ["k", "v"]).count() == 59 and built == [1, 1]


def test_a_stored_log_follows_its_source(spark, tmp_path):
    folder = str(tmp_path / "in")
    put = lambda a, b: spark.range(a, b).selectExpr("id", "id div 2 as block_number", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as block_timestamp").write.mode("append").parquet(f"{folder}/t.parquet")
    put(0, 4)
    log = lambda s, d: s.read.parquet(f"{d}/t.parquet")
    one = cubes.stored_log(spark, folder, "sl", log)
    assert cubes.stored_log(spark, folder, "sl", log) == one and commits.read(spark, one, "rows").count() == 4
    put(4, 7)
    two = cubes.stored_log(spark, folder, "sl", log)
    assert two != one and storage.block_days(spark, two).count() == 7


def test_only_views_are_asked_and_no_code_is_run(spark):
    spark.range(3).createOrReplaceTempView("tidemark_seen")
    for bad in (
        "select reflect('java.lang.System', 'getenv', 'HOME')", "select java_method('java.lang.System', 'getenv', 'HOME')", "select * from parquet.`/etc`", "select * from `csv`.`/etc/passwd`", "select * from text . `/etc/passwd`",
        "with a as (select try_reflect('java.lang.System', 'exit', 1)) select * from a", "select (select max(value) from text.`/etc/passwd`)", "select * from other_table", "select * from spark_catalog.default.x", "select * from read_files('/etc')",
        "select id from tidemark_seen where exists (select 1 from json.`/etc`)", "select raise_error('x')", "select input_file_name() from tidemark_seen",
    ):
        with pytest.raises(ValueError):
            operations.guarded(bad, spark=spark, views=("tidemark_seen",))
    for good in "select max(id) from tidemark_seen", "with a as (select id from tidemark_seen) select * from a join tidemark_seen b using (id)", "select 'reflect(x)' as a, '`csv`.`/etc`' as b", "select * from values (1), (2) t(x)":
        assert spark.sql(operations.guarded(good, spark=spark, views=("tidemark_seen",))).count() >= 0
