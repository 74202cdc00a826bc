from datetime import datetime

from pyspark.sql import functions as F
from tidemark.sources import commits
from tidemark.streaming import incremental as inc


def test_watermark():
    a, b = datetime(2024, 1, 2), datetime(2024, 1, 1)
    assert inc.advanced(a, None) == a and inc.advanced(a, b) == b and inc.advanced(b, a) == b and inc.advanced(None, b) is None
    assert inc.scan_floor(None) == datetime(1970, 1, 1) and inc.scan_floor(a, 60) == datetime(2024, 1, 1, 23, 59)


def test_late_and_repeated_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, day string, v long"
    build = lambda df: df.dropDuplicates(["id"]).groupBy("day").agg(F.sum("v").alias("v"))
    for rows in ([(1, "a", 1), (2, "b", 2)], [(3, "b", 5), (1, "a", 1)], [(4, "a", 7)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        inc.follow(spark, source, schema, target, state, build, lambda e: e, "day").awaitTermination()
        whole = build(spark.read.schema(schema).parquet(source))
        assert sorted(map(tuple, commits.read(spark, target, "rows").select("day", "v").collect())) == sorted(map(tuple, whole.collect()))


def test_a_day_that_loses_its_last_row_goes(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, day string, v long"
    build = lambda df: df.groupBy("day", "id").agg(F.sum("v").alias("v")).where("v > 0").groupBy("day").agg(F.sum("v").alias("v"))
    for rows in ([(1, "a", 1), (2, "b", 2), (9, "x y/%", 1)], [(1, "a", -1), (9, "x y/%", -1)], [(3, "c", 1)], [(3, "c", -1), (2, "b", -2)], [(4, "a", 7)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # a batch that finds nothing new changes nothing
            inc.follow(spark, source, schema, target, state, build, lambda e: e, "day").awaitTermination()
        whole = build(spark.read.schema(schema).parquet(source))
        left = commits.read(spark, target, "rows").select("day", "v").collect()
        assert sorted(map(tuple, left)) == sorted(map(tuple, whole.collect()))


def test_stored_tables_follow_their_sources(spark, tmp_path):
    from tidemark.sources.cubes import stored

    made = []

    def build(s, d):
        made.append(d)
        return s.read.parquet(f"{d}/t.parquet").groupBy("k").count()

    folder = str(tmp_path / "in")
    spark.range(6).selectExpr("id % 2 as k").write.parquet(f"{folder}/t.parquet")
    for _ in range(3):
        assert sorted(map(tuple, stored(spark, folder, "t", build).collect())) == [(0, 3), (1, 3)]
    assert len(made) == 1
    spark.range(9).selectExpr("id % 3 as k").write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert sorted(map(tuple, stored(spark, folder, "t", build).collect())) == [(0, 3), (1, 3), (2, 3)]
    stored(spark, folder, "t", build, refresh=True)
    assert len(made) == 3


def test_rows_in_nested_folders_are_seen(spark, tmp_path):
    from tidemark.sources.cubes import stored

    build = lambda s, d: s.read.parquet(f"{d}/t.parquet").groupBy().count()
    folder = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "'a' as day").write.partitionBy("day").parquet(f"{folder}/t.parquet")
    assert stored(spark, folder, "nested", build).first()[0] == 10
    spark.range(5).selectExpr("id", "'a' as day").write.mode("append").partitionBy("day").parquet(f"{folder}/t.parquet")
    assert stored(spark, folder, "nested", build).first()[0] == 15


def test_a_commit_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "day string, v long")
    seen = lambda name: sorted(map(tuple, commits.read(spark, root, name).select("day", "v").collect()), key=str)
    commits.commit(spark, root, {"rows": commits.Change(rows(("a", 1), ("b/%=", 2), (None, 3)), "day"), "dead": commits.Change(rows(("a", 9)), "day", append=True)}, {"at": 1})
    put = commits._put

    def broken(*args):
        raise OSError("no more")

    monkeypatch.setattr(commits, "_put", broken)
    for _ in range(2):
        try:
            commits.commit(spark, root, {"rows": commits.Change(rows(("a", 100)), "day", ["a", None]), "dead": commits.Change(rows(("a", 8)), "day", append=True)}, {"at": 2})
            raise AssertionError
        except OSError:
            pass
        assert seen("rows") == [("a", 1), ("b/%=", 2), (None, 3)] and seen("dead") == [("a", 9)] and commits.manifest(spark, root)["state"] == {"at": 1}
    monkeypatch.setattr(commits, "_put", put)
    commits.commit(spark, root, {"rows": commits.Change(rows(("a", 100)), "day", ["a", None]), "dead": commits.Change(rows(("a", 8)), "day", append=True)}, {"at": 2})
    assert seen("rows") == [("a", 100), ("b/%=", 2)] and seen("dead") == [("a", 8), ("a", 9)] and commits.manifest(spark, root)["state"] == {"at": 2}
    assert commits.swept(spark, root, keep=1) == 4 and seen("rows") == [("a", 100), ("b/%=", 2)] and seen("dead") == [("a", 8), ("a", 9)]
    commits.commit(spark, root, {"rows": commits.Change(rows(), "day", ["a", "b/%="])})
    assert seen("rows") == [] and commits.read(spark, root, "rows").columns == ["day", "v"]


def test_a_commit_number_is_given_once(spark, tmp_path):
    import pytest

    root = str(tmp_path / "t")
    was = commits.commit(spark, root, {}, {"at": 1})
    with pytest.raises(RuntimeError):
        commits._put(spark, root, was | {"state": {"at": 2}})
    assert commits.manifest(spark, root)["state"] == {"at": 1}


def test_a_repaired_cube_equals_one_made_anew_and_reads_touched_days_alone(spark, small):
    from tidemark.plans import rollups
    from tidemark.sources import cubes
    from tidemark.sources import protocol as P

    log = P.protocol_events(spark, small)
    asked = []
    for name, cube in rollups.CUBES.items():
        watched = cube._replace(build=lambda s, d, e, days, b=cube.build: (asked.append(days and sorted(r.day.day for r in days.collect())), b(s, d, e, days))[1])
        cubes.kept_up(spark, small, f"watched-{name}", watched, refresh=True, log=log)
        for change in ("not (id between 400 and 420 and event_name <> 'TranscoderUpdate')", "id not between 400 and 420", "true", "true"):
            after = log.where(change)
            got = cubes.kept_up(spark, small, f"watched-{name}", watched, log=after).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, cube.build(spark, small, after, None).collect())), (name, change)
        days = sorted({r.day.day for r in log.where("id between 400 and 420").selectExpr("to_date(block_timestamp) as day").collect()})
        carried = cube.carried != "false"
        assert asked[0] is None and asked[1] == days and (len(asked[2]) > len(days)) == carried and len(asked) == 4
        asked.clear()


def test_loops_go_on_while_files_come_and_stop_in_good_order(spark, tmp_path):
    import time

    schema, build = "id long, day string", lambda df: df.groupBy("day").agg(F.count("*").alias("n"))
    source = str(tmp_path / "in")
    put = lambda a, b: spark.range(a, b).selectExpr("id", "concat('d', id % 3) as day").coalesce(1).write.mode("append").partitionBy("day").parquet(source)
    put(0, 10)
    jobs = {n: (lambda trigger, n=n: inc.follow(spark, source, schema, str(tmp_path / n), str(tmp_path / f"{n}-state"), build, lambda e: e, "day", trigger=trigger)) for n in ("one", "two")}
    for a, b in ((10, 30), (30, 60)):  # the second time they are started again from their checkpoints
        loops = inc.Loops(jobs, "200 milliseconds")
        put(a, b)
        time.sleep(1)
        assert loops.tend() == {"one": True, "two": True}
        put(b, b + 5)
        loops.stop()
        assert not any(q.isActive for q in loops.running.values())
        whole = sorted(map(tuple, build(spark.read.schema(schema).parquet(source)).collect()))
        for n in jobs:
            assert sorted(map(tuple, commits.read(spark, str(tmp_path / n), "rows").select("day", "n").collect())) == whole


def test_a_loop_that_fails_is_started_again(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).coalesce(1).write.parquet(source)
    left = [2]

    def work(batch, was, kept):
        if left[0]:
            left[0] -= 1
            raise OSError("once more")
        return {"rows": commits.Change(batch)}

    start = lambda trigger: inc.in_batches(spark.readStream.schema("id long").parquet(source), target, str(tmp_path / "state"), work, trigger)
    loops = inc.Loops({"a": start}, "100 milliseconds", tries=3)
    for _ in range(100):
        if loops.tend()["a"] and not left[0] and commits.manifest(spark, target)["number"]:
            break
        __import__("time").sleep(0.2)
    loops.stop()
    assert len(loops.failed["a"]) <= 2 and commits.read(spark, target, "rows").count() == 5


def _chunks(spark, tmp_path, critical=False):
    from tidemark.functions.abi import Event, Param, decoded

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = {("c", "aa"): Event("E", (Param("n", "uint256"),), critical)}
    put = lambda *rows: spark.createDataFrame([(i, "c", b, f"d{b % 2}", ["aa"], d) for i, b, d in rows], "id long, contract string, block_number long, day string, topics array<string>, data string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: inc.ingest(spark, source, "id long, contract string, block_number long, day string, topics array<string>, data string", target, state, lambda c: decoded(c, events, ("id", "contract", "block_number", "day")), ["id"], "day").awaitTermination()
    seen = lambda: tuple(sorted(r[0] for r in commits.read(spark, target, n).select("id").collect()) for n in ("rows", "dead")) + (commits.read(spark, target, "checkpoints").first().block_number,)
    return put, run, seen


def test_a_chunk_is_kept_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    import pytest

    put, run, seen = _chunks(spark, tmp_path)
    good, bad = "0x" + "0" * 64, "0x12"
    put((1, 1, good), (2, 2, bad))
    run()
    assert seen() == ([1], [2], 2)
    put((3, 3, good), (4, 4, bad), (1, 1, good), (2, 2, bad))
    own, left = commits._put, []
    monkeypatch.setattr(commits, "_put", lambda *a: left.append(1) or (_ for _ in ()).throw(OSError("broken off")))
    with pytest.raises(Exception, match="broken off"):
        run()
    assert left and seen() == ([1], [2], 2)
    monkeypatch.setattr(commits, "_put", own)
    run()
    assert seen() == ([1, 3], [2, 4], 4)
    run()
    assert seen() == ([1, 3], [2, 4], 4)


def test_a_critical_event_that_cannot_be_decoded_halts(spark, tmp_path):
    import pytest

    put, run, seen = _chunks(spark, tmp_path, critical=True)
    put((1, 1, "0x" + "0" * 64))
    run()
    put((2, 2, "0x" + "0" * 64), (3, 3, "0x12"))
    with pytest.raises(Exception, match="critical events cannot be decoded"):
        run()
    assert seen() == ([1], [], 1)


def test_keys_are_seen_once_however_late_and_no_state_is_kept(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("a", "d1"), ("a", "d1"), ("b", "d1"), (None, "d1"), ("a", "d2"), (None, None), ("a", "d1"), ("c", "d1"), (None, None), ("b", "d1"), ("d", None)]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "k string, day string").coalesce(1).write.mode("append").parquet(source)
        query = inc.first_seen(spark, source, "k string, day string", ["k"], "day", target, state)
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
        got = [tuple(r) for r in commits.read(spark, target, "rows").select("k", "day").collect()]
        assert len(got) == len(set(got)) and set(got) == set(rows[: i + 3])


def test_refreshed_rows_equal_all_derived_again(spark, tmp_path):
    from tidemark.sources.cubes import refreshed

    root, log, asked = str(tmp_path / "t"), [], []

    def build(keys):
        asked.append({r.k for r in keys.collect()})
        df = spark.createDataFrame(log, "k string, v int").where("v >= 0")
        return df.join(keys, "k", "left_semi").groupBy("k").agg(F.max("v").alias("v"))

    for more in ([(f"k{i}", i) for i in range(40)], [("k3", 99), ("new", 1)], [], [("k3", 100)]):
        log += more
        keys = spark.createDataFrame([(k,) for k, _ in more], "k string")
        got = {r.k: r.v for r in refreshed(spark, root, "k", keys, build, 8).collect()}
        want = {}
        for k, v in log:
            want[k] = max(v, want.get(k, -1))
        assert got == want and asked[-1] == {k for k, _ in more}
    log = [x for x in log if x[0] != "new"]
    assert "new" not in {r.k for r in refreshed(spark, root, "k", spark.createDataFrame([("new",)], "k string"), build, 8).collect()}


def test_a_chunk_is_decoded_once(spark, tmp_path):
    from pyspark import TaskContext

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(40).selectExpr("id", "'c' as contract", "id as block_number", "'d' as day").coalesce(1).write.parquet(source)
    seen = spark.sparkContext.accumulator(0)

    def decode(chunk):
        def run(batches):
            assert TaskContext.get() is not None
            for b in batches:
                seen.add(len(b))
                yield b.assign(error=[None if i % 2 else "odd" for i in b.id], critical=False)

        return chunk.mapInPandas(run, "id long, contract string, block_number long, day string, error string, critical boolean")

    inc.ingest(spark, source, "id long, contract string, block_number long, day string", target, state, decode, ["id"], "day").awaitTermination()
    assert seen.value == 40 and commits.read(spark, target, "rows").count() == 20 and commits.read(spark, target, "dead").count() == 20
