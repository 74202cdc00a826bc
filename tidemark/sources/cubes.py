"""Derived tables that are stored and kept up: leaderboards, buckets, summaries and states at a block read these.

They lie in the shared folder under the name of their source and outlive the application. Each commit notes the state of the
source's files. Where that has changed, a cube compares what each day of its log holds with what it held, and only days that
differ are derived anew; other tables are made again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import date
from functools import cache
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import commits
from tidemark.sources.storage import shared_root, write_events


class Cube(NamedTuple):
    """A table by day. ``build(spark, sf_dir, log, days)`` derives it from a log, of some days if they are given as rows (day).

    Rows of the log that ``carried`` (a condition) holds for change later days too. ``sides`` are other tables that it is made from; a change of
    theirs makes all of it anew."""

    build: Callable[..., DataFrame]
    log: Callable[[SparkSession, str], DataFrame]
    carried: str = "false"
    sides: tuple[Callable[[SparkSession, str], DataFrame], ...] = ()


@cache
def _code() -> str:
    """A digest of the package's own sources: what other code has stored is not read."""
    own = Path(__file__).resolve().parents[1]
    files = sorted(f for d in ("functions", "operators", "plans", "sources") for f in (own / d).glob("*.py"))
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()


def _state(spark: SparkSession, folder: str) -> str:
    """A digest of names, sizes and times of all files in a folder and the folders in it, and of the code that derives tables from them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, seen = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        s = found.next()
        seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr((_code(), sorted(seen))).encode()).hexdigest()


def root_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_root(spark)}/stored/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame], refresh: bool = False) -> DataFrame:
    """The table ``name`` of a folder's tables, written when it is first asked for and whenever they have changed."""
    root, state = root_of(spark, sf_dir, name), _state(spark, sf_dir)
    was = commits.manifest(spark, root)
    if refresh or was["state"].get("source") != state:
        was = commits.commit(spark, root, {"rows": commits.Change(build(spark, sf_dir).hint("rebalance"))}, {"source": state})
        commits.swept(spark, root)
    return commits.read(spark, root, "rows", was)


def stored_log(spark: SparkSession, sf_dir: str, name: str, log: Callable[[SparkSession, str], DataFrame], refresh: bool = False) -> str:
    """Where a log lies by day with its index of blocks; written when it is first asked for and whenever its source has changed."""
    root, state = root_of(spark, sf_dir, name), _state(spark, sf_dir)
    noted = commits.manifest(spark, f"{root}/state")["state"]
    if refresh or noted.get("source") != state:
        path = f"{root}/log-{state[:16]}" + (f"-{uuid.uuid4().hex[:8]}" if refresh else "")
        if refresh or not commits.manifest(spark, path)["tables"].get("blocks"):
            write_events(log(spark, sf_dir), path)
        noted = commits.commit(spark, f"{root}/state", {}, {"source": state, "path": path})["state"]
        for old in commits.folders(spark, root):
            if old.startswith("log-") and f"{root}/{old}" != path:
                commits.removed(spark, f"{root}/{old}")
    return noted["path"]


def bucketed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame], by: list[str], order: list[str], refresh: bool = False) -> DataFrame:
    """A stored table in buckets of ``by``, sorted by ``order``: what groups or windows by those keys reads it without a shuffle.

    Written when it is first asked for and whenever its source has changed; the number of buckets is that of shuffle partitions.
    """
    root, state = root_of(spark, sf_dir, name), _state(spark, sf_dir)
    n, noted = int(spark.conf.get("spark.sql.shuffle.partitions")), commits.manifest(spark, root)["state"]
    if refresh or noted.get("source") != state:
        path = f"{root}/rows-{uuid.uuid4().hex[:8]}"
        rows = build(spark, sf_dir).repartition(n, *by)
        table = f"tidemark_{uuid.uuid4().hex[:12]}"
        rows.write.bucketBy(n, *by).sortBy(*order).option("path", path).saveAsTable(table)
        was, noted = noted, commits.commit(spark, root, {}, {"source": state, "path": path, "n": n, "schema": rows.schema.jsonValue()})["state"]
        _TABLES[path] = table
        if was.get("path"):
            commits.removed(spark, was["path"])
    path = noted["path"]
    if path not in _TABLES or not spark.catalog.tableExists(_TABLES[path]):
        # another application wrote it; the table's name is this one's alone
        _TABLES[path] = f"tidemark_{uuid.uuid4().hex[:12]}"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(noted["schema"]).fields)
        spark.sql(f"create table {_TABLES[path]} ({fields}) using parquet clustered by ({', '.join(by)}) sorted by ({', '.join(order)}) into {noted['n']} buckets location '{path}'")
    return spark.table(_TABLES[path])


#: Names that this application has for tables in buckets, by where they lie.
_TABLES: dict[str, str] = {}


def prints(log: DataFrame, carried: str) -> DataFrame:
    """(day, n, own, carried): rows of a day, and sums over them that tell any change of them, and any of those that are carried."""
    row = F.xxhash64(*[F.col(c) for c in log.columns]).cast("decimal(38,0)")
    return log.groupBy(F.to_date("block_timestamp").alias("day")).agg(F.count("*").alias("n"), F.sum(row).alias("own"), F.coalesce(F.sum(F.when(F.expr(carried), row)), F.lit(0)).cast("decimal(38,0)").alias("carried"))


def noted_prints(log: DataFrame, carried: str) -> DataFrame:
    """``prints`` taken once, whoever reads them: a row a day comes to the driver."""
    found = prints(log, carried)
    return log.sparkSession.createDataFrame(found.collect(), found.schema).coalesce(1)


def touched_days(old: DataFrame, new: DataFrame) -> list[date]:
    """Days whose prints differ, and all from the first one on whose carried rows do; a row a day comes to the driver."""
    both = old.select("day", F.struct("n", "own", "carried").alias("was")).join(new.select("day", F.struct("n", "own", "carried").alias("now")), "day", "full_outer")
    seen = both.select("day", (~F.col("was").eqNullSafe(F.col("now"))).alias("own"), (F.coalesce("was.carried", F.lit(0)) != F.coalesce("now.carried", F.lit(0))).alias("carried")).collect()
    first = min((r.day for r in seen if r.carried and r.day is not None), default=None)
    return sorted(r.day for r in seen if r.day is not None and (r.own or (first is not None and r.day >= first)))


def _month(days: DataFrame) -> DataFrame:
    return days.withColumn("month", F.date_format("day", "yyyy-MM"))


def _sides(spark: SparkSession, sf_dir: str, cube: Cube) -> list[str]:
    made = []
    for side in cube.sides:
        rows = side(spark, sf_dir)
        r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(c) for c in rows.columns]).cast("decimal(38,0)")).alias("s")).first()
        made.append(f"{r.n} {r.s}")
    return made


def kept_up(spark: SparkSession, sf_dir: str, name: str, cube: Cube, refresh: bool = False, log: DataFrame | None = None, noted: DataFrame | None = None) -> DataFrame:
    """The stored cube in step with its source, or with ``log`` in its place, which asks to look at all days in any case. Cubes of one log
    and condition can share its prints as ``noted``.

    Partitions are months. A month with touched days is written again from its other days as they were stored and
    the touched ones as the log has them now; other months are not read. Rows and prints change in one commit.
    """
    root, state = root_of(spark, sf_dir, name), _state(spark, sf_dir)
    was = commits.manifest(spark, root)
    if not refresh and log is None and was["state"].get("source") == state:
        return commits.read(spark, root, "rows", was).drop("month")
    sides = _sides(spark, sf_dir, cube)
    now = cube.log(spark, sf_dir) if log is None else log
    # a log given in place of the source's is not what the source's files tell
    state = {"source": state if log is None else None, "sides": sides, "code": _code()}
    noted = noted_prints(now, cube.carried) if noted is None else noted
    days = None
    if not refresh and "rows" in was["tables"] and was["state"].get("sides") == sides and was["state"].get("code") == _code():
        days = touched_days(commits.read(spark, root, "prints", was), noted)
    if days is None:
        changes = {"rows": commits.Change(_month(cube.build(spark, sf_dir, now, None)), "month")}
    elif days:
        old, some = commits.read(spark, root, "rows", was), F.col("day").isin([F.lit(d) for d in days])
        months = sorted({f"{d:%Y-%m}" for d in days})
        rows = _month(cube.build(spark, sf_dir, now, spark.createDataFrame([(d,) for d in days], "day date")))
        rest = old.where(F.col("month").isin(months) & ~some)
        changes = {"rows": commits.Change(rest.unionByName(rows), "month", months)}
    else:
        changes = {}
    changes |= {"prints": commits.Change(noted)} if days is None or days else {}
    was = commits.commit(spark, root, changes, state)
    commits.swept(spark, root)
    return commits.read(spark, root, "rows", was).drop("month")


#: Parts that a refreshed table's keys are dealt to.
PARTS = 16


def refreshed(spark: SparkSession, root: str, key: str, touched: DataFrame, build: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> DataFrame:
    """A stored table with one row a ``key`` in which the keys that are ``touched`` are derived again by ``build(keys)``.

    Keys are dealt to parts by their hash. A part with touched keys is written again from its other rows as they were stored and the new ones; a key that
    ``build`` has no row for goes. Parts without touched keys are not read.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    touched = touched.select(key).distinct()
    own = [str(r[0]) for r in touched.select(part.alias("part")).distinct().collect()]
    rows = build(touched).withColumn("part", part)
    was = commits.manifest(spark, root)
    if "rows" in was["tables"]:
        old = commits.read(spark, root, "rows", was)
        rows = old.where(F.col("part").isin([int(p) for p in own])).join(touched, key, "left_anti").select(old.columns).unionByName(rows)
    now = commits.commit(spark, root, {"rows": commits.Change(rows, "part", own)}, was["state"])
    commits.swept(spark, root)
    return commits.read(spark, root, "rows", now).drop("part")
