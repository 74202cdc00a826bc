"""Tables whose partitions change together: a manifest names the folders that count, and one rename puts it in place.

A commit first writes the new partitions of each table into folders of its own and then the manifest, which has the folders of
all tables and whatever state belongs to them, such as a checkpoint. A run that breaks off before the rename has changed
nothing that a reader sees. One writer at a time; a second one that took the same number is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Of no partition, and of one whose value is null.
WHOLE, NOTHING = "", "__HIVE_DEFAULT_PARTITION__"


class Change(NamedTuple):
    """New rows of a table. ``keys`` are the partitions (values as text) that they replace, those without rows going; without keys all are
    replaced, and an appended change replaces none."""

    rows: DataFrame
    by: str | None = None
    keys: Sequence[str | None] | None = None
    append: bool = False


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    where, fs = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    where, fs = _place(spark, f"{root}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _loaded(spark: SparkSession, root: str, number: int) -> dict:
    where, fs = _place(spark, f"{root}/_manifests/{number:012}.json")
    data = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
    finally:
        data.close()


def manifest(spark: SparkSession, root: str) -> dict:
    """The last manifest: number, tables, state."""
    numbers = _numbers(spark, root)
    return _loaded(spark, root, numbers[-1]) if numbers else {"number": 0, "tables": {}, "state": {}}


def _key(folder: str) -> str | None:
    value = folder.partition("=")[2]
    return None if value == NOTHING else unquote(value)


def _named(key: str | None) -> str:
    return json.dumps(key)


def commit(spark: SparkSession, root: str, changes: dict[str, Change], state: dict | None = None) -> dict:
    """Write the changes of some tables, then put a manifest in place that has them; the other tables and partitions stay as they are."""
    last = manifest(spark, root)
    now = {"number": last["number"] + 1, "tables": dict(last["tables"]), "state": last["state"] if state is None else state}
    for name, change in changes.items():
        folder = f"commit={now['number']:012}-{uuid.uuid4().hex[:8]}"
        writer = change.rows.write.mode("errorifexists")
        (writer.partitionBy(change.by) if change.by else writer).parquet(f"{root}/{name}/{folder}")
        made = {_named(_key(f)): [f"{folder}/{f}"] for f in folders(spark, f"{root}/{name}/{folder}") if "=" in f} if change.by else {WHOLE: [folder]}
        old = last["tables"].get(name, {"parts": {}})["parts"]
        if change.append:
            parts = old | {k: old.get(k, []) + f for k, f in made.items()}
        else:
            gone = old if change.keys is None else {_named(k) for k in change.keys}
            parts = {k: f for k, f in old.items() if k not in gone} | made
        now["tables"][name] = {"by": change.by, "schema": change.rows.schema.jsonValue(), "parts": parts}
    _put(spark, root, now)
    return now


def _put(spark: SparkSession, root: str, now: dict) -> None:
    target, fs = _place(spark, f"{root}/_manifests/{now['number']:012}.json")
    draft, _ = _place(spark, f"{root}/_manifests/{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(now).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"commit {now['number']} of {root} is there already")


def read(spark: SparkSession, root: str, name: str, at: dict | None = None) -> DataFrame:
    """A table as the last manifest, or the one given, has it; conditions on its partition column choose folders."""
    table = (at or manifest(spark, root))["tables"][name]
    schema = StructType.fromJson(table["schema"])
    paths = [f"{root}/{name}/{f}" for own in table["parts"].values() for f in own]
    if not paths:
        return spark.createDataFrame([], schema)
    # the commit's folder shows as a column where partitions do
    shown = StructType([*schema.fields]).add("commit", StringType())
    return spark.read.schema(shown).option("basePath", f"{root}/{name}").parquet(*paths).select(*[F.col(f"`{f.name}`") for f in schema.fields])


def swept(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete what none of the last ``keep`` manifests names, and manifests before them; returns how many folders went. Not while another writes."""
    numbers = _numbers(spark, root)
    last = [_loaded(spark, root, n) for n in numbers[-keep:]]
    used = {f"{name}/{f.partition('/')[0]}" for m in last for name, t in m["tables"].items() for own in t["parts"].values() for f in own}
    names = {name for m in last for name in m["tables"]}
    gone = [f"{name}/{f}" for name in names for f in folders(spark, f"{root}/{name}") if f.startswith("commit=") and f"{name}/{f}" not in used]
    for path in [f"{root}/{g}" for g in gone] + [f"{root}/_manifests/{n:012}.json" for n in numbers[:-keep]]:
        removed(spark, path)
    return len(gone)


def removed(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)
