"""Operators that the queries compose: as-of join, latest per key, keyset pages, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of_join(probe: DataFrame, points: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], span: int | None = None) -> DataFrame:
    """``probe`` with the ``values`` of the last point at or before it in ``order``, for equal ``keys``.

    Both sides go through one shuffle on the keys; a point comes before a probe of the same place, and
    is taken whole, nulls in it too. Without a point the values are null. Null keys or places match nothing.

    With a ``span`` a key's rows are dealt by ranges of so many of the first order column, so that a key which
    has a large part of all rows is the work of many tasks: the last point of each range, one row a
    key and range, is carried into the ranges after it.
    """
    ks, os_ = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    places = [F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)] + [F.col(o).alias(n) for o, n in zip(order, os_, strict=True)]
    part = F.floor(F.col(order[0]) / span).alias("_part") if span else F.lit(0).cast("bigint").alias("_part")
    known = points.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, *order]]))
    left = probe.select(*places, part, F.lit(1).alias("_probe"), F.struct("*").alias("_row"))
    right = known.select(*places, part, F.lit(0).alias("_probe"), F.struct(*values).alias("_point"))
    both = left.unionByName(right, allowMissingColumns=True)
    if span:
        ends = right.groupBy(*ks, "_part").agg(F.max(F.struct(*os_, "_point")).alias("_end"))
        asked = left.select(*ks, "_part").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
        before = W.partitionBy(*ks).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.unionByName(asked).groupBy(*ks, "_part").agg(F.max("_end").alias("_end")).withColumn("_in", F.last("_end", ignorenulls=True).over(before)).where("_in is not null")
        both = both.unionByName(carried.select(*ks, "_part", F.lit(0).alias("_probe"), F.col("_in._point").alias("_point")), allowMissingColumns=True)  # no place: before all
    w = W.partitionBy(*ks, "_part").orderBy(*os_, "_probe").rowsBetween(W.unboundedPreceding, 0)
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*ks, *os_]])
    last = F.when(some, F.last("_point", ignorenulls=True).over(w)).alias("_last")
    return both.select("_probe", "_row", last).where("_probe = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``, by one aggregation and no sort; ties go to the largest row."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(*order, F.struct(*[c for c in rest if c not in order]).alias("_rest"))).alias("_top")
    out = df.groupBy(*keys).agg(top)
    return out.select(*[c if c in keys else F.col(f"_top.{c}" if c in order else f"_top._rest.{c}").alias(c) for c in df.columns])


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a row's values in ``order`` of (column, descending); nulls come last in either direction."""
    if after is not None:
        steps, equal = [], F.lit(True)
        for (c, desc), v in zip(order, after, strict=True):
            past = F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < F.lit(v) if desc else F.col(c) > F.lit(v))
            steps.append(equal & past)
            equal = equal & F.col(c).eqNullSafe(F.lit(v))
        df = df.where(reduce(lambda a, b: a | b, steps))
    return df.orderBy(*[F.desc_nulls_last(c) if desc else F.asc_nulls_last(c) for c, desc in order]).limit(limit)


def null_safe(a: DataFrame, b: DataFrame, equal: Sequence[tuple[str, str]], same: Sequence[tuple[str, str]]) -> Column:
    """A join condition: pairs in ``equal`` as usual, pairs in ``same`` with null equal to null."""
    parts = [a[x] == b[y] for x, y in equal] + [a[x].eqNullSafe(b[y]) for x, y in same]
    return reduce(lambda x, y: x & y, parts)


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value given; None filters nothing, a list is a set of values."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c) == v)
    return df


def reconciled(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Per key of a full outer join: missing_left, missing_right, mismatch or matched."""
    left = a.select(*keys, F.struct(*compare).alias("_a"))
    right = b.select(*keys, F.struct(*compare).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    state = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(F.col("_a").eqNullSafe(F.col("_b")), "matched").otherwise("mismatch")
    return both.select(*keys, state.alias("state"), "_a", "_b")


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


def date_spine(spark, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last``."""
    return spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as day")


#: Ranges of a group, whose hashes meet in one row; hex digits of a text key's hash that name its range.
GROUP, PREFIX = 1000, 4


def range_hashes(df: DataFrame, columns: Sequence[str], keys: Sequence[str], per: int | None) -> DataFrame:
    """(range, n_rows, hash): md5 of the md5 of each row, in the order of the keys; ``columns`` are SQL, and null is not the empty string.

    A range is ``per`` numbers of the first key, or those keys whose md5 begin alike. Only hashes are shuffled, and a range's meet in one row, so ``per`` bounds it.
    """
    row = F.md5(F.concat_ws("§", *[F.coalesce(F.concat(F.lit("="), F.expr(c).cast("string")), F.lit("null")) for c in columns]).cast("binary"))
    part = F.expr(f"cast({keys[0]} as bigint) div {per}") if per else F.conv(F.left(F.md5(F.col(keys[0]).cast("binary")), F.lit(PREFIX)), 16, 10).cast("bigint")
    lined = df.select(part.alias("range"), F.struct(*keys, row.alias("_hash")).alias("_row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda r: r["_hash"]), "")
    return lined.groupBy("range").agg(F.count("*").alias("n_rows"), F.md5(joined.cast("binary")).alias("hash"))


def whole_hash(ranges: DataFrame) -> DataFrame:
    """(n_rows, hash) of a table from its ranges, joined in order by groups."""
    of = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "hash"))), lambda r: r["hash"]), "").cast("binary")).alias("hash")
    grouped = ranges.groupBy(F.expr(f"range div {GROUP}").alias("g")).agg(F.sum("n_rows").alias("n_rows"), of("range"))
    return grouped.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), of("g"))
