from pyspark.sql import functions as F
from tidemark.operators.core import whole_hash
from tidemark.plans import hashes


def test_one_changed_flag_changes_its_range_and_no_other(spark, small):
    changes = {"ev": ("is_canonical", "not is_canonical", "id = 777"), "val": ("status", "'other'", "event_id = 5 and valuation_version = 'v1'"), "bal": ("reserve", "reserve + 1", "block_number = 99"), "nam": ("override_name", "coalesce(override_name, '')", "address = 'o1'"), "gate": ("kind", "'x'", "gateway = 'g7'")}
    for name, (column, new, where) in changes.items():
        t = hashes.TABLES[name]
        df = t.make(spark, small)
        other = df.withColumn(column, F.expr(f"if({where}, {new}, {column})"))
        a, b = ({r.range: tuple(r) for r in hashes.ranges(x, t).collect()} for x in (df.repartition(5), other))
        assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) == 1, name
        assert whole_hash(hashes.ranges(df, t)).first() != whole_hash(hashes.ranges(other, t)).first()


def test_hashes_name_all_columns(spark, small):
    for name, t in hashes.TABLES.items():
        df, told = t.make(spark, small), {c.rstrip("~#") for c in t.columns.split()}
        left = set(df.columns) - told
        # differences of others, or told already
        assert left <= {"fail": {"first_address", "amount", "n"}, "pay": {"delegators"}, "rew": {"delegators"}}.get(name, set()), (name, left)
        keys = [c.rstrip("~#") for c in t.columns.split()[: t.keys]]
        assert name == "vote" or df.count() == df.select(*keys).distinct().count(), name


def test_an_empty_table_has_a_hash(spark, small):
    t = hashes.TABLES["ev"]
    assert tuple(whole_hash(hashes.ranges(t.make(spark, small).limit(0), t)).first()) == (0, "d41d8cd98f00b204e9800998ecf8427e")
