"""Compare a query with its SQL in DuckDB, as bags of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'; set threads=4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    got = df.collect()
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(_plain(v) for v in row)) for row in ran.fetchall())
    assert sorted(repr(tuple(_plain(r[n]) for n in names)) for r in got) == want
