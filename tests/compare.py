"""Holds a query against its SQL in DuckDB on the same tables."""

from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(canonical, v))
    return v


def same(spark, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = Counter(repr(tuple(canonical(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(repr(tuple(canonical(r[i]) for i in at)) for r in cur.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
