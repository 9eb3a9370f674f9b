"""Runs a query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_key(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


def duck(sf_dir, sql):
    from pathlib import Path

    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf_dir, f"{t}.parquet")).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f'{p}/*.parquet' if p.is_dir() else p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())


def agree(spark, sf_dir, query, sql):
    df = query(spark, str(sf_dir))
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    names, theirs = duck(sf_dir, sql)
    assert sorted(df.columns) == names
    assert len(ours) == len(theirs)
    assert ours == theirs
