"""Compares a registered query with its SQL: names, types, and rows in any order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(query, spark, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    return names, sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(map(repr, (tuple(r[i] for i in order) for r in got.fetchall())))
