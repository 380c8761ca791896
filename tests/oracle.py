"""Compares queries with their SQL on DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes repeat_nodes fastq_reads read_paths thread_nodes kmer_index known_kmers mix_targets pack_limits".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        if os.path.isdir(p):
            p += "/*.parquet"
        con.execute(f"create view {t} as select * from '{p}'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[int, int, list, list]:
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows_of(names, cur.fetchall())
    return sum(got.values()), sum(want.values()), list((got - want).items())[:5], list((want - got).items())[:5]
