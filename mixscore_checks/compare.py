"""Run registered queries in Spark and in DuckDB and compare the results.

``python -m mixscore_checks.compare <sf_dir> [query ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from mixscore_checks.oracle import ORACLE
from mixscore_checks.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(df, con, name: str) -> str | None:
    """None when the result holds the same rows as the query's SQL, else what differs."""
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLE[name])
    want_cols, want = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    differing = [(g, w) for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]
    if differing:
        return f"{len(differing)} of {len(got)} rows differ, first {differing[0]}"
    return None


def main(argv) -> int:
    from mixscore_checks.session import local_session

    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(QUERIES[name](spark, sf_dir), con, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - start:.2f}s)", flush=True)
    print(f"{len(names) - failed} of {len(names)} match")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
