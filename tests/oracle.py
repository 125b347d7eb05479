"""Compares a registered query with its SQL twin in DuckDB, types and values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pyarrow as pa

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names], strict=True)
    return sorted((tuple(_value(v) for v in row) for row in rows), key=repr)


def _value(v):
    if isinstance(v, list):
        return tuple(_value(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def _kinds(table: pa.Table) -> dict[str, str]:
    return {n: str(table.schema.field(n).type).replace("large_", "").split("[")[0] for n in sorted(table.column_names)}


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    found = []
    if _kinds(spark_table) != _kinds(sql_table):
        found.append(f"types {_kinds(spark_table)} != {_kinds(sql_table)}")
    a, b = _plain(spark_table), _plain(sql_table)
    if len(a) != len(b):
        found.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        found.append(f"{len(bad)} rows differ, first {str(bad[0])[:900] if bad else (a or b)[-1]}")
    return found


def main(names: list[str], sf_dir: str) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from corpuscle.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            mine = queries[name](spark, sf_dir).toArrow()
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS {name} {mine.num_rows} {took:.1f}s", flush=True)
                continue
            start = time.time()
            found = differences(mine, con.execute(oracles[name]).to_arrow_table())
            print("DIFF" if found else "ok  ", name, mine.num_rows, f"{took:.1f}s sql {time.time()-start:.1f}s", *found, flush=True)
            bad += bool(found)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print("FAIL", name, str(error)[:1500], flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(args, sf) else 0)
