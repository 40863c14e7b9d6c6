"""Compare Spark result column types with the DuckDB oracle's result types per query."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from docflow.plans.registry import load_all  # noqa: E402
from docflow.session import TABLES, build_session  # noqa: E402

MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
       "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("schema-check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, q in load_all().items():
        if q.sql is None:
            continue
        s = dict(q.build(spark, sf).dtypes)
        d = {c: str(t) for c, t in con.execute(f"DESCRIBE {q.sql}").fetchall() and
             [(r[0], r[1]) for r in con.execute(f"DESCRIBE {q.sql}").fetchall()]}
        bad = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if MAP.get(s.get(c), s.get(c)) != d.get(c)}
        print(f"{name:28s} {'ok' if not bad else bad}")


if __name__ == "__main__":
    main()
