"""Compare every registered query with its SQL on one data folder.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value + 0.0:.9g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def compare(df, con, sql: str) -> str:
    """'' when both sides agree, else what differs first."""
    mine = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    other = [(n, k, kinds[n]) for n, k in df.dtypes if KINDS.get(k) != kinds[n]]
    if other:
        return f"types {other}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
            return f"row differs: {str(diff)[:600]} in {str(a)[:200]}"
    return ""


def main() -> int:
    from plaintide.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(build(spark, sf_dir), con, oracle[name])
                note = "ok" if not problem else "DIFFERS " + problem
            else:
                note = f"rows only: {build(spark, sf_dir).count()}"
                problem = ""
        except Exception as error:  # noqa: BLE001
            problem = note = f"FAILED {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{name:32s} {time.time() - start:6.1f}s {note}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
