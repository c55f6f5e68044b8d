"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    rows = [tuple(_cell(row[c]) for c in names) for row in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(_cell(row[i]) for i in order) for row in cursor.fetchall()]
    return [columns[i] for i in order], sorted(rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None for equal results, else what differs."""
    names, ours = spark_rows(query(spark, sf_dir))
    other_names, theirs = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} / {other_names}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for mine, other in zip(ours, theirs, strict=True):
        if mine != other:
            return f"{names}\n  spark {str(mine)[:600]}\n  sql   {str(other)[:600]}"
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from padron import build_session

    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, query, sqls[name], sf_dir)
                note = "equal"
            else:
                problem, note = None, f"no sql, {len(query(spark, sf_dir).collect())} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {problem or note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
