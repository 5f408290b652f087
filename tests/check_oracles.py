"""Run registered queries against their SQL: ``python tests/check_oracles.py SF_DIR [name…]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events"
    " documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in data),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """Difference between query and SQL as text, None if there is none."""
    df = queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    want_rel = con.sql(oracle_sql()[name])
    want = rows(want_rel.columns, want_rel.fetchall())
    if sorted(df.columns) != sorted(want_rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_rel.columns)}"
    if len(got) != len(want):
        only = sorted(set(map(str, got)) ^ set(map(str, want)))[:4]
        return f"{len(got)} rows != {len(want)}; {only}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{g} != {w}"
    return None


def main() -> None:
    from docstruct.plans.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    for name in sys.argv[2:] or queries():
        start = time.time()
        try:
            diff = compare(spark, con, sf_dir, name) if name in oracle_sql() else "no SQL"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:24s} {time.time() - start:6.1f}s {diff or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
