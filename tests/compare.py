"""Runs a query and its SQL on the same tables and compares them without regard to order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = db.sql(sql)
    return list(out.columns), out.fetchall()


def same(df, sql: str, sf_dir: str) -> tuple[bool, str]:
    columns, rows = oracle_rows(sql, sf_dir)
    names = sorted(df.columns)
    if names != sorted(columns):
        return False, f"columns {names} and {sorted(columns)}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=key)
    want = sorted((tuple(_plain(r[columns.index(c)]) for c in names) for r in rows), key=key)
    if got == want:
        return True, f"{len(got)} rows"
    odd = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
    return False, f"{len(got)} and {len(want)} rows; first difference {str(odd)[:600]}"
