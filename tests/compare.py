"""Runs a query and its SQL twin over the same tables and tells how they differ."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int) and not isinstance(x, bool):
        return float(f"{x:.9g}") if abs(x) < 2**40 else x
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def differences(df, con, sql: str) -> list[str]:
    got_names = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != got_names:
        return [f"columns {got_names} and {sorted(names)}"]
    order = [names.index(n) for n in got_names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in got_names) for r in df.collect()), key=repr)
    out = [] if len(got) == len(want) else [f"{len(got)} and {len(want)} rows"]
    diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    return out + ([f"{len(diff)} rows differ, first {got_names}: {diff[0]}"] if diff else [])
