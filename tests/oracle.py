"""Runs a check query and its SQL twin on the same tables and compares all values."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    keys = df.map(lambda v: "" if v is None else f"{v!r}")
    order = keys.sort_values(list(df.columns)).index if len(df.columns) else df.index
    return df.loc[order].reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    bad = {c: k for c, k in kinds.items() if k[0] != k[1] and got[c].notna().all() and want[c].notna().all()}
    if bad:
        return f"types {bad}"
    a, b = normal(got), normal(want)
    out = []
    for c in a.columns:
        wrong = [(i, x, y) for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y and not (x is None and y is None)]
        if wrong:
            out.append(f"{c}: {len(wrong)} differ, first {wrong[0]}")
    return "; ".join(out)
