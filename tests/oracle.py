"""Compare a query with its SQL on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan") if math.isnan(value) else (2, repr(value + 0.0))
    if isinstance(value, int):
        return (2, repr(float(value)))
    return (3, str(value))


def _kind(type_name: str) -> str:
    name = type_name.lower()
    if "int" in name:
        return "int"
    if name in ("double", "float"):
        return "float"
    return {"varchar": "string"}.get(name, name)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Everything that differs: columns, kinds, row count, values."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: _kind(str(d[1])) for d in found.description}
    expected = found.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if _kind(kind) != kinds[name]:
            problems.append(f"{name}: {kind} != {kinds[name]}")
    order = sorted(names)
    ours = sorted(tuple(_plain(row[c]) for c in order) for row in df.collect())
    theirs = sorted(
        tuple(_plain(row[names.index(c)]) for c in order) for row in expected
    )
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    if not ours:
        problems.append("no rows")
    return problems
