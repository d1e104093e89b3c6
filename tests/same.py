"""Do a Spark and a DuckDB result hold the same rows?"""

from __future__ import annotations

import math


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def same(ours, theirs) -> str:
    """"" or what differs. Columns go by name, rows in any order."""
    names = sorted(ours.columns)
    if names != sorted(theirs.columns):
        return f"columns {names} {sorted(theirs.columns)}"
    a = sorted(tuple(cell(r[c]) for c in names) for r in ours.collect())
    at = {c: i for i, c in enumerate(theirs.columns)}
    b = sorted(tuple(cell(r[at[c]]) for c in names) for r in theirs.fetchall())
    if a == b:
        return ""
    x, y = sorted(set(a) - set(b))[:1], sorted(set(b) - set(a))[:1]
    return f"{len(a)} and {len(b)} rows; {str(x)[:300]} {str(y)[:300]}"
