"""Bounded results as compact text: columns once, a shared root of the paths once, long cells cut."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL, MAX_ROWS = 120, 1000


def compact(text: Column, most: int = CELL) -> Column:
    """White space as single blanks, cut with three dots."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def shared_root(paths: list[str]) -> str:
    """The common folder of some paths, if writing it once saves characters."""
    if len(paths) < 2:
        return ""
    common = os.path.commonprefix(paths)
    root = common[: common.rfind("/") + 1]
    return root if len(root) * len(paths) > len(root) + 6 else ""


def render(df: DataFrame, limit: int = MAX_ROWS) -> str:
    """One JSON object: columns and rows; columns without a value are left out."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    cut, rows = len(rows) > limit, rows[:limit]
    columns = [c for c in df.columns if any(r[c] not in (None, "", []) for r in rows)]
    out: dict = {"columns": columns}
    if "path" in columns and (root := shared_root([r["path"] for r in rows if r["path"]])):
        out["root"] = root
        for r in rows:
            r["path"] = r["path"].removeprefix(root)
    out["rows"] = [[r[c] for c in columns] for r in rows]
    if cut:
        out["truncated"] = True
    return json.dumps(out, ensure_ascii=False, default=str)
