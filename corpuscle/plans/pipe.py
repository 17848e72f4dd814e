"""The pipe language: ``glob src/*.rs | search term | limit 5`` folded into one DataFrame.

A state is files (path) or results (path, line_num, line_text); its column ``pos`` carries the current order, so ``limit`` takes
the first rows of that order: paths, best scores first for ``fuzzy``, best tiers first for ``search``. ``filter`` keeps it and
``sort`` makes it path and line. A ``|`` cannot be escaped.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..operators import files as files_
from ..operators import search as search_
from ..sources.adapters import line_table

FUZZY_LIMIT, SEARCH_LIMIT, DEFAULT_LIMIT = 100, 100, 10
TERMINAL = {"outline": "outlines", "deps": "deps", "read": "reads", "count": "count"}


class PipeError(ValueError):
    pass


@dataclass
class State:
    kind: str  # files, results; outlines, deps, reads, count when ended
    rows: DataFrame | None


def parse(text: str) -> list[tuple[str, str]]:
    steps = [s.strip() for s in text.split("|")]
    return [(s.split(None, 1)[0].lower(), s.split(None, 1)[1].strip() if len(s.split(None, 1)) > 1 else "") for s in steps if s]


def evaluate(files: DataFrame, text: str, edges: DataFrame | None = None, symbols: DataFrame | None = None) -> State:
    """The state after all steps, rows in order; an ended state takes no more steps."""
    steps = parse(text)
    if not steps:
        raise PipeError("usage: stage | stage ...")
    state = State("files", None)
    for command, arg in steps:
        state = _step(state, command, arg, files, edges, symbols)
        if state.kind in TERMINAL.values():
            break
    rows = state.rows if state.rows is not None else _nothing(files)
    return State(state.kind, rows.orderBy("pos").drop("pos") if "pos" in rows.columns else rows)


def run(files: DataFrame, text: str, edges: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    return evaluate(files, text, edges, symbols).rows


def run_or_error(spark: SparkSession, files: DataFrame, text: str, edges: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Like ``run``, but a step that cannot be taken gives one row with the message."""
    try:
        return run(files, text, edges, symbols)
    except PipeError as e:
        return spark.createDataFrame([(str(e),)], "error string")


def _nothing(files: DataFrame) -> DataFrame:
    return files.select("path", F.struct("path").alias("pos")).limit(0)


def _need(command: str, arg: str) -> str:
    if not arg:
        raise PipeError(f"{command} needs an argument")
    return arg


def _step(state: State, command: str, arg: str, files: DataFrame, edges, symbols) -> State:
    if command in ("find", "glob"):
        return State("files", files.where(globs.matches(F.col("path"), _need(command, arg))).select("path", F.struct("path").alias("pos")))
    if command in ("fuzzy", "find_path", "path_search"):
        best = files_.fuzzy_paths(files, _need(command, arg), FUZZY_LIMIT)
        return State("files", best.select("path", F.struct((-F.col("score")).alias("score"), "path").alias("pos")))
    if command in ("search", "text_search"):
        q = _need(command, arg)
        if state.kind == "files" and state.rows is not None and state.rows.limit(1).count():
            # within files: the phrase as a whole, all lines, file after file
            inside = files.where(F.lower("content").contains(q.lower()))
            lines = line_table(inside).where(F.lower("line_text").contains(q.lower())).select("path", "line_num", "line_text")
            found = lines.join(state.rows.select("path", F.col("pos").alias("file")), "path")
            return State("results", found.select("path", "line_num", "line_text", F.struct("file", "line_num").alias("pos")))
        found = search_.search(files, q, SEARCH_LIMIT)
        tier = F.col("tier") if "tier" in found.columns else F.lit(0)
        return State("results", found.select("path", "line_num", "line_text", F.struct(tier.alias("tier"), "path", "line_num").alias("pos")))
    rows = state.rows if state.rows is not None else _nothing(files)
    if command == "filter":
        q = _need(command, arg).lower()
        cond = F.lower("path").contains(q)
        if state.kind == "results":
            cond |= F.lower("line_text").contains(q)
        return State(state.kind, rows.where(cond))
    if command == "sort":
        return State(state.kind, rows.withColumn("pos", F.struct("path", "line_num") if state.kind == "results" else F.struct("path")))
    if command == "limit":
        return State(state.kind, rows.orderBy("pos").limit(int(arg) if arg.isdigit() else DEFAULT_LIMIT))
    if command == "count":
        return State("count", rows.agg(F.lit(state.kind).alias("kind"), F.count(F.lit(1)).alias("n")))
    # a row of the state is an item: results keep paths that repeat
    if command == "deps" and edges is not None:
        return State("deps", rows.select("path", "pos").join(edges.select(F.col("src").alias("path"), "dst"), "path", "left"))
    if command == "outline" and symbols is not None:
        return State("outlines", rows.select("path", "pos").join(symbols, "path"))
    if command == "read":
        return State("reads", rows.select("path", "pos").join(files.select("path", "content"), "path"))
    raise PipeError(f"unknown command: {command}")


def _items(state: State, limit: int) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in state.rows.limit(limit).collect()]
    if state.kind not in ("outlines", "deps"):
        return rows
    grouped: dict[str, dict] = {}
    for r in rows:
        item = grouped.setdefault(r["path"], {"path": r["path"], "symbols": []} if state.kind == "outlines" else {"path": r["path"], "depends_on": []})
        if state.kind == "outlines":
            item["symbols"].append({k: r[k] for k in ("name", "kind", "line_start", "line_end") if k in r})
        elif r["dst"] is not None:
            item["depends_on"].append(r["dst"])
    return list(grouped.values())


def render(state: State, limit: int = 1000) -> str:
    """The text form of a state's first rows."""
    items = _items(state, limit)
    if state.kind == "files":
        return "\n".join(x["path"] for x in items)
    if state.kind == "results":
        return "\n".join("{path}:{line_num}: {line_text}".format(**x) for x in items)
    if state.kind == "count":
        return "{n} {kind}".format(**items[0])
    out = []
    for x in items:
        if state.kind == "outlines":
            out.append(f"{x['path']} ({len(x['symbols'])} symbols):")
            out += [f"  L{s['line_start']:<5} {s['kind']:<12} {s['name']}" for s in x["symbols"]]
        elif state.kind == "deps":
            out.append(f"{x['path']}:")
            if x["depends_on"]:
                out.append("  depends on: " + ", ".join(sorted(x["depends_on"])))
        else:
            out.append(f"=== {x['path']} ===\n{x['content']}")
    return "".join(f"{line}\n" for line in out)


def to_json(files: DataFrame, text: str, edges: DataFrame | None = None, symbols: DataFrame | None = None, limit: int = 1000) -> str:
    """A run as one JSON object: pipeline, result_type, count, items, text; of an error its message."""
    try:
        state = evaluate(files, text, edges, symbols)
    except PipeError as e:
        return json.dumps({"pipeline": text, "result_type": "error", "count": 0, "items": [], "message": str(e), "text": str(e)})
    said = render(state, limit)
    items = _items(state, limit)
    if state.kind == "count":
        return json.dumps({"pipeline": text, "result_type": "count", "kind": items[0]["kind"], "count": items[0]["n"], "items": [], "text": said})
    plain = [x["path"] for x in items] if state.kind == "files" else items
    return json.dumps({"pipeline": text, "result_type": state.kind, "count": len(items), "items": plain, "text": said}, ensure_ascii=False)
