"""Answers of the engine's tools as compact documents: each tool's columns in order, totals, and what to look at next."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit as audit_
from . import output

# fixed values: the columns of each tool's rows, as their names here and in the answer
COLUMNS: dict[str, dict[str, str]] = {
    "files": {"path": "path", "language": "lang", "line_count": "lines", "symbol_count": "symbols"},
    "list": {"name": "name", "is_dir": "kind"},
    "glob": {"path": "path"},
    "path_search": {"path": "path", "score": "score"},
    "outline": {"line_start": "line_start", "line_end": "line_end", "kind": "kind", "name": "name", "detail": "detail"},
    "recent": {"path": "path", "modified": "modified", "byte_size": "bytes"},
    "status": {"files": "files", "words": "words", "word_files": "word_files", "symbols": "symbols"},
    "read": {"path": "path", "hash": "hash", "unchanged": "unchanged", "text": "text"},
    "symbol_defs": {"path": "path", "line_start": "line_start", "line_end": "line_end", "kind": "kind", "name": "name", "detail": "detail"},
    "symbol_search": {"score": "score", "path": "path", "line_start": "line", "kind": "kind", "name": "name"},
    "word_refs": {"kind": "kind", "path": "path", "line_num": "line", "line_text": "text"},
    "text_search": {"path": "path", "line_num": "line", "scope": "scope", "line_text": "text"},
    "callers": {"path": "path", "line_num": "line", "line_text": "text"},
    "trace_deps": {"path": "path", "relation": "relation", "depth": "depth"},
    "changes": {"seq": "seq", "path": "path", "op": "op"},
    "audit": {"severity": "severity", "rule": "rule", "path": "path", "line": "line", "title": "title", "instances": "instances"},
    "brief": {"path": "path", "name": "name", "kind": "kind", "line_start": "line_start", "line_end": "line_end", "score": "score"},
    "pipeline": {"path": "path", "line_num": "line", "line_text": "text"},
    "edit": {"path": "path", "hash": "hash", "added": "added", "removed": "removed"},
}
TEXT_CELLS = ("line_text", "detail", "title")
MAX_STEPS, READ_LINES = 2, 200


def shown(tool: str, rows: DataFrame) -> DataFrame:
    """A tool's rows with the columns of its answer; cells of text are made compact."""
    names = COLUMNS[tool]
    have = [c for c in names if c in rows.columns]
    return rows.select(*[(output.compact(F.col(c)) if c in TEXT_CELLS else F.when(F.col(c), "dir").otherwise("file") if c == "is_dir" else F.col(c)).alias(names[c]) for c in have])


def answer(tool: str, rows: DataFrame, limit: int = output.MAX_ROWS, total: int | None = None, steps: list[tuple[str, dict]] = (), **head) -> str:
    """One JSON object: the tool, what the caller knows (``head``), columns and rows, the total, next steps."""
    body = json.loads(output.render(shown(tool, rows), limit))
    if total is not None:
        body["total"] = total
        if total > len(body["rows"]):
            body["truncated"] = True
    if steps:
        body["next_cols"] = ["tool", "args"]
        body["next"] = [[t, a] for t, a in dict.fromkeys((t, json.dumps(a, sort_keys=True)) for t, a in steps)]
        body["next"] = [[t, json.loads(a)] for t, a in body["next"]]
    return json.dumps({"tool": tool} | {k: v for k, v in head.items() if v not in (None, "", [])} | body, ensure_ascii=False)


def _step(tool: str, **args: Column | str) -> Column:
    pairs = [x for k, v in args.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))]
    return F.struct(F.lit(tool).alias("tool"), F.create_map(*pairs).alias("args"))


def finding_steps(findings: DataFrame) -> DataFrame:
    """Findings with ``next``: an array of (tool, args) that says what to look at."""
    path, line = F.col("path"), F.col("line_start")
    both = [_step("trace_deps", path=path, direction=d) for d in ("depends_on", "imported_by")]
    read = F.when(line.isNotNull(), _step("read", path=path, line_start=line, line_end=line + READ_LINES - 1)).otherwise(_step("read", path=path))
    steps = (
        F.when(F.col("rule") == "architecture.cycle", F.array(*both))
        .when(F.col("rule") == "dependency.hotspot", F.array(_step("outline", path=path), both[1], both[0]))
        .when(F.col("rule") == "file.large", F.array(_step("outline", path=path)))
        .when(F.col("rule") == "dead_code.candidate", F.array(_step("word_refs", word=F.coalesce("detail", F.lit(""))), read))
        .otherwise(F.array(read))
    )
    return findings.withColumn("next", steps)


def audit_steps(findings: DataFrame, limit: int = audit_.MAX_FINDINGS) -> DataFrame:
    """(tool, args) that a report proposes: the first step of the first finding of each rule and severity, ``MAX_STEPS`` in all.

    Severe groups come first, larger ones before smaller ones.
    """
    f = audit_.ordered(findings, limit)
    # rows of a report: at most ``limit`` of them
    groups = f.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*[F.col(c) for c in f.columns]), F.struct(*audit_._order(f))).alias("first"))
    firsts = finding_steps(groups.select("n", "first.*"))
    rank = F.when(F.col("severity") == "high", 0).otherwise(1)
    return firsts.orderBy(rank, F.desc("n"), "rule").limit(MAX_STEPS).select(F.element_at("next", 1)["tool"].alias("tool"), F.element_at("next", 1)["args"].alias("args"))


def brief_steps(task: str, confidence: str, symbols: int, snippets: int) -> list[tuple[str, dict]]:
    """Searches for the task's words where a bundle found nothing or little."""
    if confidence != "low" and (symbols or snippets):
        return []
    return [("symbol_search", {"query": task}), ("text_search", {"query": task}), ("brief", {"task": task})]


def audit_answer(findings: DataFrame, limit: int = audit_.MAX_FINDINGS) -> str:
    """A short audit report: verdict and totals, counts by rule, the first rows, next steps."""
    head = audit_.report(findings, limit).first().asDict()
    rules = audit_.rule_groups(audit_.ordered(findings, limit).drop("secondary")).orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), F.desc("n"), "rule").collect()
    steps = [(r.tool, dict(r.args)) for r in audit_steps(findings, limit).collect()]
    return answer("audit", audit_.report_rows(findings, limit), steps=steps, rules=[[r.rule, r.severity, r.n, r.top_path] for r in rules], **head)
