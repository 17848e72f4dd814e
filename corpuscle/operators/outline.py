"""Outlines: the symbols and imports of a file, by tolerant line scanners (no grammar library is needed).

``outline(language, content)`` is plain Python over one file; ``outlines`` runs it in Arrow batches. A scanner knows strings
and comments well enough to match braces; languages by indentation end a block at the next line that is not deeper. For the
line-based languages a block symbol ends before the next block symbol starts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import manifests

_N = r"([A-Za-z_$][\w$]*)"
_VIS = r"(?:pub(?:\([^)]*\))?\s+)?"

# (pattern of a trimmed line, kind); group 1 is the name. Brace languages.
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [
        (rf"{_VIS}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+{_N}", "function"),
        (rf"{_VIS}struct\s+{_N}", "struct"),
        (rf"{_VIS}union\s+{_N}", "union"),
        (rf"{_VIS}enum\s+{_N}", "enum"),
        (rf"{_VIS}(?:unsafe\s+)?trait\s+{_N}", "trait"),
        (rf"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{_N}", "impl"),
        (rf"{_VIS}type\s+{_N}", "type_alias"),
        (rf"macro_rules!\s*{_N}", "macro"),
        (rf"{_VIS}const\s+{_N}\s*:", "constant"),
        (rf"{_VIS}static\s+(?:mut\s+)?{_N}", "variable"),
        (rf"{_VIS}mod\s+{_N}", "module"),
    ],
    "typescript": [
        (rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s+{_N}", "function"),
        (rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+{_N}", "class"),
        (rf"(?:export\s+)?(?:declare\s+)?interface\s+{_N}", "interface"),
        (rf"(?:export\s+)?(?:declare\s+)?type\s+{_N}\s*(?:<[^=]*>)?\s*=", "type_alias"),
        (rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{_N}", "enum"),
        (rf"(?:export\s+)?(?:const|let|var)\s+{_N}[^=]*=\s*(?:async\s+)?(?:\([^)]*\)[^=]*=>|[\w$]+\s*=>|function\b)", "function"),
        (rf"(?:export\s+)?(?:const|let|var)\s+{_N}", "constant"),
    ],
    "go": [
        (rf"func\s+\([^)]*\)\s*{_N}", "method"),
        (rf"func\s+{_N}", "function"),
        (rf"type\s+{_N}\s+struct", "struct"),
        (rf"type\s+{_N}\s+interface", "interface"),
        (rf"type\s+{_N}", "type_alias"),
        (rf"var\s+{_N}", "variable"),
        (rf"const\s+{_N}", "constant"),
    ],
    "c": [
        (rf"#\s*define\s+{_N}", "macro"),
        (rf"(?:typedef\s+)?struct\s+{_N}\s*\{{", "struct"),
        (rf"(?:typedef\s+)?enum\s+{_N}\s*\{{", "enum"),
        (rf"(?:typedef\s+)?union\s+{_N}\s*\{{", "union"),
        (rf"typedef\s+.*?{_N}\s*;", "type_alias"),
        (rf"class\s+{_N}", "class"),
        (rf"namespace\s+{_N}", "module"),
        (rf"(?!return\b|else\b|if\b|for\b|while\b|switch\b)[\w:<>*&,\s~]+?[\s*&]{_N}\s*\([^;]*$", "function"),
    ],
    "java": [
        (rf"(?:[a-z]+\s+)*class\s+{_N}", "class"),
        (rf"(?:[a-z]+\s+)*interface\s+{_N}", "interface"),
        (rf"(?:[a-z]+\s+)*enum\s+{_N}", "enum"),
        (rf"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?!return\b|new\b|else\b|throw\b)[\w<>\[\], .]*?\b{_N}\s*\([^;]*\{{", "method"),
        (rf"(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], .]+\s+{_N}\s*[=;]", "variable"),
    ],
    "php": [
        (rf"(?:abstract\s+|final\s+)?class\s+{_N}", "class"),
        (rf"interface\s+{_N}", "interface"),
        (rf"trait\s+{_N}", "trait"),
        (rf"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*{_N}", "function"),
    ],
    "zig": [
        (rf"(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+{_N}", "function"),
        (rf"(?:pub\s+)?const\s+{_N}\s*=\s*(?:packed\s+|extern\s+)?struct", "struct"),
        (rf"(?:pub\s+)?const\s+{_N}\s*=\s*enum", "enum"),
        (rf"(?:pub\s+)?const\s+{_N}\s*=\s*(?:extern\s+)?union", "union"),
        (rf"(?:pub\s+)?const\s+{_N}\s*=\s*@import", "import"),
        (rf"(?:pub\s+)?const\s+{_N}", "constant"),
        (rf"(?:pub\s+)?var\s+{_N}", "variable"),
        (r"test\s+\"([^\"]*)\"", "test"),
    ],
}
RULES["javascript"] = RULES["typescript"]
RULES["cpp"] = RULES["c"]
# line-based languages: blocks reach to the next block
LINE_RULES: dict[str, list[tuple[str, str]]] = {
    "markdown": [(r"#{1,6}\s+(.+?)\s*#*$", "module")],
    "json": [(r"\"([^\"]+)\"\s*:", "constant")],
    "shell": [(rf"(?:function\s+)?{_N}\s*\(\)", "function"), (rf"function\s+{_N}", "function")],
    "css": [(r"@mixin\s+([\w-]+)", "function"), (r"((?:--|\$)[\w-]+)\s*:", "variable"), (r"([.#][\w-]+)", "class")],
    "sql": [(r"(?i:alter\s+(?:table|view)\s+(?:if\s+exists\s+)?)([\w.\"]+)", "struct"), (r"(?i:create\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?)([\w.\"]+)", "struct"), (r"(?i:create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+)([\w.]+)", "function")],
    "hcl": [(r"(?:resource|data)\s+\"[^\"]*\"\s+\"([^\"]*)\"", "struct"), (r"(?:variable|module|output|provider)\s+\"([^\"]*)\"", "variable")],
    "r": [(r"([\w.]+)\s*(?:<-|=)\s*function", "function"), (r"(?:library|require)\(([\w.]+)\)", "import")],
    "protobuf": [(rf"message\s+{_N}", "struct"), (rf"service\s+{_N}", "interface"), (rf"enum\s+{_N}", "enum"), (rf"rpc\s+{_N}", "method")],
    "fortran": [(r"(?i:module\s+)(\w+)", "module"), (r"(?i:(?:recursive\s+)?(?:subroutine|function)\s+)(\w+)", "function"), (r"(?i:type\s*(?:::)?\s+)(\w+)", "struct")],
    "kotlin": [(rf"(?:[a-z]+\s+)*class\s+{_N}", "class"), (rf"(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_N}", "function"), (rf"(?:[a-z]+\s+)*va[lr]\s+{_N}", "variable")],
    "swift": [(rf"(?:[a-z]+\s+)*class\s+{_N}", "class"), (rf"(?:[a-z]+\s+)*struct\s+{_N}", "struct"), (rf"(?:[a-z]+\s+)*enum\s+{_N}", "enum"), (rf"(?:[a-z]+\s+)*func\s+{_N}", "function"), (rf"(?:[a-z]+\s+)*(?:let|var)\s+{_N}", "variable")],
    "dart": [(rf"(?:abstract\s+)?class\s+{_N}", "class"), (rf"enum\s+{_N}", "enum"), (rf"(?:[\w<>?]+\s+){_N}\s*\([^;]*\{{", "function")],
    "llvm_ir": [(r"define\s+.*?@([\w.]+)", "function"), (r"declare\s+.*?@([\w.]+)", "function"), (r"@([\w.]+)\s*=", "variable")],
    "mlir": [(r"(?:func\.)?func\s+(?:private\s+)?@(\w+)", "function"), (r"module\s+@(\w+)", "module")],
    "tablegen": [(r"(?:multi)?class\s+(\w+)", "class"), (r"def\s+(\w+)", "constant"), (r"let\s+(\w+)", "variable")],
}
LINE_RULES["scss"] = LINE_RULES["css"]
for _web in ("svelte", "vue", "astro"):
    LINE_RULES[_web] = [(rf"export\s+let\s+{_N}", "variable"), *RULES["typescript"], (r"([.#][A-Za-z_][\w-]*)[^{]*\{", "class")]
BLOCKS = {"function", "method", "class", "struct", "interface", "enum", "module", "impl", "trait", "union"}
IMPORTS = {
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;?",
    "typescript": r"(?:import\b|export\b.*\bfrom\b).*?[\"']([^\"']+)[\"']",
    "python": r"(?:from\s+\S+\s+import\s+.+|import\s+.+)",
    "go": r"import\s+.*",
    "c": r"#\s*include\s+[<\"]([^>\"]+)[>\"]",
    "java": r"import\s+(?:static\s+)?([\w.*]+);",
    "php": r"use\s+([\w\\]+)",
    "ruby": r"require(?:_relative)?\s*\(?\s*(\"[^\"]*\"|'[^']*')",
    "dart": r"import\s+['\"]([^'\"]+)['\"]",
    "kotlin": r"import\s+([\w.*]+)",
    "swift": r"import\s+(\w+)",
    "css": r"@(?:import|use)\s+[\"']([^\"']+)[\"']",
    "shell": r"(?:source|\.)\s+(\S+)",
}
for _same, _as in (("javascript", "typescript"), ("svelte", "typescript"), ("vue", "typescript"), ("astro", "typescript"), ("cpp", "c"), ("scss", "css")):
    IMPORTS[_same] = IMPORTS[_as]


def split_lines(content: str) -> list[str]:
    parts = content.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") and i < len(parts) - 1 else p for i, p in enumerate(parts)]


_NOISE = re.compile(r"//.*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|`(?:\\.|[^`\\])*`")


def _bare(lines: list[str]) -> list[str]:
    """Lines without strings and comments, for matching braces."""
    out, inside = [], False
    for line in lines:
        if inside:
            end = line.find("*/")
            if end < 0:
                out.append("")
                continue
            line, inside = line[end + 2 :], False
        line = _NOISE.sub("", line)
        start = line.find("/*")
        if start >= 0:
            line, inside = line[:start], True
        out.append(line)
    return out


def _parameters(line: str) -> str | None:
    a = line.find("(")
    b = line.rfind(")")
    return line[a : b + 1] if 0 <= a < b else None


def _braces(language: str, lines: list[str]) -> list[tuple]:
    rules = [(re.compile(p), k) for p, k in RULES[language]]
    bare, out, open_, depth = _bare(lines), [], [], 0
    containers = {"impl", "class", "interface", "trait"}
    for i, raw in enumerate(lines):
        text = bare[i].strip()
        held = [o for o in open_ if o[1] == depth - 1]
        inside_class = bool(held and out[held[-1][0]][1] in containers)
        if text and (depth == 0 or inside_class):
            trimmed = raw.strip()
            for pattern, kind in rules:
                m = pattern.match(trimmed)
                if m:
                    if kind == "function" and inside_class:
                        kind = "method"
                    if inside_class and kind == "constant" and language in ("typescript", "javascript"):
                        break
                    out.append([m[1], kind, i + 1, i + 1, _parameters(trimmed) if kind in ("function", "method") else None])
                    if "{" in text or (not text.endswith(";") and any("{" in x for x in bare[i + 1 : i + 3])):
                        open_.append((len(out) - 1, depth))
                    break
            else:
                if inside_class and language in ("typescript", "javascript"):
                    m = re.match(r"(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*([A-Za-z_$#][\w$]*)\s*\([^;]*\{", trimmed)
                    if m and m[1] not in ("if", "for", "while", "switch", "catch"):
                        out.append([m[1], "method", i + 1, i + 1, _parameters(trimmed)])
                        open_.append((len(out) - 1, depth))
        depth += text.count("{") - text.count("}")
        depth = max(depth, 0)
        for s, d in open_:
            if depth <= d and ("}" in text or "{" in text):
                out[s][3] = i + 1
        open_ = [o for o in open_ if not (depth <= o[1] and ("}" in text or "{" in text))]
    for s, _ in open_:
        out[s][3] = len(lines)
    return [tuple(o) for o in out]


def _python(lines: list[str]) -> list[tuple]:
    out, open_ = [], []
    last = 0
    for i, raw in enumerate(lines):
        text = raw.strip()
        if not text or text.startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip())
        while open_ and indent <= open_[-1][1]:
            out[open_.pop()[0]][3] = last
        last = i + 1
        inside = out[open_[-1][0]][1] if open_ else None
        m = re.match(r"(?:async\s+)?def\s+(\w+)", text)
        if m and inside not in ("function", "method"):
            out.append([m[1], "method" if inside == "class" else "function", i + 1, i + 1, _parameters(text)])
            open_.append((len(out) - 1, indent))
        elif (m := re.match(r"class\s+(\w+)", text)) and inside not in ("function", "method"):
            out.append([m[1], "class", i + 1, i + 1, None])
            open_.append((len(out) - 1, indent))
        elif not open_ and (m := re.match(r"([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)", text)):
            out.append([m[1], "constant", i + 1, i + 1, None])
    for s, _ in open_:
        out[s][3] = last
    return [tuple(o) for o in out]


def _ruby(lines: list[str]) -> list[tuple]:
    out, open_ = [], []
    for i, raw in enumerate(lines):
        text = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        if text == "end" and open_ and open_[-1][1] == indent:
            out[open_.pop()[0]][3] = i + 1
            continue
        inside = out[open_[-1][0]][1] if open_ else None
        for p, kind in ((r"class\s+([A-Z]\w*)", "class"), (r"module\s+([A-Z]\w*)", "module"), (r"def\s+(?:self\.)?([\w?!=]+)", "method")):
            m = re.match(p, text)
            if m and inside not in ("method", "module"):
                out.append([m[1], kind, i + 1, i + 1, _parameters(text) if kind == "method" else None])
                open_.append((len(out) - 1, indent))
                break
    return [tuple(o) for o in out]


def _by_lines(language: str, lines: list[str]) -> list[tuple]:
    rules = [(re.compile(p), k) for p, k in LINE_RULES[language]]
    out = []
    for i, raw in enumerate(lines):
        text = raw.strip()
        for pattern, kind in rules:
            m = pattern.match(text)
            if m:
                detail = f"h{len(text) - len(text.lstrip('#'))}" if language == "markdown" else None
                out.append([m[1].strip('"'), kind, i + 1, i + 1, detail])
                break
    blocks = [s for s in out if s[1] in BLOCKS]
    for s, following in zip(blocks, [*blocks[1:], None]):
        s[3] = max(s[2], following[2] - 1 if following else len(lines))
    return [tuple(s) for s in out]


def _ranged(symbols: list[tuple], n: int) -> list[tuple]:
    """(name, kind, line, detail) with last lines: a block reaches to the next block, others are one line."""
    blocks = [k for k, s in enumerate(symbols) if s[1] in BLOCKS]
    last = {k: max(symbols[k][2], symbols[f][2] - 1 if f is not None else n) for k, f in zip(blocks, [*blocks[1:], None])}
    return [(name, kind, line, last.get(k, line), detail) for k, (name, kind, line, detail) in enumerate(symbols)]


def _go_imports(lines: list[str]) -> list[tuple[str, int, int]]:
    """(text, first line, last line): a block is one import, with all its lines."""
    out, start = [], None
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if start is not None:
            if line.startswith(")"):
                out.append(("\n".join(x.rstrip() for x in lines[start - 1 : i]).strip(), start, i))
                start = None
        elif re.match(r"import\s*\(", line):
            if ")" in line:
                out.append((line, i, i))
            else:
                start = i
        elif re.match(r"import\s+\S", line):
            out.append((line, i, i))
    return out


def outline(language: str, content: str, path: str = "") -> tuple[list[tuple], list[str]]:
    """Symbols (name, kind, first line, last line, detail) in order, and the imports' texts."""
    lines = split_lines(content)
    if manifest := manifests.scanner(language, path):
        return _ranged(list(manifest(lines)), len(lines)), []
    if language == "go":
        found = _go_imports(lines)
        symbols = [*_braces(language, lines), *((text, "import", a, b, None) for text, a, b in found)]
        return sorted(symbols, key=lambda s: s[2]), [text for text, *_ in found]
    if language in RULES:
        symbols = _braces(language, lines)
    elif language == "python":
        symbols = _python(lines)
    elif language == "ruby":
        symbols = _ruby(lines)
    elif language in LINE_RULES:
        symbols = _by_lines(language, lines)
    else:
        return [], []
    imports = []
    pattern = IMPORTS.get(language)
    if pattern:
        p = re.compile(pattern)
        for i, raw in enumerate(lines):
            m = p.match(raw.strip())
            if m:
                text = m[1] if p.groups else m[0]
                imports.append(text)
                if language != "ruby":
                    symbols.append((text, "import", i + 1, i + 1, None))
    symbols.sort(key=lambda s: s[2])
    return symbols, imports


_OUT = "path string, symbols array<struct<ord:int,name:string,kind:string,line_start:int,line_end:int,detail:string>>, imports array<struct<ord:int,import_text:string,line:int>>"
_SYMBOLS = pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("detail", pa.string())]))
_IMPORTS = pa.list_(pa.struct([("ord", pa.int32()), ("import_text", pa.string()), ("line", pa.int32())]))


def _outlines(it):
    for b in it:
        symbols, imports = [], []
        for path, lang, content in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content"))):
            s, i = outline(lang, content or "", path)
            at = {}
            for name, kind, first, *_ in s:
                if kind == "import":
                    at.setdefault(name, first)
            symbols.append([dict(zip(("ord", "name", "kind", "line_start", "line_end", "detail"), (k, *x))) for k, x in enumerate(s)])
            imports.append([{"ord": k, "import_text": x, "line": at.get(x)} for k, x in enumerate(i)])
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(symbols, _SYMBOLS), pa.array(imports, _IMPORTS)], names=["path", "symbols", "imports"])


def outlines(files: DataFrame) -> DataFrame:
    return files.select("path", X.language(F.col("path")).alias("language"), "content").mapInArrow(_outlines, _OUT)


def symbols(files: DataFrame) -> DataFrame:
    return outlines(files).select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def symbols_naming(files: DataFrame, name: str) -> DataFrame:
    """Symbols of the files whose text has a name: the filter runs in the scan, before any file is outlined."""
    return symbols(files.where(F.lower("content").contains(name.lower())))


def imports(files: DataFrame) -> DataFrame:
    return outlines(files).select("path", F.explode("imports").alias("i")).select("path", "i.*")


def definitions(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of a name; those of one file and kind all show the first one's lines."""
    s = symbols.where(F.col("name") == name)
    first = s.groupBy("path", "kind").agg(F.min_by(F.struct("line_start", "line_end", "detail"), "ord").alias("s"), F.count(F.lit(1)).alias("copies"))
    return first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("path", F.lit(name).alias("name"), "kind", "s.line_start", "s.line_end", "s.detail")


def symbol_search(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols by kind, closeness of name and path; the score is relative to the best."""
    q = "".join(c for c in query if c.isalnum()).lower()
    s = symbols.where("kind <> 'import'")
    if not q:
        return s.select("path", "name", "kind", "line_start", F.lit(0).alias("raw_score"), F.lit(0.0).alias("score")).limit(0)
    n = X.normalised(F.col("name"))
    close = F.when(n == q, 1000).when(n.contains(q), 700).when((F.octet_length(n) >= 4) & F.lit(q).contains(n), 320).when(n.rlike(".*".join(map(re.escape, q))), 220)
    raw = X.kind_score(F.col("kind")) + close + F.when(X.normalised(F.col("path")).contains(q), 80).otherwise(0) - F.when(X.is_test_path(F.col("path")), 60).otherwise(0)
    scored = s.withColumn("raw_score", raw).where("raw_score is not null")
    order = (F.desc("raw_score"), F.col("path"), F.col("line_start"), F.col("name"))
    top = scored.select("path", "name", "kind", "line_start", "raw_score").orderBy(*order).limit(limit)
    best = top.agg(F.greatest(F.max("raw_score"), F.lit(1)).alias("best"))
    return top.crossJoin(F.broadcast(best)).select("path", "name", "kind", "line_start", "raw_score", (F.col("raw_score") / F.col("best")).alias("score")).orderBy(*order)
