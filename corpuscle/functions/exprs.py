"""Column expressions that the operators share. All are built-in functions: they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by file extension (others are "unknown")
LANGUAGES = {
    "zig": "zig",
    "c": "c h",
    "python": "py",
    "cpp": "cpp hpp cc hh cxx hxx mm",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts tsx mts cts",
    "rust": "rs",
    "go": "go",
    "php": "php",
    "ruby": "rb rake",
    "hcl": "tf tfvars hcl",
    "r": "r R",
    "markdown": "md",
    "json": "json",
    "toml": "toml",
    "yaml": "yaml yml",
    "dart": "dart",
    "java": "java",
    "kotlin": "kt",
    "swift": "swift",
    "svelte": "svelte",
    "vue": "vue",
    "astro": "astro",
    "shell": "sh bash zsh",
    "css": "css",
    "scss": "scss",
    "sql": "sql",
    "protobuf": "proto",
    "fortran": "f90 f for",
    "llvm_ir": "ll",
    "mlir": "mlir",
    "tablegen": "td",
}
# fixed values: comment families
HASH_COMMENTS = ("python", "ruby", "r", "shell", "hcl", "yaml")
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "__specs__")
# fixed values: scores of a word's occurrence, by kind and by path rank
OCCURRENCE_SCORES = {"definition": 100, "export": 90, "import": 75, "call": 65, "reference": 50, "test": 30, "doc": 10}
RANK_SCORES = (20, 16, 14, 8, 0, -40, -30)
# fixed values: base scores of symbol kinds
KIND_SCORES = {
    70: ("function", "method"),
    55: ("struct", "class", "interface", "trait", "impl", "union", "type_alias"),
    40: ("enum", "module", "macro"),
    25: ("constant", "variable"),
    10: ("test",),
    -20: ("comment",),
    -100: ("import",),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def choose(*cases: tuple[Column, object], otherwise) -> Column:
    """The value of the first condition that holds."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, value in cases[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for e in exts.split() for x in (e, name)])
    return F.coalesce(F.try_element_at(table, F.substring_index(path, ".", -1)), F.lit("unknown"))


def lines(content: Column) -> Column:
    """Lines as an array: a carriage return before the newline goes, a last empty line is none."""
    parts = F.split(content, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(line: Column) -> Column:
    """Runs of letters, digits and underscores; only ASCII letters become lower case."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"([\p{IsAlphabetic}\p{N}_]+)"), F.lit(1)), ascii_lower)


def trigrams(content: Column) -> Column:
    """Distinct three-character windows of printable ASCII."""
    # a match of nothing at each place that looks ahead: one pass, whatever the length
    return F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit("(?=([ -~]{3}))"), F.lit(1)))


def under(path: Column, prefix: str) -> Column:
    p = prefix.strip("/")
    return (path == p) | path.startswith(p + "/") if p else F.lit(True)


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", ""))


def is_test_path(path: Column) -> Column:
    p = ascii_lower(path)
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, TEST_SEGMENTS))) | p.endswith("_test.rs") | p.contains(".test.") | p.contains(".spec.")


def is_doc_path(path: Column) -> Column:
    return path.startswith("docs/") | (F.lower(path) == "readme.md") | path.endswith(".md") | path.endswith(".mdx")


def is_source_path(path: Column) -> Column:
    return path.startswith("src/") | ((path.startswith("packages/") | path.startswith("apps/")) & path.contains("/src/"))


def is_example_path(path: Column) -> Column:
    return path.startswith("examples/") | path.contains("/examples/")


def is_comment_or_blank(line: Column, lang: Column) -> Column:
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    star = t.startswith("*") | t.endswith("*/") | t.startswith("/*")
    by_family = (
        F.when(lang.isin(*HASH_COMMENTS), t.startswith("#"))
        .when(lang == "sql", t.startswith("--"))
        .when(lang.isin("css", "scss"), star)
        .when(lang == "markdown", t.startswith("<!--"))
        .otherwise(t.startswith("//") | star)
    )
    return (t == "") | by_family


def is_import_line(line: Column) -> Column:
    t = F.ltrim(line)
    return any_of(*[t.startswith(x) for x in ("import ", "import type ", "use ", "from ")])


def is_export_line(line: Column) -> Column:
    return F.ltrim(line).startswith("export ")


def is_call_of(line: Column, word: str) -> Column:
    return any_of(*[line.contains(x) for x in (f"{word}(", f"new {word}(", f"{word}::", f".{word}(")])


def word_path_rank(path: Column) -> Column:
    src = path.contains("/src/")
    return choose(
        (is_test_path(path), 5),
        (path.startswith("packages/") & src, 0),
        (path.startswith("apps/") & src, 1),
        (path.startswith("src/"), 2),
        (path.startswith("packages/") | path.startswith("apps/"), 3),
        (is_example_path(path), 4),
        (is_doc_path(path), 6),
        otherwise=4,
    )


def kind_score(kind: Column) -> Column:
    return choose(*[(kind.isin(*names), s) for s, names in KIND_SCORES.items()], otherwise=0)


def fuzzy_score(pattern: str, text: Column) -> Column:
    """Greedy leftmost subsequence score; null if the pattern is no subsequence.

    A hit gives 1, a run of hits 2, 4, 6 ... more, a hit at the start or after ``/``, ``_`` or ``-`` gives 5 more.
    """
    if not pattern:
        return F.lit(0.0).cast("float")
    return fuzzy_score_of(F.array(*map(F.lit, pattern)), text)


def fuzzy_score_of(want: Column, text: Column) -> Column:
    """The same for a pattern given as an array of its characters, one at least."""
    chars, size = F.split(text, ""), F.size(want)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("score"), F.lit("/").alias("before"))

    def step(s, c):
        hit = F.coalesce((s["at"] < size) & (c == F.try_element_at(want, s["at"] + 1)), F.lit(False))
        run = F.when(hit, s["run"] + 2).otherwise(0)
        edge = (s["i"] == 0) | s["before"].isin("/", "_", "-")
        # the first hit of a run has no bonus yet: it accumulates from the second on
        gain = F.when(hit, 1 + F.when(s["run"] > 0, s["run"]).otherwise(0) + F.when(edge, 5).otherwise(0)).otherwise(0)
        return F.struct((s["at"] + hit.cast("int")).alias("at"), (s["i"] + 1).alias("i"), run.alias("run"), (s["score"] + gain).alias("score"), c.alias("before"))

    return F.aggregate(chars, start, step, lambda s: F.when(s["at"] == size, s["score"].cast("float")))


def time_text(ms: Column) -> Column:
    """Epoch milliseconds as text; 0 is unknown."""
    return F.when(ms == 0, "unknown").otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
