"""The engine's operators on small projects, and every query against its SQL."""

import math

import pytest
from pyspark.sql import functions as F

from corpuscle import queries as Q
from corpuscle.functions import exprs as X
from corpuscle.functions import globs
from corpuscle.operators import audit, changes, deps, files, metrics, outline, search
from corpuscle.plans import pipe
from corpuscle.sources import adapters as A
from corpuscle.streaming import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PROJECT = {
    "src/agent.rs": "use crate::engine::Engine;\n\npub struct Agent {\n    engine: Engine,\n}\n\nimpl Agent {\n    pub fn new(engine: Engine) -> Self {\n        Agent { engine }\n    }\n}\n\npub fn build_agent() -> Agent {\n    Agent::new(Engine {})\n}\n",
    "src/engine.rs": "// the engine\npub struct Engine {\n}\n",
    "src/app.ts": 'import { boot } from "./boot";\nimport "./style.js";\nimport React from "react";\n\nexport function start() {\n  boot();\n}\n',
    "src/boot.ts": 'import { start } from "./app";\nexport class Boot {\n  run(x) {\n    return x;\n  }\n}\nexport const boot = () => new Boot();\n',
    "src/style.ts": "export const color = 1;\n",
    "src/broken.ts": 'import "./missing";\n',
    "src/tool.py": "import os\nLIMIT = 3\n\nclass Tool:\n    def run(self, a):\n        def inner():\n            pass\n        return a\n\ndef build_agent():\n    return Tool()\n",
    "docs/readme.md": "# Title\nbuild_agent is called\n## Part\n",
    "tests/agent_test.rs": "fn check() { build_agent(); }\n",
}


@pytest.fixture(scope="module")
def project(spark):
    return spark.createDataFrame([(p, c, 1000 * i) for i, (p, c) in enumerate(PROJECT.items())], "path string, content string, modified_ms long")


@pytest.fixture(scope="module")
def symbols(project):
    return outline.symbols(project).cache()


@pytest.mark.parametrize(
    "pattern,path,want",
    [
        ("*.rs", "src/a.rs", True),
        ("src/*.rs", "src/a/b.rs", True),
        ("src/**/*.rs", "src/a.rs", True),
        ("src/**/*.rs", "lib/a.rs", False),
        ("*.{ts,tsx}", "a.ts", True),
        ("*.{ts,tsx}", "a.test.ts", False),
        ("a{,b}", "a", False),
        ("?.rs", "a.rs", True),
        ("?.rs", "ab.rs", False),
        ("a[b].rs", "a[b].rs", True),
    ],
)
def test_globs(spark, pattern, path, want):
    assert spark.range(1).select(globs.matches(F.lit(path), pattern)).first()[0] is want


def test_lines_and_tokens(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("x\ry",), ("a\n\n",), ("last\r",)], "c string")
    assert [r[0] for r in df.select(X.lines(F.col("c"))).collect()] == [["a", "b"], [], ["x\ry"], ["a", ""], ["last\r"]]
    assert spark.range(1).select(X.tokens(F.lit("Foo_1 Über-bar!"))).first()[0] == ["foo_1", "Über", "bar"]
    assert sorted(spark.range(1).select(X.trigrams(F.lit("aBcé\nab"))).first()[0]) == ["abc"]


def brute_fuzzy(pattern, text):
    at = run = score = 0
    before = "/"
    for i, c in enumerate(text):
        if at < len(pattern) and c == pattern[at]:
            score += 1 + run + (5 if i == 0 or before in "/_-" else 0)
            run, at = run + 2, at + 1
        else:
            run = 0
        before = c
    return float(score) if at == len(pattern) else None


def test_fuzzy_score(spark):
    for text in ("src/web_agent.ts", "web", "awgbent", "w-e-b", ""):
        got = spark.range(1).select(X.fuzzy_score("web", F.lit(text))).first()[0]
        assert got == brute_fuzzy("web", text)


def test_time_text(spark):
    rows = spark.createDataFrame([(0,), (1709164800001,)], "ms long").select(X.time_text(F.col("ms"))).collect()
    assert [r[0] for r in rows] == ["unknown", "2024-02-29T00:00:00.001Z"]


def test_outlines(symbols):
    found = {(r.path, r.name, r.kind) for r in symbols.collect()}
    for want in [
        ("src/agent.rs", "Agent", "struct"),
        ("src/agent.rs", "Agent", "impl"),
        ("src/agent.rs", "new", "method"),
        ("src/agent.rs", "build_agent", "function"),
        ("src/agent.rs", "use crate::engine::Engine;", "import"),
        ("src/boot.ts", "Boot", "class"),
        ("src/boot.ts", "run", "method"),
        ("src/boot.ts", "boot", "function"),
        ("src/style.ts", "color", "constant"),
        ("src/tool.py", "Tool", "class"),
        ("src/tool.py", "run", "method"),
        ("src/tool.py", "LIMIT", "constant"),
        ("docs/readme.md", "Title", "module"),
    ]:
        assert want in found
    assert ("src/tool.py", "inner", "function") not in found
    spans = {(r.name, r.kind): (r.line_start, r.line_end) for r in symbols.where("path = 'src/agent.rs'").collect()}
    assert spans["Agent", "struct"] == (3, 5) and spans["Agent", "impl"] == (7, 11) and spans["new", "method"] == (8, 10)


def test_search(project, symbols):
    refs = search.word_refs(project, "build_agent", symbols).collect()
    kinds = {r.path: r.kind for r in refs}
    assert kinds == {"src/agent.rs": "definition", "src/tool.py": "definition", "docs/readme.md": "doc", "tests/agent_test.rs": "test"}
    page = search.ranked_page(search.word_refs(project, "build_agent", symbols), 1, 2).collect()
    assert [r.pos for r in page] == [2, 3]
    assert [r.path for r in search.callers(project, symbols, "build_agent").collect()] == ["docs/readme.md", "tests/agent_test.rs"]
    hits = search.text_search(project, symbols, "boot()", 10, glob="*.ts").collect()
    assert [(h.path, h.line_num, h.scope) for h in hits] == [("src/app.ts", 6, "start"), ("src/boot.ts", 7, "boot")]
    assert search.search(project, "zz", 5).count() == 0 and search.search(project, "zx qq", 5).count() == 0
    with pytest.raises(ValueError):
        search.search_regex(project, "a(?=b)", 5)
    assert outline.symbol_search(symbols, "build agent").first().name == "build_agent"


def test_dependencies(spark, project):
    edges, lost = deps.resolve(project, outline.imports(project))
    assert {tuple(r) for r in edges.collect()} >= {("src/app.ts", "src/boot.ts"), ("src/boot.ts", "src/app.ts"), ("src/app.ts", "src/style.ts"), ("src/agent.rs", "src/engine.rs")}
    assert [(r.path, r["import"]) for r in lost.collect()] == [("src/broken.ts", "./missing")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert {r.path for r in deps.transitive(spark, chain, "a").collect()} == {"a", "b", "c", "d"} - {"a"}
    assert {r.path for r in deps.transitive(spark, chain, "d", reverse=True).collect()} == {"a", "b", "c"}
    assert {(r.component, r.path) for r in deps.components(spark, chain).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}


def test_audit(spark, project, symbols):
    found = audit.large_files(A.file_table(project), (8, 14)).collect()
    assert {(r.path, r.severity) for r in found} == {("src/agent.rs", "high"), ("src/tool.py", "warning")}
    two = audit.large_files(A.file_table(project), (8, 14)).unionByName(audit.large_symbols(symbols, (3, 99)))
    assert audit.without_ignored(two, patterns=["src/*.rs"]).where("path like '%.rs'").count() == 0
    changed = spark.createDataFrame([("src/boot.ts",)], "path string")
    edges = spark.createDataFrame([("src/app.ts", "src/boot.ts")], "src string, dst string")
    assert {r.path for r in audit.in_scope(two, changed, edges).collect()} <= {"src/boot.ts", "src/app.ts"}
    assert audit.in_scope(two, changed.limit(0), edges).count() == 0
    assert audit.summary(two.limit(0)).first().passed


def test_pipe(project):
    assert pipe.run(project, "glob src/*.ts | search import | limit 2").count() == 2
    assert pipe.run(project, "glob *.py | count").first().n == 1
    assert pipe.run(project, "search build_agent | filter docs").count() == 1
    for bad in ("", "glob", "nonsense x"):
        with pytest.raises(pipe.PipeError):
            pipe.run(project, bad)


def test_metrics(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "case int, item string")
    got = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3)], "case int, item string, rank int")
    rows = {r.case: (r.recall_5, r.recall_10, r.reciprocal_rank) for r in metrics.rank_scores(want, got).collect()}
    assert rows == {1: (0.5, 0.5, 0.5), 2: (1.0, 1.0, 1.0)}


def test_refresh_and_versions(spark, project):
    walked = project.where("path <> 'src/style.ts'").withColumn("content", F.when(F.col("path") == "src/boot.ts", "new").otherwise(F.col("content")))
    plan = {r.path: r.action for r in changes.refresh_plan(project, walked).collect()}
    assert plan["src/style.ts"] == "remove" and plan["src/boot.ts"] == "reindex" and plan["src/app.ts"] == "keep"
    v = spark.createDataFrame([("a", i, "Replace", i) for i in range(1, 131)], "path string, seq long, op string, size long")
    assert changes.retained(v).agg(F.min("seq")).first()[0] == 31 and changes.changes_since(v, 130).count() == 0


def test_watch(spark, tmp_path):
    v = spark.createDataFrame([("a", 1, "Insert"), ("a", 3, "Replace"), ("b", 2, "Delete")], "path string, seq long, op string")
    v.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = watch.read_changes(spark, f"{tmp_path}/in", "path string, seq long, op string")
    watch.watch(stream, lambda df, n: seen.extend(map(tuple, df.collect())), f"{tmp_path}/check", once=True).awaitTermination(120)
    assert sorted(seen) == [("a", 3, "Replace"), ("b", 2, "Delete")]


def _plain(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    r = duck.sql(Q.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(_plain(x[c]) for c in cols) for x in df.collect()), key=str) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_lines_of_all_documents(spark, duck):
    rows = [tuple(r) for r in Q.QUERIES["lines_explode"](spark, SF).collect()]
    assert {r[0] for r in rows} == {r.path for r in A.document_files(spark, SF).collect()}
    assert sorted(rows) == sorted(duck.sql(Q.DOCS + "SELECT path, language, line_num, line_text FROM l").fetchall())


def test_cells_of_all_lines(spark, duck):
    got = sorted(tuple(r) for r in Q.QUERIES["compact_cells"](spark, SF).collect())
    cut = "SELECT path, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS cell FROM (SELECT path, trim(regexp_replace(line_text, '\\s+', ' ', 'g')) AS t FROM l)"
    assert got == sorted(duck.sql(Q.DOCS + cut).fetchall())


def test_imports_by_suffix(spark):
    sources = {
        "app/main.py": "import pkg.foo\nimport pkg.utils\n",
        "app/net.rs": "use helper::net;\n",
        "lib/pkg/foo/__init__.py": "",
        "lib/helper/net/mod.rs": "",
        "a/utils.py": "",
        "z/pkg/utils.py": "",
        "mod.rs": "",
    }
    f = spark.createDataFrame(list(sources.items()), "path string, content string")
    edges = {tuple(r) for r in deps.resolve(f, outline.imports(f))[0].collect()}
    # a folder by its index file; the longer term before the lesser path
    assert edges == {("app/main.py", "lib/pkg/foo/__init__.py"), ("app/main.py", "z/pkg/utils.py"), ("app/net.rs", "lib/helper/net/mod.rs")}


def test_postings_are_counted_in_full(spark):
    files = A.document_files(spark, SF)
    words = Q.QUERIES["word_postings_counts"](spark, SF)
    assert words.agg(F.sum("n")).first()[0] == search.word_postings(files).count()
    trigrams = Q.QUERIES["trigram_postings_counts"](spark, SF)
    assert trigrams.agg(F.sum("files")).first()[0] == search.trigram_postings(files).count()


def test_generated_files_are_ignored(spark):
    paths = ["src/api.gen.ts", "a/user_pb2.py", "Cargo.lock", "web/dist/x.js", "src/agent.rs"]
    rows = spark.createDataFrame([(p, p, []) for p in paths] + [("related", "src/b.rs", ["gen/b.rs"])], "id string, path string, related_paths array<string>")
    assert [r.path for r in audit.without_ignored(rows).collect()] == ["src/agent.rs"]
    assert audit.without_ignored(rows, generated=False).count() == 6
