"""Manifests, bundles, tools' answers, accuracy, the stored index, reads with guards, and sources."""

import json

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import audit, config, context, deps, files, index, manifests, metrics, outline
from corpuscle.plans import pipe, tools
from corpuscle.sources import project

from .test_engine import PROJECT

PACKAGE = '{\n  "name": "x",\n  "scripts": {\n    "build": "tsc"\n  },\n  "devDependencies": {\n    "jest": "1"\n  },\n  "workspaces": [\n    "apps/web"\n  ]\n}\n'
CARGO = '[package]\nname = "x"\nauthors = []\n[dependencies]\nserde = "1"\n[features]\nfast = []\n[workspace]\nmembers = ["a", "b"]\n[[bin]]\nname = "tool"\n'


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(p, c, 1000 * i) for i, (p, c) in enumerate(PROJECT.items())], "path string, content string, modified_ms long")


def test_manifests():
    found = list(manifests.package_json(PACKAGE.split("\n")))
    assert found == [("scripts", "module", 3, "package manifest section"), ("build", "constant", 4, "npm script"), ("devDependencies", "module", 6, "package manifest section"), ("jest", "constant", 7, "dev dependency"), ("workspaces", "module", 9, "package manifest section"), ("apps/web", "module", 10, "workspace")]
    found = [(n, k, d) for n, k, _, d in manifests.toml(CARGO.split("\n"), cargo=True)]
    assert [x for x in found if x[2] != "toml section"] == [("name", "constant", "package metadata"), ("serde", "import", "dependencies"), ("fast", "constant", "feature"), ("a", "module", "workspace member"), ("b", "module", "workspace member"), ("tool", "module", "bin")]
    assert [n for n, *_ in manifests.yaml("a:\n  b: 1\n  c:\n    - d: 2\ne: 3\n# f: 4\n".split("\n"))] == ["a", "a.b", "a.c", "a.c.d", "e"]
    symbols, _ = outline.outline("toml", "[a]\nx = 1\n[b]\ny = 2\n", "c.toml")
    assert symbols == [("a", "module", 1, 2, "toml section"), ("x", "constant", 2, 2, "a"), ("b", "module", 3, 4, "toml section"), ("y", "constant", 4, 4, "b")]


@pytest.mark.parametrize(
    "language,content,want",
    [
        ("go", 'package a\nimport (\n  "fmt"\n  "x/y"\n)\ntype T struct {\n  n int\n}\nfunc (t T) Run(a int) int {\n  return a\n}\n', {("T", "struct"), ("Run", "method"), ('import (\n  "fmt"\n  "x/y"\n)', "import")}),
        ("java", "import a.B;\npublic class C {\n  private int n;\n  public int get(int a) {\n    return n;\n  }\n}\n", {("C", "class"), ("get", "method"), ("n", "variable"), ("a.B", "import")}),
        ("c", '#include "x.h"\nstruct P {\n  int a;\n};\nint add(int a, int b) {\n  return a + b;\n}\n', {("P", "struct"), ("add", "function"), ("x.h", "import")}),
        ("sql", "create table t (a int);\nalter table u add b int;\n", {("t", "struct"), ("u", "struct")}),
        ("svelte", "<script>\nimport x from './x';\nexport let name;\n</script>\n<style>\n.box { color: red; }\n</style>\n", {("./x", "import"), ("name", "variable"), (".box", "class")}),
    ],
)
def test_outlines_of_languages(language, content, want):
    symbols, _ = outline.outline(language, content)
    assert want <= {(s[0], s[1]) for s in symbols}


def test_go_block_is_one_import():
    _, imports = outline.outline("go", 'import "a"\nimport (\n  "fmt"\n)\n')
    assert imports == ['import "a"', 'import (\n  "fmt"\n)']


def test_bundle(spark, corpus):
    symbols = outline.symbols(corpus)
    q = "how does build_agent work"
    ranked = context.ranked_symbols(symbols, q)
    rows = ranked.collect()
    assert rows[0].name == "build_agent" and rows[0].path.startswith("src/") and all("tests/" not in r.path for r in rows)
    assert {r.path for r in context.ranked_symbols(symbols, q, language="python").collect()} == {"src/tool.py"}
    assert context.ranked_symbols(symbols, q, prefix="none").count() == 0
    # by path alone: no symbol is called so, and a word of three letters is no core term
    one = spark.createDataFrame([("src/cfg.ts", 0, "color", "constant", 1, 1, None)], symbols.schema)
    assert context.ranked_symbols(symbols.union(one.select(symbols.columns)), "cfg").first().path == "src/cfg.ts"
    lines = context.snippets(corpus, ranked, q).collect()
    assert {("src/agent.rs", 13), ("src/tool.py", 10)} <= {(r.path, r.line_num) for r in lines}
    said = context.render(q, context.bodies(corpus, ranked), context.snippets(corpus, ranked, q), "high")
    assert said.startswith(f"## Context for: {q}\n") and "```text\npub fn build_agent() -> Agent {" in said
    assert "Suggested Next Steps" in context.render(q, context.bodies(corpus, ranked), context.snippets(corpus, ranked, q), "low")
    assert tools.brief_steps(q, "low", 1, 1)[0] == ("symbol_search", {"query": q}) and not tools.brief_steps(q, "high", 1, 0)


def test_shadowed_names_count_less(spark):
    rows = [("src/a.ts", 0, "Widget", "class", 1, 9, None), ("src/a.ts", 1, "createWidget", "function", 11, 12, None), ("src/b.ts", 0, "Widget", "class", 1, 9, None)]
    s = spark.createDataFrame(rows, "path string, ord int, name string, kind string, line_start int, line_end int, detail string")
    got = {(r.path, r.name): r.score for r in context.ranked_symbols(s, "Widget").collect()}
    assert got["src/b.ts", "Widget"] - got["src/a.ts", "Widget"] == 260


def test_pipe_order_and_forms(spark, corpus):
    assert [r.path for r in pipe.run(corpus, "fuzzy agent | limit 1").collect()] == ["src/agent.rs"]
    got = [tuple(r) for r in pipe.run(corpus, "search boot | limit 2").collect()]
    assert got == [("src/app.ts", 1, 'import { boot } from "./boot";'), ("src/app.ts", 6, "  boot();")]
    said = json.loads(pipe.to_json(corpus, "glob src/*.ts | count"))
    assert (said["result_type"], said["kind"], said["count"], said["text"]) == ("count", "files", 4, "4 files")
    assert json.loads(pipe.to_json(corpus, "glob src/style.ts"))["items"] == ["src/style.ts"]
    assert json.loads(pipe.to_json(corpus, "wrong"))["result_type"] == "error"
    assert pipe.render(pipe.evaluate(corpus, "glob src/style.ts | read")) == "=== src/style.ts ===\nexport const color = 1;\n\n"
    assert "L3     struct       Agent" in pipe.render(pipe.evaluate(corpus, "glob src/agent.rs | outline", symbols=outline.symbols(corpus)))


def test_audit_with_settings(spark, corpus):
    edges, lost = deps.resolve(corpus, outline.imports(corpus))
    comps = deps.components(spark, edges)
    found = audit.cycles(comps, edges).collect()
    assert [(r.id, r.severity, r.detail) for r in found] == [("architecture.cycle:src/app.ts", "high", "src/app.ts -> src/boot.ts -> src/app.ts")]
    rust = spark.createDataFrame([("a", "src/x.rs"), ("a", "src/x/y.rs")], "component string, path string")
    assert audit.cycles(rust).first().severity == "warning"
    t = files.file_map(corpus)
    settings = config.parse('[rules]\n"architecture.cycle" = "off"\n[thresholds.symbol_lines]\nwarning = 3\nhigh = 5\n')
    all_ = audit.audit(t, outline.symbols(corpus), edges, lost, comps, None, settings)
    rules = {(r.rule, r.severity) for r in all_.collect()}
    assert ("architecture.cycle", "high") not in rules and ("dependency.unresolved_import", "high") in rules and ("symbol.large", "warning") in rules
    assert audit.fails_strict(all_) and not audit.fails_strict(all_.where("severity = 'warning'"))
    said = json.loads(tools.audit_answer(all_))
    assert said["verdict"] == "warn" and said["columns"][:2] == ["severity", "rule"] and len(said["next"]) <= 2
    assert audit.report(all_.limit(0)).first().verdict == "pass"
    assert audit.first_cycle(["a", "b", "c"], {"a": ["b"], "b": ["c", "b"], "c": ["a"]}) == ["a", "b", "c", "a"]


def test_answers_of_tools(corpus):
    assert len(tools.COLUMNS) == 19
    said = json.loads(tools.answer("files", files.filtered(corpus, "src"), total=9, limit=3, prefix="src", steps=[("outline", {"path": "a"}), ("outline", {"path": "a"})]))
    assert said["columns"] == ["path", "lang", "lines"] and said["truncated"] and said["next"] == [["outline", {"path": "a"}]] and said["prefix"] == "src"
    assert [r[1] for r in json.loads(tools.answer("list", files.children(corpus, "")))["rows"]] == ["dir"] * 3


def test_reads_with_hashes(spark, corpus):
    f = corpus.withColumn("byte_size", F.octet_length("content").cast("long")).unionByName(spark.createDataFrame([("logo.png", None, 0, 77)], "path string, content string, modified_ms long, byte_size long"))
    one = f.where("path = 'src/style.ts'").select("path")
    h = project.content_hash(PROJECT["src/style.ts"])
    assert tuple(files.read(f, one).first()) == ("src/style.ts", PROJECT["src/style.ts"], h, False)
    assert tuple(files.read(f, one, if_hash=h.upper()).first()) == ("src/style.ts", "", h, True)
    assert files.read(f, f.where("path = 'src/tool.py'"), first=2, last=2).first().text == "LIMIT = 3"
    assert files.read(f, f.where("path = 'src/engine.rs'"), compact=True).first().text == "pub struct Engine {\n}"
    assert "77 bytes" in files.read(f, f.where("path = 'logo.png'")).first().text


def test_accuracy(spark, tmp_path):
    v = spark.createDataFrame([(0, "high", "false_positive"), (1, "warning", "correct_actionable"), (2, "high", None), (3, "high", "uncertain"), (4, "high", "correct_not_actionable")], "pos int, severity string, verdict string")
    r = metrics.audit_totals(v).first()
    assert (r.findings, r.reviewed, r.uncertain, r.high_severity_false_positives) == (5, 4, 1, 1)
    assert (r.structural_precision, r.actionable_precision, r.precision_25, r.label_coverage) == (2 / 3, 1 / 3, 1 / 3, 0.8)
    assert metrics.audit_totals(v, top=2).first().precision_25 == 0.5
    m = spark.createDataFrame([(True,), (False,), (True,)], "detected boolean")
    assert tuple(metrics.score_mutations(m).first()) == (3, 2, 2 / 3) and metrics.score_mutations(m.limit(0)).first().recall is None
    rows = spark.createDataFrame([(0, "a", 3), (1, "b", 1), (2, "a", 3)], "pos int, path string, line_num int")
    assert [tuple(x) for x in metrics.extract_items("text-search", rows).orderBy("rank").collect()] == [("a:3", 1), ("b:1", 2)]
    a = spark.createDataFrame([("x", 0.5), ("y", None)], "metric string, value double")
    deltas = metrics.baseline_deltas(a, spark.createDataFrame([("x", 0.75), ("y", 1.0)], "metric string, value double"))
    assert sorted(map(tuple, deltas.collect()), key=str) == [("x", 0.5, 0.75, 0.25), ("y", None, 1.0, None)]
    for n, k in ((100, 7), (5, 9), (10, 10)):
        got = sorted(r.id for r in metrics.evenly_spaced(spark.range(n).repartition(3), "id", k).collect())
        assert got == (list(range(n)) if n <= k else [i * (n - 1) // (k - 1) for i in range(k)])
    paths = spark.createDataFrame([(p,) for p in ("a/b/1", "a/b/2", "a/b/3", "c/1", "c/2", "d")], "path string")
    assert tuple(metrics.bounded_directory(paths, 2).first()) == ("c", 2) and tuple(metrics.bounded_directory(paths, 9).first()) == ("a/b", 3)
    assert "| x | 0.5000 | 0.7500 | 0.2500 |" in metrics.write_report(rows, metrics.score_mutations(m), deltas, f"file://{tmp_path}/report")


def test_stored_index(spark, corpus, tmp_path):
    folder = f"file://{tmp_path}/index"
    snapshot = index.build(spark, corpus, folder)
    t = index.opened(spark, snapshot)
    assert set(t) == set(index.TABLES) and index.graph_is_sound(t)
    assert {(r.path, r.line_num) for r in index.word_lines(t, "Build_Agent").collect()} == {("src/agent.rs", 13), ("docs/readme.md", 2), ("tests/agent_test.rs", 1), ("src/tool.py", 10)}
    assert {r.path for r in index.trigram_candidates(t, "engine").collect()} == {"src/agent.rs", "src/engine.rs"}
    assert {r.line_text for r in index.lines_of(t, index.prefix_lines(t, "lim")).collect()} == {"LIMIT = 3"}
    # one file changed, one touched, one gone, one new
    later = {p: c for p, c in PROJECT.items() if p != "src/boot.ts"} | {"src/missing.ts": "export const x = 1;\n", "src/style.ts": "export const colour = 2;\n"}
    now = spark.createDataFrame([(p, c, 1 if p == "docs/readme.md" else 5 if c != PROJECT.get(p) else 1000 * list(PROJECT).index(p)) for p, c in later.items()], "path string, content string, modified_ms long")
    meta = now.select("path", F.octet_length("content").cast("long").alias("byte_size"), "modified_ms")
    new, todo = index.refresh(spark, snapshot, meta, now.select("path", "content"), folder)
    assert {tuple(r) for r in todo.collect()} == {("src/boot.ts", "remove"), ("src/missing.ts", "add"), ("src/style.ts", "reindex"), ("docs/readme.md", "metadata")}
    u = index.opened(spark, new)
    assert index.word_lines(u, "colour").count() == 1 and index.word_lines(u, "color").count() == 0 and index.word_lines(u, "Boot").where("path = 'src/boot.ts'").count() == 0
    assert {(r.src, r.dst) for r in u["edges"].where("src like '%.ts'").collect()} == {("src/app.ts", "src/style.ts"), ("src/broken.ts", "src/missing.ts")}
    assert u["files"].where("path = 'docs/readme.md'").first().modified_ms == 1
    assert {(r.path, r.op) for r in u["versions"].where(f"seq > {t['versions'].agg(F.max('seq')).first()[0]}").collect()} == {("src/boot.ts", "Delete"), ("src/missing.ts", "Insert"), ("src/style.ts", "Replace")}
    same, nothing = index.refresh(spark, new, meta, now.select("path", "content"), folder)
    assert same == new and nothing.count() == 0
    gone = index.opened(spark, index.remove(spark, new, spark.createDataFrame([("src/missing.ts",)], "path string"), folder))
    assert gone["edges"].where("dst = 'src/missing.ts'").count() == 0 and gone["versions"].where("path = 'src/missing.ts' and op = 'Delete'").count() == 1
    moved = index.opened(spark, index.update_metadata(spark, new, spark.createDataFrame([("src/app.ts", 1, 2)], "path string, byte_size long, modified_ms long"), folder))
    assert tuple(moved["files"].where("path = 'src/app.ts'").select("byte_size", "modified_ms").first()) == (1, 2)
    assert index.opened(spark, index.clear(spark, folder))["files"].count() == 0
    assert {tuple(r) for r in index.set_resolution(u["edges"], "src/app.ts", ["src/tool.py", "src/app.ts"]).where("src = 'src/app.ts'").collect()} == {("src/app.ts", "src/tool.py")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.ts").write_text("let x = 1;\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    assert tuple(project.read_one(spark, str(tmp_path), "a.ts").select("path", "content", "indexed").first()) == ("a.ts", "let x = 1;\n", True)
    assert project.read_one(spark, str(tmp_path), "b.bin").first().indexed is False and project.read_one(spark, str(tmp_path), "none").count() == 0
    (tmp_path / "cases.jsonl").write_text('{"id": 1, "tool": "x"}\n{"id": 2, "tool": "y"}\n')
    assert project.read_records(spark, f"file://{tmp_path}/cases.jsonl", "id int, tool string").count() == 2
    some = ["", "a", "ä" * 50, "x" * 3000, "same"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in some], "t string").select(project.content_hashes(F.col("t"))).collect()] == [project.content_hash(t) for t in some]
    assert {"lib", "docx", "node"} <= project.BINARY and "sqlite" not in project.BINARY
