"""Walks, snapshots, edits, settings, output and context bundles."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import config, context, edit, outline
from corpuscle.plans import output
from corpuscle.sources import project


@pytest.fixture()
def tree(tmp_path):
    for p, c in {"src/a.rs": "fn a() {}\n", "src/b.txt": "text", "node_modules/x.js": "x", ".hidden": "h", "out/gen.ts": "g", "Cargo.lock": "l", "logo.png": "\x89", "app.exe": "MZ"}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{p}"), exist_ok=True)
        with open(f"{tmp_path}/{p}", "w", encoding="utf-8") as f:
            f.write(c)
    with open(f"{tmp_path}/src/bad.py", "wb") as f:
        f.write(b"\xff\xfe\x00")
    with open(f"{tmp_path}/.gitignore", "w") as f:
        f.write("out/\n")
    return str(tmp_path)


def test_walk_and_read(spark, tree):
    assert [w[0] for w in project.walk(tree)] == ["logo.png", "src/a.rs", "src/b.txt", "src/bad.py"]
    rows = {r.path: r for r in project.read_project(spark, tree).collect()}
    assert rows["src/a.rs"].content == "fn a() {}\n" and rows["src/a.rs"].indexed
    assert not rows["src/bad.py"].indexed and rows["src/bad.py"].content is None and not rows["logo.png"].indexed
    found = {os.path.basename(r.path): r.indexed for r in project.read_files(spark, f"{tree}/src").collect()}
    assert found == {"a.rs": True, "b.txt": True, "bad.py": False}


def test_snapshot(spark, tmp_path):
    files = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "path string, content string, modified_ms long")
    name = project.save(spark, {"files": files}, f"file://{tmp_path}/snap")
    assert sorted(map(tuple, project.load(spark, name)["files"].collect())) == sorted(map(tuple, files.collect()))
    spark.createDataFrame([("c", "y", 3)], files.schema).write.mode("append").parquet(f"{name}/files")
    with pytest.raises(ValueError):
        project.load(spark, name)
    spark.createDataFrame([(json.dumps({"version": 99, "tables": {}}),)], "value string").write.mode("overwrite").text(f"{name}/manifest")
    with pytest.raises(ValueError):
        project.load(spark, name)


def test_content_hash():
    # published test values of FNV-1a
    assert project.content_hash("") == "cbf29ce484222325" and project.content_hash("a") == "af63dc4c8601ec8c" and project.content_hash("foobar") == "85944171f73967e8"


def test_edits(tmp_path):
    E = edit.Edit
    text = "one\r\ntwo\r\nthree\r\n"
    assert edit.apply(text, E("replace", "2", start=2)) == "one\r\n2\r\nthree\r\n"
    assert edit.apply(text, E("insert", "x\ny", start=4)) == text + "x\r\ny\r\n"
    assert edit.apply(text, E("delete", start=1, end=2)) == "three\r\n"
    assert edit.apply(text, E("replace", "TWO", find="two")) == "one\r\nTWO\r\nthree\r\n"
    assert edit.apply("a b", E("insert", "-", before="b")) == "a -b" and edit.apply("a b", E("insert", "-", after="a")) == "a- b"
    assert edit.apply("a", E("insert", "b", start=2)) == "a\nb"
    for bad in (E("replace", "x"), E("replace", "x", start=9), E("replace", "x", find="zzz"), E("insert", "x", find="two"), E("replace", "x", start=1, find="two")):
        with pytest.raises(edit.EditError):
            edit.apply(text, bad)
    edit.create(str(tmp_path), "d/f.txt", "a\nb\n")
    with pytest.raises(edit.EditError):
        edit.create(str(tmp_path), "d/f.txt", "c")
    with pytest.raises(edit.EditError):
        edit.safe_path(str(tmp_path), "../x")
    got = edit.patch(str(tmp_path), "d/f.txt", E("replace", "B", start=2), if_hash=project.content_hash("a\nb\n"))
    assert got["changed"] and (got["first"], got["removed"], got["added"]) == (2, 1, 1)
    assert open(f"{tmp_path}/d/f.txt").read() == "a\nB\n"
    with pytest.raises(edit.EditError):
        edit.patch(str(tmp_path), "d/f.txt", E("delete", start=1), if_hash="0")


def test_settings():
    c = config.parse('max_findings = 5\nignore_names = ["x"]\n[rules]\n"dead_code.candidate" = "high"\n[thresholds.fan_in]\nwarning = 2\nhigh = 4\n')
    assert c.max_findings == 5 and c.rules["dead_code.candidate"] == "high" and c.thresholds["fan_in"] == (2, 4) and "x" in c.ignore_names and "main" in c.ignore_names
    for bad in ("nonsense = 1", '[rules]\n"file.large" = "loud"', "[thresholds.fan_in]\nwarning = 99"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_output(spark):
    df = spark.createDataFrame([("packages/core/a", 1, None), ("packages/core/b", 2, None)], "path string, n int, empty string")
    out = json.loads(output.render(df.orderBy("path")))
    assert out == {"columns": ["path", "n"], "root": "packages/core/", "rows": [["a", 1], ["b", 2]]}
    assert spark.range(1).select(output.compact(F.lit("a \n b" + "x" * 200))).first()[0] == "a b" + "x" * 114 + "..."


def test_context(spark):
    code = {
        "src/agent.rs": "pub fn create_project_agent() {\n}\npub fn other() {\n}\n",
        "src/app.rs": "fn start() {\n    create_project_agent();\n}\n",
        "tests/agent_test.rs": "fn create_project_agent_test() {\n}\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    symbols = outline.symbols(files)
    q = "create project agents"
    ranked = context.ranked_symbols(symbols, q)
    assert ranked.first().name == "create_project_agent" and all("test" not in r.path for r in ranked.collect())
    assert any("test" in r.path for r in context.ranked_symbols(symbols, q + " test").collect())
    lines = context.snippets(files, ranked, q).collect()
    assert (lines[0].path, lines[0].line_num) == ("src/agent.rs", 1)
    assert context.confidence(ranked, q).first().confidence == "medium"
    assert context.confidence(ranked, "`create_project_agent`").first().confidence == "high"
    assert context.confidence(context.ranked_symbols(symbols, "zzz qqq"), "zzz qqq").first().confidence == "low"
    assert context.bodies(files, ranked).first().body == "pub fn create_project_agent() {\n}"
    assert context.ranked_symbols(symbols, "").count() == 0
