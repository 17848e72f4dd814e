"""Bundles over many files: what is outlined, and the same results as over all symbols."""

import re
import time

import pyarrow as pa
import pytest

import __spark_entry__
from corpuscle.functions import exprs as X
from corpuscle.operators import context, outline
from corpuscle.sources import adapters as A

from .test_engine import PROJECT

Q = "where does nation_7 call region"
ODD = {
    "conf/a.yaml": "build:\n  agent: 1\n  re:\n    gion: x\n",
    "package.json": '{\n  "scripts": {\n    "build-agent": "tsc"\n  }\n}\n',
    "src/uni.ts": "export function größe_agent() {\n}\nexport const Größe = 1;\nfunction ΟΔΟΣ() {}\n// ΟΔΟΣ build agent\n",
    "src/kelvin.ts": "export function build_Kite() {\n}\n",
    "src/dup.py": "def build_agent():\n    pass\ndef build_agent():\n    pass\nclass BuildAgent:\n    def run(self):\n        pass\n",
    "src/empty.ts": "",
    "tests/build_agent.rs": "fn build_agent() {\n}\n",
    "src/b_u_i_l_d.go": "package b\nfunc BuildAgent() {\n}\n",
    "src/noimp.ts": "// build_agent only in a comment\n",
    "src/none.xyz": "build_agent",
    "src/cfg.ts": "export const color = 1;\n",
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list((PROJECT | ODD).items()), "path string, content string").cache()


@pytest.mark.parametrize("q", ["how does build_agent work", '"größe" agent tests', "kite build `re gion`", "cfg", ""])
def test_bundle_of_files_is_that_of_all_symbols(odd, q):
    columns = ["path", "name", "kind", "line_start", "line_end", "score"]
    want = context.ranked_symbols(outline.symbols(odd), q, 50).select(columns).collect()
    assert context.ranked_in(odd, q, 50).select(columns).collect() == want and bool(want) == bool(q)


def test_fuzzy_is_the_expression(spark):
    texts = ["src/nation/k7.ts", "nation", "n-a/t_ion", "anation", "nnation", "xyz", "", "ation/nation", "s/call\n_region"]
    for want in ("nation", "call", "ts", "n/a"):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(X.fuzzy_score(want, df["t"])).collect()]
        assert got == [context.fuzzy(want, t) for t in texts]


def test_only_the_nearest_files_are_outlined(monkeypatch):
    done = []
    monkeypatch.setattr(context.outline, "outline", lambda language, content, path: (done.append(path), ([] if path.endswith("k0.ts") else [1], []))[1])
    paths = [f"src/nation/k{i}.ts" for i in range(1000)]
    batch = pa.table({"path": paths, "low": paths, "language": ["typescript"] * 1000, "content": ["x"] * 1000}).to_batches()[0]
    rows = next(context._nearest([(0, "nation"), (3, "zzz")])([batch])).to_pylist()
    assert [(r["ord"], r["path"]) for r in rows] == [(0, p) for p in sorted(p for p in paths if not p.endswith("k0.ts"))[: context.PATHS_A_KEYWORD]]
    assert len(done) < 20  # those near the question as they came, not all


def test_brief_symbols_outlines_once_and_only_what_may_count(spark):
    d = "/root/testdata/sf0.001"
    plan = __spark_entry__.queries()["brief_symbols"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    files = A.key_project(spark, d)
    left = files.where(context._may_define(Q, context.keywords(Q)))
    assert left.where("path like 'src/nation/%'").count() == 25 and left.where("path like 'src/orders/%' or path like 'src/part/%'").count() == 0


def test_brief_symbols_of_many_files_ends(spark):
    began = time.time()
    rows = __spark_entry__.queries()["brief_symbols"](spark, "/root/testdata/sf0.1").collect()
    assert max((r.score, r.path, r.name) for r in rows)[1:] == ("src/nation/k7.ts", "nation_7") and len(rows) == context.TOP
    assert time.time() - began < 120  # not ended after 230 s when every path was scored by interpreted expressions


def test_brief_snippets_reads_few_lines(spark):
    d = "/root/testdata/sf0.001"
    df = __spark_entry__.queries()["brief_snippets"](spark, d)
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()  # the ranked symbols are known by then
    assert df.first().path == "src/nation/k7.ts"


def test_snippets_find_what_a_search_finds(spark):
    """Tiers of each keyword, said again in plain Python over every line."""
    texts = ["nation_7 is", "the Nation", "nation_71", "nation7x", "subnation_7", "call 7", "recall", "NATION_7()", "a nation_7_call b", "größe nation", "7 calls region", "é_nation_7", ""]
    files = spark.createDataFrame([(f"lib/f{i:02}.xyz", t + "\n") for i, t in enumerate(texts)], "path string, content string")
    none = context.ranked_symbols(outline.symbols(files), Q)

    def tier(k, line):
        parts, low, words = k.lower().split(), line.lower(), [w.lower() for w in re.findall(r"\w+", line)]
        if len(parts) > 1:
            return 0 if all(p in low for p in parts) else None
        return next((t for t, hit in ((1, parts[0] in words), (2, any(w.startswith(parts[0]) for w in words)), (3, parts[0] in low)) if hit), None)

    for q in (Q, '"größe" nation', "`7 call` subnation_7"):
        ks, found = context.keywords(q), set()
        for k in ks:
            hits = sorted((t, i) for i, line in enumerate(texts) if (t := tier(k, line)) is not None)
            found |= {i for _, i in hits[: context.HITS]}
        got = context.snippets(files, none, q, 100).collect()
        assert sorted(r.path for r in got) == [f"lib/f{i:02}.xyz" for i in sorted(found)]
