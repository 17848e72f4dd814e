"""The pipeline's stages, one after another, each against what brute force says of its own input."""

from collections import defaultdict

import corpus_pipeline
from corpuscle.llm import bpe, quality, toxicity

from .test_operators import brute_components, brute_kept, brute_stats, library_ids

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "substring dedup", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, before = start, rows_of(start)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == start.columns and [f.dataType for f in out.schema] == [f.dataType for f in start.schema]
        after = rows_of(out)
        if name == "toxicity":
            toxic = {r.doc_id for r in toxicity.score_toxicity(spark, docs, labels).where("predicted = 1").collect()}
            assert after == [r for r in before if r[0] not in toxic]
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judge(spark, docs, labels).where("kept").collect()}
            assert after == [r for r in before if r[0] in kept]
            for d, t in before:
                n, _, _, _, again = brute_stats(t)
                assert d not in kept or (n >= 20 and 100 * again <= 30 * n)
        if name == "n-gram Jaccard join":
            groups = defaultdict(list)
            for d, n, c in brute_components(before):
                groups[c if n else ("none", d)].append(d)
            assert [d for d, _ in after] == sorted(min(g) for g in groups.values())
        if name == "substring dedup":
            import hashlib

            want = {d: (gone, digest) for d, _, gone, digest in brute_kept(before)}
            old = dict(before)
            for d, t in after:
                gone, digest = want[d]
                assert (hashlib.sha256(t.encode()).hexdigest() == digest) if gone else t == old[d]
        before = after
        docs = spark.createDataFrame(out.collect(), start.schema)
    pieces = defaultdict(int)
    for p in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        pieces[p.doc_id] += p.length
    assert dict(pieces) == {d: len(library_ids(bpe.WORD_BPE, t)) + 1 for d, t in before}


def test_run_and_registration(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_operators_equal_their_sql(spark):
    import duckdb

    from corpuscle.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE.items():
        df, want = queries.QUERIES[name](spark, SF), con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
