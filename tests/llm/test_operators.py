"""The operators against brute force, on small tables with nulls, copies, ties, long texts and extra columns."""

import base64
import functools
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bpe, fingerprints, ngram_join, packing, quality, seekable, sharding, substring, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, n int, shard string"


def texts():
    rnd = np.random.default_rng(5)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words, int(rnd.integers(30, 160)))) for _ in range(14)]
    out = {i: t for i, t in enumerate(base)}
    out[20], out[21], out[22] = base[0], base[0], base[0].upper()
    for k in range(6):  # near copies of one text
        w = base[1].split(" ")
        w[3 * k + 1] = f"changed{k}"
        out[30 + k] = " ".join(w)
    passage = " ".join(f"shared{i}" for i in range(52))
    for k in range(5):
        out[40 + k] = f"{base[2 + k]}\n{passage}\nend{k} {base[7 + k]}"
    out[50], out[51], out[52], out[53], out[54] = "", None, "one", "  \n\t ", "a b c d"
    out[55] = "x" * 3000 + " " + "same words again " * 400
    out[56] = "a b c d"
    out[57] = "<|endoftext|> it's 12² naïve 日本　\u0085 <|startoftext|>"
    out[58] = "line one of it\nline one of it\n\n  \nother *line* # | <a>"
    return out


def table(spark, rows=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = list(texts().items()) if rows is None else rows
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, "s", None, "x", 1, "y") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """With a null doc_id, a doc_id of two texts and a row that is there twice."""
    return table(spark, [*texts().items(), (None, "null id " * 20), (3, "another text of three"), (52, "one"), (5, texts()[5])])


def collect(df, *key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [(r[k] is not None, r[k]) for k in key])


# --- 1


def test_fingerprints(spark):
    got = collect(fingerprints.op_fingerprints(spark, table(spark)), "doc_id")
    docs = sorted((d, t or "") for d, t in texts().items())
    assert [r["doc_id"] for r in got] == [d for d, _ in docs]
    for (_, t), (_, following), r in zip(docs, docs[1:] + docs[:1], got):
        after = fingerprints.edited(t, following)
        q = len(t) // 4
        assert after == (t[: len(t) - q] + following[:q] if q else t)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(after.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t) and r["edited_fingerprint"] == fingerprints.fingerprint(after)
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (fingerprints.fingerprint(t) == fingerprints.fingerprint(after))
    assert got[0]["fingerprint"] == got[14]["fingerprint"]  # copies 0 and 20


def test_fingerprint_algebra():
    f = fingerprints.fingerprint
    a = f("one paragraph\nsecond one, longer than the window\nthird")
    assert a == f("third\n\none paragraph\nsecond one, longer than the window\n")
    assert a == fingerprints.insert(f("one paragraph\nthird"), "second one, longer than the window")
    assert fingerprints.delete(a, "third") == f("one paragraph\nsecond one, longer than the window")
    assert f("x\nx") != f("x") and f(None) == f("")


def brute_fingerprint(text):
    """The sum of the paragraphs' vectors, a window and a digest at a time."""
    exact, sketch = [0] * 16, [0] * 256
    for p in (text or "").encode().split(b"\n"):
        if not p:
            continue
        d = hashlib.blake2b(p, digest_size=64, person=b"corpuscle-a").digest() + hashlib.blake2b(p, digest_size=64, person=b"corpuscle-b").digest()
        lanes = [int.from_bytes(d[8 * i : 8 * i + 8], "little") for i in range(16)]
        exact = [(a + b) % 2**64 for a, b in zip(exact, lanes)]
        sketch[lanes[0] & 255] += 1 - 2 * (lanes[0] >> 8 & 1)
        for i in range(len(p) - 15):
            x, y = (int.from_bytes(p[i + k : i + k + 8], "little") for k in (0, 8))
            h = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            sketch[h >> 56] += 2 * (h >> 55 & 1) - 1
    return base64.b64encode(np.array(exact, "<u8").tobytes() + np.array(sketch, "<i4").tobytes()).decode(), np.array(sketch, float)


def test_fingerprints_by_brute_force(spark, odd):
    """All columns, with ties of doc_id, a null one, and repeated rows that are cut into several blocks."""
    many = odd.union(table(spark, [(5, texts()[5])] * 40 + [(None, "x " * 50)] * 3)).repartition(7)
    n = many.count()
    got = fingerprints.op_fingerprints(spark, many.select("doc_id", "text")).collect()
    assert len(got) == n
    own = {t: brute_fingerprint(t) for t in {r.text or "" for r in odd.collect()} | {"x " * 50}}
    pool = Counter((r.doc_id, r.text or "") for r in many.collect())
    by_print = defaultdict(list)
    for t, (f, _) in own.items():
        by_print[f].append(t)
    seen = Counter()
    ids = sorted({d for d, _ in pool}, key=lambda d: (d is not None, d or 0))

    def alike(a, b):
        if own[a][0] == own[b][0]:
            return 1.0
        x, y = own[a][1], own[b][1]
        return min(max(2 * x @ y / (x @ x + y @ y), 0), 1 - 1e-9)

    for r in got:
        mine = [t for t in by_print[r.fingerprint] if pool[r.doc_id, t]]
        later = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        after = [t for d, t in pool if d in (r.doc_id, later)]
        fits = [(t, f) for t in mine for f in after if len(t) == r.n_chars and hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest() == r.edited_sha256]
        assert any(abs(alike(t, f) - r.near_next) < 1e-9 and brute_fingerprint(fingerprints.edited(t, f))[0] == r.edited_fingerprint for t, f in fits)
        seen[r.doc_id, r.fingerprint] += 1
    assert seen == Counter((d, own[t][0]) for (d, t), k in pool.items() for _ in range(k))


def test_blocks_split_repeated_rows(spark):
    rows = spark.range(60_000, numPartitions=6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text again").alias("text"))
    blocks = fingerprints.with_following(spark, rows).where("not tail").groupBy("b").count().collect()
    assert len(blocks) >= 4 and max(r["count"] for r in blocks) < 2.5 * 60_000 / len(blocks)


def test_fingerprints_odd_tables(spark, odd):
    assert fingerprints.op_fingerprints(spark, odd).count() == odd.count()
    assert fingerprints.op_fingerprints(spark, odd.limit(0)).count() == 0
    (one,) = fingerprints.op_fingerprints(spark, table(spark, [(7, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


# --- 2


def test_sharding(spark, odd):
    for bucket in (1 << 25, 300):
        out = sharding.external_shuffle(spark, odd, bucket_bytes=bucket, n_shards=4)
        assert sorted(out.columns) == sorted([*odd.columns, "slot"])
        rows = out.collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == odd.count() and max(counts.values()) - min(counts.values()) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.external_shuffle(spark, odd, bucket_bytes=bucket, n_shards=4).collect()), key=str)
    assert sharding.external_shuffle(spark, odd.limit(0)).count() == 0


def test_sharding_repeated_rows(spark):
    """Copies of one row are scattered as other rows are: no bucket takes them all."""
    rows = spark.range(200_000, numPartitions=4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text again").alias("text"))
    out = sharding.external_shuffle(spark, rows, bucket_bytes=200_000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * min(sizes)


def test_sharding_totals_by_join(spark, odd, monkeypatch):
    want = sorted(map(str, sharding.external_shuffle(spark, odd, bucket_bytes=300, n_shards=4).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 0)
    assert sorted(map(str, sharding.external_shuffle(spark, odd, bucket_bytes=300, n_shards=4).collect())) == want


def test_sharding_query(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op2_two_pass_sharding(spark, str(tmp_path)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# --- 3


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low_id = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low_id[top(i)].append(d)
    return [(d, len(sets[i]), min((x for x in low_id[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("pairwise,block", [(16, 512), (1, 3)])
def test_ngram_join(spark, odd, monkeypatch, pairwise, block):
    monkeypatch.setattr(ngram_join, "PAIRWISE", pairwise)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngram_join, "LOCAL_LEAST", 2)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in ngram_join.jaccard_components(spark, odd).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def test_ngram_join_large_group(spark, monkeypatch):
    """A group of many blocks: copies near one text, chains that drift from it, and texts that share a passage."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(ngram_join, "PEELS", 0)
    base = [f"w{i}" for i in range(60)]
    rows, w = [], list(base)
    for k in range(20):
        near = list(base)
        near[2 * k + 3] = f"near{k}"
        w[59 - k] = f"drift{k}"
        rows += [(k, " ".join(near)), (100 + k, " ".join(w)), (200 + k, " ".join(base[:30] + [f"own{k}_{i}" for i in range(30)]))]
    assert ngram_join._untied(5, [(0, 1), (1, 3)], 3) == [2, 4]
    seen, real = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda hot, across: seen.append(across) or real(hot, across))
    got = ngram_join.jaccard_components(spark, table(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(rows))
    assert seen == [False, True]


def test_ngram_join_links_of_a_block():
    rnd = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    sets = []
    for _ in range(40):
        s = rnd.choice(60, int(rnd.integers(38, 50)), replace=False)
        sets.append(np.unique(ngram_join.mix(s.astype(np.uint64))))
    want = {(i, j) for j in range(40) for i in range(j) if 4 * len(set(sets[i]) & set(sets[j])) >= 3 * len(set(sets[i]) | set(sets[j]))}

    def classes(links):
        root = list(range(40))
        for _ in range(40):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert want
    for pairwise in (8, 100):
        ngram_join.PAIRWISE, before = pairwise, ngram_join.PAIRWISE
        try:
            assert classes(ngram_join._links(sets, None, none, none)) == classes(want)
        finally:
            ngram_join.PAIRWISE = before


def test_keep_one(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.keep_one(spark, odd)
    assert got.columns == odd.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    wordless = [r for r in rows if not WORD.search(r[1] or "")]
    comps = defaultdict(list)
    for (d, t), (_, n, c) in zip(rows, brute_components(rows)):
        if n:
            comps[c if c is not None else ("null", t)].append((d, t))
    assert all(kept[r] >= 1 for r in wordless)
    for members in comps.values():
        assert sum(kept[m] for m in set(members)) == 1, members
    assert ngram_join.keep_one(spark, odd.limit(0)).count() == 0


# --- 4


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.read_vocabulary(bpe.tokenizer_path(token_counts.MODEL))
    for fallback in (True, False):
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
        for r in token_counts.count_tokens(spark, odd.select("doc_id", "text"), byte_fallback=fallback).join(odd.select("doc_id", "text"), "doc_id").where("doc_id not in (3, 52, 5)").collect():
            assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
    # ties: the path whose last piece starts first stays
    tie = token_counts.Counter([("<unk>", 0.0), ("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -2.0)], False)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -2.0)], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    for w in ("ab", "abab", "zzab", "abz", "aabb▁ab"):
        assert tie.word(w) == len(t.encode(w).ids)


# --- 5, 6, 10


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_packing(spark, odd):
    rows = Counter()
    pieces = packing.pack_documents(spark, odd, capacity=2048).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    for d, t in texts().items():
        if d in (3, 5, 52):
            continue
        ids = library_ids(bpe.WORD_BPE, t) + [1]
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        rows[d] = at
    assert packing.pack_documents(spark, odd.limit(0)).count() == 0


def test_packer_padding():
    rnd = np.random.default_rng(2)
    p = packing.Packer(0)
    total = 0
    for d in range(3000):
        n = int(rnd.integers(1, 5000))
        p.add(d, bytes(4 * n))
        total += n
    p.close()
    size = Counter()
    for *_, ids, _, s, _ in p.rows:
        size[s] += len(ids) // 4
    assert sum(size.values()) == total
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values()) < 0.002 * total


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path(bpe.BYTE_BPE))
    got = bpe.op_bpe_round_trip(spark, odd).join(odd.select("doc_id", "text"), "doc_id").where("doc_id not in (3, 52, 5)").collect()
    assert len(got) == len(texts()) - 3
    for r in got:
        ids = library_ids(bpe.BYTE_BPE, r.text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.op_bpe_round_trip(spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", [bpe.BYTE_BPE, bpe.WORD_BPE])
def test_encoder_on_random_texts(name):
    rnd = np.random.default_rng(4)
    chars = list("ab 's\n\t1²éÀÿŸ!#\xa0\x85　日ΣİΑ\x1c") + ["<|endoftext|>", "ing", " the"]
    some = ["".join(rnd.choice(chars, int(rnd.integers(1, 50)))) for _ in range(400)] + ["a" * 300, "ab" * 2000]
    enc = bpe.Encoder(bpe.tokenizer_path(name))
    for t, ids in zip(some, enc.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(name, t), t


@pytest.mark.parametrize("name", [bpe.BYTE_BPE, bpe.WORD_BPE])
def test_encoder_on_every_character(name):
    enc = bpe.Encoder(bpe.tokenizer_path(name))
    # EVERY_CHARACTER=1: all (minutes, as the library is slow); else all below U+3400 and a twentieth of the others
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x3400 or p % 20 == 7 or os.environ.get("EVERY_CHARACTER"))]
    for k in range(0, len(points), 20_000):
        some = [f"a{chr(p)}1 {chr(p)}" for p in points[k : k + 20_000]]
        want = library(name).encode_batch(some, add_special_tokens=False)
        different = [hex(p) for p, ids, x in zip(points[k:], enc.encode(some), want) if np.frombuffer(ids, "<u4").tolist() != x.ids]
        assert not different


def test_memo():
    rnd = np.random.default_rng(1)
    memo, held = bpe.Memo(10**6), {}
    for _ in range(30):
        words = list({f"w{rnd.integers(200_000)}".encode() for _ in range(3000)})
        flat, off = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))
        # few hash values: words of equal hash are told apart by their bytes
        h = np.array([int(w[1:]) % 5000 for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = memo.find(h, flat, off[:-1], np.diff(off))
        for w, i in zip(words, at.tolist()):
            if i >= 0:
                a, b = memo.at["ids"][i : i + 2]
                assert memo.data["ids"][a:b].tolist() == held[w]
        known = set(memo.hash[: memo.n].tolist())
        new = {x: i for i, x in enumerate(h.tolist()) if at[i] < 0 and x not in known}
        own = np.array(sorted(new.values()), np.int64)
        if len(own):
            n = np.array([int(words[i][1:]) % 3 for i in own])
            ids = [[int(words[i][1:])] * k for i, k in zip(own, n)]
            held |= {words[i]: x for i, x in zip(own, ids)}
            memo.add(h[own], np.frombuffer(b"".join(words[i] for i in own), np.uint8), np.diff(off)[own], np.array([y for x in ids for y in x], "<u4"), n)
    assert memo.n == len(held) > 4000


def test_transducer(tmp_path):
    rnd = np.random.default_rng(6)
    words = {"".join(rnd.choice(list("abcé"), int(rnd.integers(1, 7)))).encode() for _ in range(500)}
    held = {w: np.array([i, i + 1][: 1 + i % 2], "<u4").tobytes() for i, w in enumerate(sorted(words)) if i % 3}

    def find(lexicon, asked):
        (tmp_path / "lexicon").write_bytes(lexicon.to_bytes())
        mapped = bpe.Lexicon.mapped(str(tmp_path / "lexicon"))
        size = np.array([len(w) for w in asked])
        at = mapped.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
        ids, n = mapped.outputs(at[at >= 0])
        ends = np.cumsum(n)
        found = iter([ids[e - k : e].tobytes() for e, k in zip(ends, n)])
        return [next(found) if i >= 0 else None for i in at]

    asked = [*sorted(words), b"", b"zzz"]
    lexicon = bpe.Lexicon.compile(held)
    assert find(lexicon, asked) == [held.get(w) for w in asked]
    assert len(lexicon.final) < sum(len(w) for w in held)
    assert find(bpe.Lexicon.compile({}), [b"a"]) == [None]


def test_lexicon_changes_no_ids(spark, odd, tmp_path):
    path = bpe.tokenizer_path(bpe.BYTE_BPE)
    words = bpe.frequent_words(spark, odd.select("text"), path)
    few = bpe.frequent_words(spark, odd.select("text"), path, most=40)
    assert len(few) <= 40 < len(words) and few.items() <= words.items()
    (tmp_path / "lexicon").write_bytes(bpe.Lexicon.compile(words).to_bytes())
    some = [t or "" for t in texts().values()]
    enc = bpe.Encoder(path, str(tmp_path / "lexicon"))
    assert enc.encode(some) == bpe.Encoder(path).encode(some) and enc.lexicon is not None
    for ids, t in zip(enc.encode(some), some):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(bpe.BYTE_BPE, t)


def test_seekable_files(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/ids"
    parts = seekable.write_ids(spark, odd, folder, frame_bytes=2000)
    got = collect(seekable.read_ids(spark, folder, parts), "start")
    assert sum(1 for _ in got) == odd.count()
    docs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for (d, t), r in zip(docs, got):
        ids = library_ids(bpe.BYTE_BPE, t) + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    # one document alone, and a damaged frame
    file = max(parts, key=lambda p: p[3])[1]
    data = open(file, "rb").read()
    import io

    reader = seekable.Reader(io.BytesIO(data), len(data))
    doc, ids = reader.frame(len(reader) - 1)[-1]
    assert ids in reader.find(doc) and reader.find(10**9) == []
    bad = bytearray(data)
    bad[int(reader.places[1]) - 3] ^= 1
    with pytest.raises(Exception):
        seekable.Reader(io.BytesIO(bytes(bad)), len(bad)).frame(0)
    assert seekable.read_ids(spark, f"{folder}2", seekable.write_ids(spark, odd.limit(0), f"{folder}2")).count() == 0


# --- 7, 8


def labelled(spark):
    rnd = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(2400):
        toxic, junk = i % 6 == 0, i % 5 == 0
        w = [f"{rnd.choice(list('abcdefg'))}{rnd.choice(list('xyz'))}{rnd.integers(30)}" for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[int(rnd.integers(60))] = str(rnd.choice(["grobble", "snarkit"]))
        if junk:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, int(not junk), int(toxic)))
    rows += [(5000, ""), (5001, None), (None, "some words here")]
    marks += [(5000, None, None), (None, 1, 1), (0, 0, 1)]
    return table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = collect(toxicity.score_toxicity(spark, docs, labels), "doc_id")
    assert len(got) == 2403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 2400 and r["doc_id"] is not None]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) >= 0.98 * len(held)
    kept = toxicity.drop_toxic(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)
    assert toxicity.score_toxicity(spark, docs, labels.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.score_toxicity(spark, docs.limit(0), labels).count() == 0


def brute_stats(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_quality(spark, odd):
    docs, labels = labelled(spark)
    got = collect(quality.judge(spark, docs, labels), "doc_id")
    assert all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 2400 and r["doc_id"] % 5)
    good = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 2400]
    assert not any(r["kept"] for r in good if r["doc_id"] % 5 == 0 and r["doc_id"] % 2)  # shown for both strata
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    rows = Counter((r.doc_id, *brute_stats(r.text or "")) for r in odd.collect())
    for r in quality.judge(spark, odd, labels.limit(0)).collect():
        b = tuple(r[c] for c in quality.STATS[:5])
        assert rows[(r.doc_id, *b)]
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and r.kept == (not r.base_failed)
    assert quality.judge(spark, odd.limit(0), labels).count() == 0


def test_binomial_cutoffs():
    from fractions import Fraction
    from math import comb

    for n, k, a in ((300, 2, Fraction(1, 50)), (300, 20, Fraction(1, 50)), (1000, 44, Fraction(1, 20)), (90, 0, Fraction(1, 20))):
        exact = sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
        assert abs(quality.tail(n, k, float(a)) / float(exact) - 1) < 1e-9
    assert 0 < quality.tail(10**7, 499_000, 0.05) < 0.1
    assert quality.choose(np.array([0, 0, 0, 40]), np.array([9, 0, 0, 0]), 0.02, 0.01) is None  # too few to show
    assert quality.choose(np.array([0, 0, 0, 4000]), np.array([9, 0, 0, 0]), 0.02, 0.01) == 0
    assert quality.choose(np.array([0, 0, 900, 4000]), np.array([5, 5, 90, 0]), 0.02, 0.01) == 1


def test_cutoffs_of_every_language(spark):
    """On sf0.1, cutoffs are shown in all four languages, reject nearly all low-quality texts and hardly any good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(spark, docs, labels).where("not base_failed").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    for r in got.groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect():
        assert r.kept >= 0.95 if r.quality else r.kept <= 0.1


# --- 9


def brute_kept(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [{}, {"anchor_segments": 1, "shard_words": 500}, {"anchor_segments": 3, "shard_words": 500}, {"anchor_segments": 0}])
def test_substring_dedup(spark, odd, bounds):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in substring.op_substring_dedup(spark, odd, **bounds).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_kept(rows)


def test_remove_repeats(spark, odd):
    out = substring.remove_repeats(spark, odd)
    assert out.columns == odd.columns
    before = {(r.doc_id, r.text) for r in odd.collect()}
    for r in out.collect():
        if r.text is not None and "shared" not in str(r.text) and r.doc_id in (12, 13):
            assert (r.doc_id, r.text) in before
        assert "shared7" not in (r.text or "")
        assert r.n_chars is None or r.n_chars == len(r.text)
    assert substring.remove_repeats(spark, odd.limit(0)).count() == 0
    assert substring.op_substring_dedup(spark, odd.limit(0)).count() == 0


def test_fm_index():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        t = rnd.integers(1, 4, 150)
        index = substring.FMIndex(t)
        for _ in range(15):
            n = int(rnd.integers(1, 12))
            s = int(rnd.integers(0, 150 - n))
            lo, hi = np.array([0]), np.array([index.n])
            for c in t[s : s + n][::-1]:
                lo, hi = index.step(np.array([c]), lo, hi)
            assert (hi - lo)[0] == sum((t[i : i + n] == t[s : s + n]).all() for i in range(150 - n + 1))


def test_repeated_windows():
    rnd = np.random.default_rng(9)
    for _ in range(20):
        segments = [rnd.integers(0, 3, int(rnd.integers(6, 20))) for _ in range(12)]
        times = rnd.choice([1, 1, 1, 2, 5], 12)
        seen = Counter()
        for s, k in zip(segments, times):
            for i in range(len(s) - 5):
                seen[tuple(s[i : i + 6])] += int(k)
        which, at, n = substring.repeated_windows(np.concatenate(segments), np.array([len(s) for s in segments]), times, window=6)
        for k, s in enumerate(segments):
            got = [x for a, m in zip(at[which == k], n[which == k]) for x in range(a, a + m)]
            assert got == [i for i in range(len(s) - 5) if seen[tuple(s[i : i + 6])] > 1]


def test_compressed_bits():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 5000):
        bits = np.repeat(rnd.random(n // 200 + 1) < 0.5, 200)[:n] ^ (rnd.random(n) < (0.3 if n < 300 else 0.0002))
        b, at = substring.Bits(bits), np.arange(n + 1)
        assert (b.rank(at) == np.concatenate(([0], np.cumsum(bits)))).all()
    assert len(b.words) < n // 64  # long runs are stored once


# --- very long texts, rows that repeat, empty tables


@pytest.fixture(scope="module")
def long_rows():
    """Texts of several MB, one of a single word, with a passage that another text has; and rows that repeat."""
    rnd = np.random.default_rng(7)
    passage = " ".join(f"shared{i}" for i in range(60))
    words = [f"w{i}" for i in range(5000)]
    huge = " ".join(rnd.choice(words, 400_000))
    near = huge.split(" ")
    near[1000] = "other"
    return [(1, huge + "\n" + passage), (2, "short " + passage), (3, "x" * 2_500_000), (4, "\n".join(["a line of it"] * 120_000)), (5, ""), (6, None), (7, "twice here"), (7, "twice here"), (8, " ".join(near))]


@pytest.fixture(scope="module")
def long_table(spark, long_rows):
    return table(spark, long_rows)


def test_long_texts_fingerprints_and_shards(spark, long_rows, long_table):
    got = fingerprints.op_fingerprints(spark, long_table).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((d, len(t or ""), fingerprints.fingerprint(t)) for d, t in long_rows)
    following = dict(zip([d for d, _ in long_rows], [*long_rows[1:], long_rows[0]]))
    r = next(r for r in got if r.doc_id == 2)
    assert r.edited_sha256 == hashlib.sha256(fingerprints.edited(long_rows[1][1], following[2][1]).encode()).hexdigest()
    rows = sharding.external_shuffle(spark, long_table, bucket_bytes=1 << 20).select("doc_id", F.length("text").alias("n")).collect()
    assert Counter(map(tuple, rows)) == Counter((d, None if t is None else len(t)) for d, t in long_rows)


def test_long_texts_joins(spark, long_rows, long_table):
    got = ngram_join.jaccard_components(spark, long_table).collect()
    want = {1: (1, True), 8: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, False), 6: (6, False), 7: (7, True)}
    assert len(got) == 9 and all((r.component_id, r.n_shingles > 0) == want[r.doc_id] for r in got)
    got = [tuple(r) for r in substring.op_substring_dedup(spark, long_table).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_kept(long_rows)


def test_long_texts_tokens(spark, long_rows, long_table):
    want = {name: {t: library_ids(name, t) for _, t in long_rows} for name in (bpe.BYTE_BPE, bpe.WORD_BPE)}
    got = bpe.op_bpe_round_trip(spark, long_table).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((d, len(want[bpe.BYTE_BPE][t]), hashlib.sha256(",".join(map(str, want[bpe.BYTE_BPE][t])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in long_rows)
    pieces = defaultdict(list)
    for p in packing.pack_documents(spark, long_table).collect():
        pieces[p.doc_id].append(p)
    for d, t in long_rows:
        if d != 7:
            ids, at = [*want[bpe.WORD_BPE][t], 1], 0
            for p in sorted(pieces[d], key=lambda p: p.start):
                assert p.start == at and p.length <= 2048 and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
    assert sum(p.length for p in pieces[7]) == 2 * (len(want[bpe.WORD_BPE]["twice here"]) + 1)
    words = {r.doc_id: (r.n_words, r.n_tokens > 0) for r in token_counts.count_tokens(spark, long_table.where("doc_id <> 3")).collect()}
    assert words[5] == words[6] == (0, False) and words[1] == (400_060, True) and words[7] == (2, True)
    assert token_counts.count_tokens(spark, long_table.limit(0)).count() == 0


def test_long_texts_files(spark, long_rows, long_table, tmp_path):
    rows = [*long_rows, (None, "no id"), (-(2**63), "least id")]
    folder = f"file://{tmp_path}/ids"
    got = collect(seekable.read_ids(spark, folder, seekable.write_ids(spark, table(spark, rows), folder)), "start")
    assert [r["doc_id"] for r in got] == [None, -(2**63), 1, 2, 3, 4, 5, 6, 7, 7, 8]
    at, by_id = 0, dict(rows)
    for r in got:
        ids = library_ids(bpe.BYTE_BPE, by_id[r["doc_id"]]) + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not [f for f in os.listdir(f"{tmp_path}/ids") if f.startswith(".part") and not f.endswith(".crc")]


def test_long_texts_scores(spark, long_rows, long_table):
    _, labels = labelled(spark)
    got = toxicity.score_toxicity(spark, long_table, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in long_rows)
    texts_of = dict(long_rows)
    for r in quality.judge(spark, long_table, labels).collect():
        if r.doc_id != 3:
            assert tuple(r[c] for c in quality.STATS[:5]) == brute_stats(texts_of[r.doc_id] or "")
