"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its paragraphs (lines with anything in them). Each paragraph hashes to one wide vector: 16 lanes
of 64 bits from BLAKE2b and 256 lanes of 32 bits that add up +1 or -1 for each 16-byte window of the paragraph (and one for
the paragraph as a whole). A fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2**64 and 2**32. So

* equal multisets have equal fingerprints, in whatever order the paragraphs stand;
* a paragraph is added or taken away by adding or subtracting its vector, without the rest of the text;
* the distance of the 32-bit lanes estimates how much of two texts differs, as the +1 and -1 signs are independent
  (||a - b||**2 is the expected size of what differs). ``likeness`` is 2 a.b / (||a||**2 + ||b||**2), held to 0..1.

A null text is an empty one: no paragraph, the zero vector; two such fingerprints are equal and alike 1.0, an empty and a
non-empty one 0.0. A null doc_id sorts before all others; ties of doc_id are taken in order of a hash of their texts. Repeated
rows follow one another, each is the next document of the one before. A very long text is hashed whole, in one step of its
own. Columns beside doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, _U, documents, id_and_text, numbered, parallelism

LANES, BINS, WINDOW = 16, 256, 16
_NL = 10


def _windows(buf: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The signed window counts, (n, BINS) int64, of newline-free 16-byte windows; owner: the text of each byte."""
    out = np.zeros(n * BINS, np.int64)
    m = len(buf) - WINDOW + 1
    if m > 0:
        raw = np.ascontiguousarray(buf)
        w = np.ndarray((m + 8,), "<u8", raw.data, strides=(1,))
        with np.errstate(over="ignore"):
            h = w[:m] * _U(0x9E3779B97F4A7C15) + w[8 : m + 8] * _U(0xC2B2AE3D27D4EB4F)
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
        breaks = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(buf == _NL, out=breaks[1:])
        ok = breaks[WINDOW:] == breaks[:m]
        h, who = h[ok], owner[:m][ok]
        key = who * BINS + (h >> _U(56)).astype(np.int64)
        sign = (h >> _U(55)) & _U(1)
        out = 2 * np.bincount(key[sign == 1], minlength=n * BINS) - np.bincount(key, minlength=n * BINS)
    return out.reshape(n, BINS)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of UTF-8 texts: (n, 16) uint64 and (n, 256) int32."""
    n = len(texts)
    exact, sketch = np.zeros((n, LANES), np.uint64), np.zeros((n, BINS), np.int64)
    i = 0
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= SLICE_BYTES):
            size += len(texts[j]) + 1
            j += 1
        part = texts[i:j]
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        owner = np.repeat(np.arange(j - i), [len(t) + 1 for t in part])
        sketch[i:j] += _windows(buf, owner, j - i)
        digests, who = [], []
        for k, t in enumerate(part):
            for p in t.split(b"\n"):
                if p:
                    digests.append(hashlib.blake2b(p, digest_size=64, person=b"corpuscle-a").digest() + hashlib.blake2b(p, digest_size=64, person=b"corpuscle-b").digest())
                    who.append(k)
        if digests:
            d = np.frombuffer(b"".join(digests), "<u8").reshape(-1, LANES)
            with np.errstate(over="ignore"):
                np.add.at(exact[i:j], who, d)
            whole = d[:, 0]
            np.add.at(sketch[i:j], (who, (whole & _U(255)).astype(np.int64)), 1 - 2 * ((whole >> _U(8)) & _U(1)).astype(np.int64))
        i = j
    return exact, sketch.astype(np.int32)  # wraps modulo 2**32


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<i4").tobytes()).decode() for a, b in zip(exact, sketch)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * LANES], "<u8"), np.frombuffer(raw[8 * LANES :], "<i4")


def fingerprint(text: str | None) -> str:
    return encode(*vectors([(text or "").encode()]))[0]


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both multisets together, or of the first without the second (sign=-1)."""
    (ae, asx), (be, bs) = decode(a), decode(b)
    with np.errstate(over="ignore"):
        return encode([ae + be if sign > 0 else ae - be], [asx + bs if sign > 0 else asx - bs])[0]


def insert(fp: str, paragraph: str) -> str:
    return combine(fp, fingerprint(paragraph))


def delete(fp: str, paragraph: str) -> str:
    return combine(fp, fingerprint(paragraph), -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, of two lots of vectors."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(np.divide(2 * (x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0), 0, 1 - 1e-9)
    out[(a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)] = 1.0
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text, or all it has."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


def _ordered(*parts: np.ndarray) -> np.ndarray:
    """Rows of 64-bit integers as 24-byte strings in the same order."""
    wide = np.stack([p.astype(np.int64).view(np.uint64) ^ _U(1 << 63) for p in parts], 1).astype(">u8")
    return np.ascontiguousarray(wide).view(f"S{8 * len(parts)}").ravel()


def with_following(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Documents in blocks of consecutive doc_ids, with the first of the next block at the end of each (``tail``).

    Blocks are cut by range of (doc_id, hash of the text, row), so ties and repeated rows are split as any others; the driver
    sees 24 bytes a block. Texts are shuffled once.
    """
    n = parallelism(spark, df)
    least = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    df = numbered(spark, df, "row").select("doc_id", "text", least.alias("k"), F.xxhash64("text").alias("t"), "row")
    ranges = df.select("k", "t", "row").repartitionByRange(n, "k", "t", "row")
    firsts = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "t", "row")).alias("first")).collect()  # one row a block
    bounds = np.sort(_ordered(*(np.array([r.first[i] for r in firsts], np.int64) for i in range(3))))
    shared, last = spark.sparkContext.broadcast(bounds), len(bounds) - 1

    def deal(it):
        for b in it:
            at = _ordered(*(b.column(c).to_numpy() for c in ("k", "t", "row")))
            block = np.searchsorted(shared.value, at, "right") - 1
            first = np.flatnonzero(shared.value[block] == at)
            both = np.concatenate((np.arange(len(at)), first))
            to = np.concatenate((block, np.where(block[first] == 0, last, block[first] - 1)))
            flags = np.concatenate((np.zeros(len(at), bool), np.ones(len(first), bool)))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(both)) for c in ("doc_id", "text", "k", "t", "row")), pa.array(to.astype(np.int32)), pa.array(flags)], names=["doc_id", "text", "k", "t", "row", "b", "tail"])

    dealt = df.mapInArrow(deal, "doc_id long, text string, k long, t long, row long, b int, tail boolean")
    return dealt.repartitionById(max(1, len(bounds)), "b").sortWithinPartitions("b", "tail", "k", "t", "row")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _score(it):
    def rows():
        for batch in it:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "b", "tail", "text")))

    def flush(todo, now, following):
        """todo: (doc_id, text, next text); following: the text after the last, already in todo's last row."""
        texts = [t.encode() for _, t, _ in todo]
        own = vectors([*texts, following.encode()])
        after = [edited(t, f) for _, t, f in todo]
        raw = [t.encode() for t in after]
        new = vectors(raw)
        cur, nxt = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in todo], pa.int64()),
                pa.array([len(t) for _, t, _ in todo], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                pa.array(encode(*cur)),
                pa.array(encode(*new)),
                pa.array(likeness(cur, new)),
                pa.array(likeness(cur, nxt)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    todo, size, last, done = [], 0, None, False
    for doc_id, b, tail, text in rows():
        if last is not None and last[1] == b:
            if not done:
                todo.append((last[0], last[2], text))
                size += len(last[2])
                if tail:  # the first after this block: its later ties are not needed
                    done = True
                    last_text = text
                if size >= SLICE_BYTES or done:
                    yield flush(todo, b, text)
                    todo, size = [], 0
        else:
            done = False
        last = (doc_id, b, text)


def op_fingerprints(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike it is to the edited and to the next text."""
    blocks = with_following(spark, id_and_text(df))
    return blocks.select("doc_id", "b", "tail", "text").mapInArrow(_score, _OUT)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_fingerprints(spark, documents(spark, sf_dir))
