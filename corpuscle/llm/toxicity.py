"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the hashed byte 3-, 4- and 5-grams that occur in a text (ASCII lower case, white space as one blank each).
Each is scaled by r = log((p / |p|) / (q / |q|)), p and q its smoothed document counts in toxic and other labelled texts,
and a logistic regression is fitted on the scaled features. Only the text is looked at.

The fit uses at most ``SAMPLE`` labelled texts of each class, chosen by a seeded hash of doc_id among rows whose
crc32(doc_id) mod 5 is not 0; that bounds what reaches the driver (a text gives at most 2**18 features). Scoring runs over
all texts. A doc_id that is labelled twice counts as toxic if any of its labels does; null labels are not used. A null or
empty text has no feature and gets the intercept's score; a null doc_id counts as held out. Without labels of both classes
every score is the share of toxic labels (0 if none). Repeated rows are scored each for itself; a very long text is scored
whole, in one step. Columns beside doc_id and text are passed on by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, lean, slices, text_buffer, _U

BITS, ORDERS, SAMPLE, SEED = 18, (3, 4, 5), 1000, 7
SMOOTH, LEAST_DOCS, LEAST_Z, L2, ROUNDS, RATE = 0.5, 4, 2.5, 0.1, 200, 0.05
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def grams(buf: np.ndarray, off: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; with ``weight`` only features of another weight than 0."""
    b = np.zeros(off[-1] - off[0] + 8, np.uint8)
    b[:-8] = _FOLD[buf[off[0] : off[-1]]]
    o = off - off[0]
    n = len(b) - 8
    w = np.ndarray((n,), "<u8", b.data, strides=(1,))
    left = np.repeat(o[1:], np.diff(o)) - np.arange(n)  # bytes from here to the text's end
    found = []
    for k in ORDERS:
        with np.errstate(over="ignore"):
            f = (((w & _U((1 << 8 * k) - 1)) * _U(0x9E3779B97F4A7C15 + 2 * k)) >> _U(64 - BITS)).astype(np.int64)
        ok = left >= k
        if weight is not None:
            ok &= weight[f] != 0
        at = np.flatnonzero(ok)
        found.append((np.searchsorted(o, at, "right") - 1 << BITS) | f[at])
    key = np.unique(np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1)


def _features(it):
    for batch in it:
        buf, off = text_buffer(batch.column("text"))
        for i, j in slices(off):
            doc, f = grams(buf, off[i : j + 1])
            ends = np.searchsorted(doc, np.arange(j - i + 1))
            f = f.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array([f[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])], names=["toxic", "f"])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(spark: SparkSession, df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    # the documents' ids are looked up first, so that labels without a document don't thin out the sample
    rows = rows.join(df.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.zeros(1 << BITS)
    prior = total.get(1, 0) / max(1, sum(total.values()))
    if not total.get(0) or not total.get(1):
        return weight, 20.0 if prior == 1 else -20.0
    picked = spark.createDataFrame([tuple(r) for c in chosen for r in c.collect()], "doc_id long, toxic int")  # 2 * sample rows at most
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    got = texts.select("toxic", "text").mapInArrow(lean(_features), "toxic int, f binary").collect()
    # in an order of their own, so that sums come out alike however tasks end
    got = sorted(((int(r.toxic), bytes(r.f)) for r in got), key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1])))
    y = np.array([t for t, _ in got])
    idx = [np.frombuffer(f, np.int32) for _, f in got]
    p = np.bincount(np.concatenate([f for f, t in zip(idx, y) if t]), minlength=1 << BITS)
    q = np.bincount(np.concatenate([f for f, t in zip(idx, y) if not t]), minlength=1 << BITS)
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    r = np.log((p + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((q + SMOOTH) / (n0 + 2 * SMOOTH))
    z = np.abs(r) / np.sqrt(1 / (p + SMOOTH) + 1 / (q + SMOOTH))
    use = np.flatnonzero((p + q >= LEAST_DOCS) & (z >= LEAST_Z))
    if not len(use):
        return weight, float(np.log(prior / (1 - prior)))
    place = np.full(1 << BITS, -1)
    place[use] = np.arange(len(use))
    idx = [g[g >= 0] for g in (place[f] for f in idx)]
    flat, row = np.concatenate(idx), np.repeat(np.arange(len(y)), [len(f) for f in idx])
    scale = r[use]
    # classes weigh as they are frequent among all labels
    share = np.where(y == 1, prior / n1, (1 - prior) / n0)
    v, b = np.zeros(len(use)), float(np.log(prior / (1 - prior)))
    m, s, mb, sb = np.zeros(len(use)), np.zeros(len(use)), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        margin = np.bincount(row, weights=(v * scale)[flat], minlength=len(y)) + b
        err = share * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        g = np.bincount(flat, weights=err[row], minlength=len(use)) * scale + L2 / len(y) * v
        gb = err.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        step = RATE / (1 - 0.9**t)
        v -= step * m / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    weight[use] = v * scale
    return weight, float(b)


def scores(col: pa.Array, weight: np.ndarray, intercept: float) -> np.ndarray:
    buf, off = text_buffer(col)
    out = np.zeros(len(off) - 1)
    for i, j in slices(off):
        if off[j] > off[i]:
            doc, f = grams(buf, off[i : j + 1], weight)
            out[i:j] = np.bincount(doc, weights=weight[f], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(out + intercept, -40, 40)))


def score_toxicity(spark: SparkSession, df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = spark.sparkContext.broadcast(fit(spark, df, labels, sample))

    def run(it):
        weight, b = model.value
        for batch in it:
            s = scores(batch.column("text"), weight, b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(spark: SparkSession, df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = spark.sparkContext.broadcast(fit(spark, df, labels, sample))

    def run(it):
        weight, b = model.value
        for batch in it:
            yield batch.filter(pa.array(scores(batch.column("text"), weight, b) < 0.5))

    return df.mapInArrow(lean(run), df.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
