"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose statistic lies above a cutoff. The cutoffs of a stratum (language) are chosen from its labelled
texts in two independent parts. The first part (``TUNING`` of three) lays a path of joint cutoffs from lenient to strict: at
each of ``STEPS`` steps every rule that tells low-quality texts apart has a cutoff, at first some multiples of the largest
value among good texts, then falling quantiles of theirs. The second part tests the steps one after another: with k of n good
texts rejected by any rule, the exact binomial tail P(Bin(n, ALPHA) <= k) is the p-value of "the false rejection rate exceeds
ALPHA". Testing stops at the first step that is not shown (fixed sequence), at level ``DELTA`` divided by the number of
strata (Bonferroni). So with probability 1 - DELTA no stratum loses more than ``ALPHA`` of its good texts to all rules
together. Of the steps shown, the most lenient is taken that still rejects nearly all the low-quality texts that any of them
does. A stratum with too few labelled texts to show anything keeps its texts: with s strata, log(DELTA / s) / log(1 - ALPHA)
good texts in the second part are needed, 90 for five strata, so some 135 labelled good texts in all.

Every language is a stratum, and no language (null) is one; all labelled rows count; counts and cutoffs are tables of a row
a stratum. A base rule goes first: fewer than 20 words, or over 30 % of the words in 8-word windows that occur twice or more.
Null and empty texts have no words and fail it. Null labels are not used; a doc_id that is labelled twice is good only if all
its labels are. Repeated rows and rows without doc_id are judged each for itself; the latter have no label. A very long text
is worked on whole. Columns beside doc_id, lang and text are passed on by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, lean, mix, slices, Spans, stored, text_buffer, unused, Words, _U

ALPHA, DELTA, NEARLY, TUNING, SEED = 0.05, 0.05, 0.98, 1, 11
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: cutoffs of up to so many strata are sent to all tasks; beyond it they are joined by a shuffle
BROADCAST_STRATA = 10_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")
#: numerator, denominator and least cutoff of each rule
RULES = {
    "symbols": ("n_symbols", "n_words", 0.01),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.05),
    "repeated_words": ("n_repeat_words", "n_words", 0.02),
    "capitals": ("n_upper", "word_chars", 0.05),
    "exclaims": ("n_exclaims", "n_words", 0.01),
    "word_length": ("word_chars", "n_words", 1.0),
}
#: the path: multiples of the largest good value, then quantiles of good values; a rule joins if it rejects so many of bad texts
MULTIPLES, QUANTILES, LEAST_GAIN = (4, 3, 2.5, 2, 1.75, 1.5, 1.25, 1.1, 1.0), (0.999, 0.9975, 0.995, 0.99, 0.98, 0.97, 0.95, 0.93, 0.9), 0.01
STEPS = len(MULTIPLES) + len(QUANTILES)
_SYMBOL, _UPPER, _BANG, _LEAD = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_BANG[33] = True
_LEAD[:] = (np.arange(256) & 0xC0) != 0x80
_BLANK = " \t\n\x0b\x0c\r"


def _sums(flags: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[o[1:]] - c[o[:-1]]


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def text_stats(col: pa.Array) -> np.ndarray:
    """The STATS of each text, (n, 8) int64."""
    buf, off = text_buffer(col)
    out = np.zeros((len(off) - 1, len(STATS)), np.int64)
    for i, j in slices(off):
        w = Words(buf, off[i : j + 1])
        o, b, first = w.offsets, w.bytes, w.first
        n = first[1:] - first[:-1]
        out[i:j, 0] = n
        lead = np.concatenate(([0], np.cumsum(_LEAD[b], dtype=np.int64)))
        out[i:j, 1] = _sums(lead[w.end] - lead[w.start], first)
        out[i:j, 2] = _sums(_SYMBOL[b], o)
        out[i:j, 6] = _sums(_UPPER[b], o)
        out[i:j, 7] = _sums(_BANG[b], o)
        if len(w.start) >= WINDOW:
            doc = np.repeat(np.arange(j - i), n)
            a = np.flatnonzero(first[1:][doc] - np.arange(len(doc)) >= WINDOW)
            with np.errstate(over="ignore"):
                key = mix(Spans(w.hashes())(a, a + WINDOW) + doc[a].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(a), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            cover = np.zeros(len(doc) + 1, np.int64)
            cover[a[again]] += 1  # window starts are distinct
            ends = np.bincount(a[again] + WINDOW, minlength=len(doc) + 1)
            out[i:j, 4] = _sums(np.cumsum(cover - ends)[:-1] > 0, first)
    for i, t in enumerate(col.to_pylist()):
        out[i, 5], out[i, 3] = _lines(t or "")
    return out


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _stats_rows(it):
    for batch in it:
        s = text_stats(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(s[:, k]) for k in range(len(STATS)))], names=["doc_id", "lang", *STATS])


def stats(df: DataFrame) -> DataFrame:
    """doc_id, lang and the statistics of every text."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return docs.mapInArrow(lean(_stats_rows), "doc_id long, lang string, " + ", ".join(f"{s} long" for s in STATS))


def ratio(rule: str):
    a, b, _ = RULES[rule]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def tail(n: int, k: int, a: float) -> float:
    """P(Bin(n, a) <= k): the terms from k downwards, until they no longer count (some root of n of them)."""
    if n == 0 or k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(a) + (n - k) * math.log1p(-a))
    total, i = term, k
    while i > 0 and (term > 1e-18 * total or i > a * n):
        term *= i * (1 - a) / ((n - i + 1) * a)
        total += term
        i -= 1
    return min(1.0, total)


def choose(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int | None:
    """The step to use, None if none is shown; good[i], bad[i]: texts that step i is the first to reject, last: none does."""
    n = int(good.sum())
    rejected_good, rejected_bad = np.cumsum(good[:-1]), np.cumsum(bad[:-1])
    shown = -1
    for i, k in enumerate(rejected_good.tolist()):
        if k > alpha * n or tail(n, k, alpha) > delta:
            break
        shown = i
    if shown < 0 or not rejected_bad[shown]:
        return None
    return int(np.argmax(rejected_bad[: shown + 1] >= NEARLY * rejected_bad[shown]))


def stratum():
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("none"))


def paths(tuning: DataFrame) -> DataFrame:
    """stratum and, for each rule, its cutoffs step by step (null: the rule takes no part); tuning: stratum, quality, rules."""
    good, bad = F.col("quality") > 0, F.col("quality") <= 0
    value = {r: F.when(good, F.col(r)) for r in RULES}
    top = tuning.groupBy("stratum").agg(*[F.max(value[r]).alias(f"max_{r}") for r in RULES], *[F.percentile_approx(value[r], list(QUANTILES), 10_000).alias(f"q_{r}") for r in RULES])
    level = {r: F.greatest(F.col(f"max_{r}"), F.lit(least)) for r, (_, _, least) in RULES.items()}
    gains = tuning.where(bad).join(top, "stratum").groupBy("stratum").agg(*[F.avg((F.col(r) > level[r]).cast("int")).alias(f"gain_{r}") for r in RULES])

    def path(r: str):
        steps = F.concat(F.array(*[level[r] * m for m in MULTIPLES]), F.transform(F.col(f"q_{r}"), lambda q: F.least(level[r], F.greatest(q, F.lit(RULES[r][2])))))
        return F.when(F.col(f"gain_{r}") >= LEAST_GAIN, steps).alias(r)

    return top.join(gains, "stratum").select("stratum", *[path(r) for r in RULES])


def _choose_rows(alpha: float, delta: float):
    def run(it):
        for b in it:
            step = []
            for counts in b.column("counts").to_pylist():
                table = np.zeros((2, STEPS + 1), np.int64)
                for c in counts:
                    table[int(c["good"]), c["at"]] += c["n"]
                step.append(choose(table[1], table[0], alpha, delta))
            yield pa.RecordBatch.from_arrays([b.column("stratum"), pa.array(step, pa.int32())], names=["stratum", "step"])

    return run


def calibrate(spark: SparkSession, table: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff for each rule (null: none), for strata with any; table: what ``stats`` gives."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = table.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(marks, "doc_id")
    rows = stored(spark, rows.select(stratum().alias("stratum"), "quality", (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(3)) < TUNING).alias("tuning"), *[ratio(r).alias(r) for r in RULES]), "labelled")
    strata = rows.select("stratum").distinct().count()
    path = stored(spark, paths(rows.where("tuning").drop("tuning")), "paths")
    holdout = rows.where("not tuning").join(path.select("stratum", *[F.col(r).alias(f"path_{r}") for r in RULES]), "stratum")
    # the first step at which a rule rejects: cutoffs fall, so as many as a text does not lie above
    firsts = [F.coalesce(F.size(F.filter(F.col(f"path_{r}"), (lambda r: lambda c: F.col(r) <= c)(r))), F.lit(STEPS)) for r in RULES]
    firsts = [F.when(F.col(f"path_{r}").isNull(), STEPS).otherwise(x) for r, x in zip(RULES, firsts)]
    counts = holdout.groupBy("stratum", (F.col("quality") > 0).alias("good"), F.least(*firsts).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    steps = counts.groupBy("stratum").agg(F.collect_list(F.struct("good", "at", "n")).alias("counts")).mapInArrow(lean(_choose_rows(alpha, delta / max(1, strata))), "stratum string, step int")
    found = steps.where("step is not null").join(path, "stratum")
    return stored(spark, found.select("stratum", *[F.element_at(r, F.col("step") + 1).alias(f"c_{r}") for r in RULES]), "cutoffs")


def with_verdict(table: DataFrame, cutoffs: DataFrame, name: str) -> DataFrame:
    """``table`` (statistics and lang) with whether the rules keep a text; ``BROADCAST_STRATA`` bounds what is sent to all."""
    cut = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs
    kept = ~base_failed(F.col("n_words"), F.col("n_repeat_words"))
    for r in RULES:
        kept &= F.coalesce(ratio(r) <= F.col(f"c_{r}"), F.lit(True))
    return table.withColumn("stratum", stratum()).join(cut, "stratum", "left").withColumn(name, kept)


def judge(spark: SparkSession, df: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every document, whether it fails the base rule and whether it is kept."""
    table = stored(spark, stats(df), "quality")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return with_verdict(table, calibrate(spark, table, labels), "kept").select("doc_id", *STATS[:5], failed.alias("base_failed"), "kept")


def keep_good(spark: SparkSession, df: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    (own,) = unused(df, 1)
    cutoffs = calibrate(spark, stored(spark, stats(df), "quality"), labels)

    def run(it):
        for batch in it:
            s = text_stats(batch.column("text"))
            keep = ~base_failed(s[:, 0], s[:, 4])
            cut = batch.column(own)
            for r, (a, b, _) in RULES.items():
                limit = pc.fill_null(pc.struct_field(cut, f"c_{r}"), math.inf).to_numpy(zero_copy_only=False) if cut.null_count < len(cut) else np.full(len(cut), math.inf)
                keep &= s[:, STATS.index(a)] / np.maximum(s[:, STATS.index(b)], 1) <= limit
            yield batch.drop_columns([own]).filter(pa.array(keep))

    row = F.struct(*[F.col(f"c_{r}") for r in RULES]).alias(own)
    cut = cutoffs.select(F.col("stratum").alias("own_stratum"), row)
    cut = F.broadcast(cut) if cutoffs.count() <= BROADCAST_STRATA else cut
    joined = df.join(cut, stratum() == F.col("own_stratum"), "left").select(*[df[c] for c in df.columns], own)
    return joined.mapInArrow(lean(run), df.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
