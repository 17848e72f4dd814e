"""Substring dedup: passages that occur more than once, found with compressed FM-indexes.

A window is 35 consecutive words of one text. Every window belongs to one anchor: the least hash among its 28 8-grams (the
leftmost of equals), so equal windows belong to equal anchors wherever they stand. Consecutive windows of one anchor make a
segment. What is repeated is read from FM-indexes only; hashes choose what goes into them:

1. Segments are dealt by anchor. An anchor that one segment alone has holds nothing repeated and ends here. Of the segments
   of the others, the different ones are kept once each, with how often they were seen and a place where they stand.
2. A shard takes the different segments of some anchors and makes one FM-index of them: the suffix order of their words, the
   BWT in a wavelet matrix of compressed bits, and how often the segments of each suffix were seen, summed in suffix order.
   Each of its segments is streamed against it: backward search gives how far left of a word the text still occurs twice or
   more, counting a segment as often as it was seen, and spans of 35 words and more are reported.
3. An anchor with more than ``ANCHOR_SEGMENTS`` different segments (the edge of a passage that very many texts share) would
   make a shard that grows with the input. Its segments are cut into their windows, which are dealt by their own hashes: a
   hash seen once holds nothing repeated, and a window of any other is put, once, into the shard of its hash, as in 2.
4. The spans of a segment go to all places where it stands. Equal segments that one task finds meet as one row in 1, and the
   join in 4 is one that Spark splits where a segment has very many places.

Segments are taken as equal when 128 bits of hash are (64 of the anchor, 64 of all words and the anchor's place), windows of
an anchor as in 3 when 64 bits are: among 10**12 segments the odds of one false match are some 10**-15; in 3 a false match
needs two windows of such anchors to meet in 64 bits, some 10**-2 among 10**9 of them. Nothing is ever missed by hashes.

Windows are judged on the input: a word is removed if any window over it starts anywhere else too, in the same text or
another. Null and empty texts and those under 35 words have no window and lose nothing. Rows that repeat are copies of each
other: what they hold is repeated. A null doc_id takes part as any other. A very long text is worked on whole. Columns beside
doc_id and text are passed on by ``remove_repeats``, whatever their names, and not looked at by ``op_substring_dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, lean, mix, parallelism, ragged, signed, slices, Spans, stored, text_buffer, unused, Words

WINDOW, GRAM = 35, 8
ANCHOR_SEGMENTS, SHARD_WORDS = 4096, 400_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- FM-index -------------------------------------------------------------------------------------------------------


class Bits:
    """Bits with rank, in blocks of 256; blocks of zeros only or ones only are stored once for all."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((n // 256 + 1, 4), np.uint64)
        words.reshape(-1).view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).astype(np.int64)
        total = ones.sum(1)
        self.before = (np.cumsum(total) - total).astype(np.int32)
        mixed = (total > 0) & (total < 256)
        self.place = np.where(mixed, 4 * (np.cumsum(mixed) + 1), np.where(total > 0, 4, 0)).astype(np.int32)
        kept = np.concatenate((np.zeros((1, 4), np.uint64), np.full((1, 4), _MAX), words[mixed]))
        self.words = kept.reshape(-1)
        count = np.bitwise_count(kept).astype(np.int64)
        self.inside = (np.cumsum(count, 1) - count).astype(np.uint8).reshape(-1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 8
        at = self.place[block] + (i >> 6 & 3)
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + self.inside[at] + np.bitwise_count(self.words[at] & low).astype(np.int64)


class Wavelet:
    """A wavelet matrix over symbols 0..sigma - 1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, s = [], symbols.astype(np.int32)
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            self.levels.append((level, Bits(bit), int((~bit).sum())))
            s = np.concatenate((s[~bit], s[bit]))
        all_ = np.arange(sigma)
        #: where each symbol's run starts at the end
        self.start = self._down(all_, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i, for each pair."""
        return self._down(c, i) - self.start[c]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a text of symbols in the order of their first ``depth`` symbols, by doubling."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(h):  # as many symbols as fit into one key
        key = key << bits
        key[: n - k] |= t[k:]
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        if h >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        h *= 2


class FMIndex:
    """Counts of sequences of up to ``depth`` symbols in a text of symbols >= 1; weight: what a suffix counts, by its start."""

    def __init__(self, text: np.ndarray, depth: int = 64, weight: np.ndarray | None = None):
        t = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_order(t, depth)
        self.n, self.sigma = len(t), int(t.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=self.sigma))))
        self.bwt = Wavelet(t[order - 1], self.sigma)
        own = np.ones(self.n, np.int64) if weight is None else np.concatenate((weight, [0]))
        self.weight = np.concatenate(([0], np.cumsum(own[order])))

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the sequences with c put in front."""
        both = self.bwt.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
        return self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]

    def leftward(self, text: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each end, the least start >= stop such that text[start:end] counts twice or more (end itself if none)."""
        start = end.copy()
        live = np.flatnonzero(end > stop)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        while len(live):
            lo, hi = self.step(text[start[live] - 1], lo, hi)
            ok = self.weight[hi] - self.weight[lo] >= 2
            live, lo, hi = live[ok], lo[ok], hi[ok]
            start[live] -= 1
            more = start[live] > stop[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return start


def repeated_windows(words: np.ndarray, size: np.ndarray, times: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) of the runs of windows that occur twice or more in all segments together.

    words: those of all segments, one after another; size: how many each has; times: how often each segment counts.
    """
    _, codes = np.unique(words, return_inverse=True)
    begin = np.cumsum(size + 1) - size - 1
    text = np.ones(int(size.sum()) + len(size), np.int64)  # 1 ends a segment
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = codes + 2
    index = FMIndex(text, max(64, int(size.max()) + 1), np.repeat(times, size + 1))
    a, e = begin, begin + size
    # from the right end as far left as it occurs twice
    start = index.leftward(text, e, a)
    known = np.minimum(start, e - window + 1)  # windows from here on are known; repeated if start <= e - window
    whole = np.flatnonzero(e - start >= window)
    found = [(whole, (start - a)[whole], (e - window + 1 - start)[whole])]
    # the windows left of it, from left to right; where one fails, all that hold the failing part are passed over
    at = a.copy()
    live = np.flatnonzero(at < known)
    while len(live):
        end = at[live] + window
        got = index.leftward(text, end, at[live])
        good = got == at[live]
        which = live[good]
        found.append((which, at[which] - a[which], np.ones(len(which), np.int64)))
        at[live] = np.where(good, at[live] + 1, got)
        live = live[at[live] < known[live]]
    which, first, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, which))
    which, first, n = which[order], first[order], n[order]
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (first[1:] != first[:-1] + n[:-1])))[: len(which)]
    heads = np.flatnonzero(new)
    return which[heads], first[heads], np.add.reduceat(n, heads) if len(heads) else n


# --- segments -------------------------------------------------------------------------------------------------------


def segments(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor, hash of all words) of the segments of some texts."""
    n = len(w.start)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    count = w.first[1:] - w.first[:-1]
    doc = np.repeat(np.arange(len(count)), count)
    left = w.first[1:][doc] - np.arange(n)  # words from here to the text's end
    span = Spans(w.hashes())
    low = np.full(n, _MAX)
    at = np.flatnonzero(left >= gram)
    low[at] = span(at, at + gram)
    grams = low.copy()
    where = np.arange(n)

    def merge(low, where, by):
        other, place = np.full(n, _MAX), np.zeros(n, np.int64)
        other[: n - by], place[: n - by] = low[by:], where[by:]
        less = other < low
        return np.where(less, other, low), np.where(less, place, where)

    need, have = window - gram + 1, 1
    while 2 * have <= need:
        low, where = merge(low, where, have)
        have *= 2
    if have < need:
        low, where = merge(low, where, need - have)
    i = np.flatnonzero(left >= window)
    if not len(i):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    owner = where[i]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[i][1:] != doc[i][:-1])))
    a = i[new]
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(i)])))
    o = owner[new]
    with np.errstate(over="ignore"):
        whole = mix(span(a, a + size + window - 1) + (o - a).astype(np.uint64))
    return doc[a], a - w.first[doc[a]], size, grams[o], whole


#: known: 0 as found; 1 this lot has equal segments too; 2 one of those, that need not be dealt by its anchor
_SEGMENT = "anchor long, seg long, doc_id long, t long, start int, windows int, known int"


def _segments(it):
    for b in it:
        buf, off = text_buffer(b.column("text"))
        ids, t = b.column("doc_id"), b.column("t")
        parts = []
        for i, j in slices(off):
            doc, *rest = segments(Words(buf, off[i : j + 1]))
            if len(doc):
                parts.append((doc + i, *rest))
        if not parts:
            continue
        doc, start, size, anchor, whole = (np.concatenate(x) for x in zip(*parts))
        with np.errstate(over="ignore"):
            _, first, which, times = np.unique(mix(anchor + mix(whole)), return_index=True, return_inverse=True, return_counts=True)
        known = np.where(times[which] > 1, 2, 0).astype(np.int32)
        known[first[times > 1]] = 1
        take = pa.array(doc)
        columns = [pa.array(signed(anchor)), pa.array(signed(whole)), ids.take(take), t.take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(known)]
        whole_batch = pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "doc_id", "t", "start", "windows", "known"])
        for k in range(0, len(doc), 50_000):
            yield whole_batch.slice(k, 50_000)


#: a place of a segment; a different segment, with how often it was seen at least; an anchor with too many different ones
PLACE, SEGMENT, HOT = range(3)
_SORTED = "kind int, anchor long, seg long, doc_id long, t long, start int, windows int, times long"


class _Sorter:
    """Reads segments sorted by anchor and segment hash. Only the last row is held, as what follows it decides about it."""

    def __init__(self, most: int):
        self.most = most
        self.held: pa.RecordBatch | None = None
        #: the held row: is its anchor, its segment that of the row before; how often its segment, how many segments of its anchor before
        self.anchor_before, self.seg_before, self.times, self.different = False, False, 0, 0

    @staticmethod
    def _out(rows: pa.RecordBatch, kind: int, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *(rows.column(c) for c in ("anchor", "seg", "doc_id", "t", "start", "windows")), pa.array(times, pa.int64())], names=["kind", "anchor", "seg", "doc_id", "t", "start", "windows", "times"])

    def feed(self, batch: pa.RecordBatch | None):
        """The next rows; None: the end."""
        rows = batch if self.held is None else self.held if batch is None else pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0]
        if rows is None or not rows.num_rows:
            return
        anchor, seg, known = (rows.column(c).to_numpy() for c in ("anchor", "seg", "known"))
        n = len(anchor)
        m = n if batch is None else n - 1
        same_anchor = np.concatenate(([self.anchor_before], anchor[1:] == anchor[:-1], [False]))
        same = np.concatenate(([self.seg_before], (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1]), [False]))
        # sums over the rows of a segment, and of different segments over those of an anchor, that go on from the rows before
        seen = np.cumsum(1 + (known == 1))
        head = np.maximum.accumulate(np.where(same[:n], -1, np.arange(n)))
        times = seen - np.where(head >= 0, np.concatenate(([0], seen))[head], -self.times)
        fresh = np.cumsum(~same[:n])
        head = np.maximum.accumulate(np.where(same_anchor[:n], -1, np.arange(n)))
        different = fresh - np.where(head >= 0, np.concatenate(([0], fresh))[head], -self.different)
        some = (same_anchor[:m] | same_anchor[1 : m + 1]) | (known[:m] == 1)
        if some.any():
            yield self._out(rows.filter(pa.array(np.concatenate((some, np.zeros(n - m, bool))))), PLACE, np.zeros(int(some.sum()), np.int64))
            last = np.flatnonzero(some & ~same[1 : m + 1])
            if len(last):
                yield self._out(rows.take(pa.array(last)), SEGMENT, times[last])
            full = np.flatnonzero(~same_anchor[1 : m + 1] & (different[:m] > self.most))
            if len(full):
                yield self._out(rows.take(pa.array(full)), HOT, different[full])
        if batch is None:
            self.held = None
            return
        self.held = rows.slice(n - 1, 1)
        self.anchor_before, self.seg_before = bool(same_anchor[n - 1]), bool(same[n - 1])
        self.times = int(times[n - 1]) - 1 - int(known[n - 1] == 1)
        self.different = int(different[n - 1]) - int(not same[n - 1])


def _sort_segments(most):
    def run(it):
        s = _Sorter(most)
        for b in it:
            passing = b.column("known").to_numpy() == 2
            if passing.any():
                yield s._out(b.filter(pa.array(passing)), PLACE, np.zeros(int(passing.sum()), np.int64))
                b = b.filter(pa.array(~passing))
            if b.num_rows:
                yield from s.feed(b)
        yield from s.feed(None)

    return run


_CONTENT = "anchor long, seg long, times long, hot boolean, windows int, words array<long>"


def _contents(it):
    """The words of asked segments."""
    for b in it:
        buf, off = text_buffer(b.column("text"))
        lists = b.column("asked")
        at, asked = lists.offsets.to_numpy(), lists.values
        start, windows = (asked.field(c).to_numpy() for c in ("start", "windows"))
        for i, j in slices(off):
            w = Words(buf, off[i : j + 1])
            h = signed(w.hashes())
            a, e = int(at[i]), int(at[j])
            doc = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
            size = windows[a:e].astype(np.int64) + WINDOW - 1
            words = h[ragged(w.first[doc] + start[a:e], size)]
            own = asked.slice(a, e - a)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            whole = pa.RecordBatch.from_arrays([*(own.field(c) for c in ("anchor", "seg", "times", "hot", "windows")), pa.ListArray.from_arrays(pa.array(ends), pa.array(words))], names=["anchor", "seg", "times", "hot", "windows", "words"])
            for k in range(0, e - a, 4096):
                yield whole.slice(k, 4096)


#: runs of repeated windows of a segment (anchor, seg); of a window of a hot anchor (its hash, null)
_RUN = "anchor long, seg long, at int, n int"


def _search_shards(it):
    """Rows of one shard after another: index its segments, stream them against it."""

    def search(parts):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        words = rows.column("words")
        off = words.offsets.to_numpy().astype(np.int64)
        which, at, n = repeated_windows(words.values.to_numpy()[off[0] : off[-1]], np.diff(off), rows.column("times").to_numpy())
        if len(which):
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([rows.column("anchor").take(take), rows.column("seg").take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "seg", "at", "n"])

    shard, parts = None, []
    for b in it:
        if not b.num_rows:
            continue
        own = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for x, y in zip(cuts, cuts[1:]):
            if own[x] != shard:
                if parts:
                    yield from search(parts)
                shard, parts = own[x], []
            parts.append(b.slice(x, y - x))
    if parts:
        yield from search(parts)


def keyed(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))


def repeated_spans(spark: SparkSession, df: DataFrame, anchor_segments: int = ANCHOR_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, t, start, windows): runs of repeated windows, by the word at which the first starts; t: xxhash64(text)."""
    docs = keyed(df)
    wide = parallelism(spark, docs)
    key = F.when(F.col("known") == 2, F.xxhash64("t", "start", "doc_id")).otherwise(F.col("anchor"))
    dealt = docs.mapInArrow(lean(_segments), _SEGMENT).repartition(wide, key).sortWithinPartitions("anchor", "seg")
    found = stored(spark, dealt.mapInArrow(lean(_sort_segments(anchor_segments)), _SORTED), "segments")
    different = found.where(f"kind = {SEGMENT}")
    total = different.agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0]
    if total is None:
        return spark.createDataFrame([], "doc_id long, t long, start int, windows int")
    hot = found.where(f"kind = {HOT}").select("anchor", F.lit(True).alias("hot"))
    asked = different.join(hot, "anchor", "left").select("doc_id", "t", F.struct("anchor", "seg", "times", F.coalesce("hot", F.lit(False)).alias("hot"), "start", "windows").alias("one"))
    by_text = asked.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(F.collect_list("one").alias("asked"))
    joined = docs.join(by_text, docs.t.eqNullSafe(by_text.dt) & docs.doc_id.eqNullSafe(by_text.d)).dropDuplicates(["doc_id", "t"])
    contents = stored(spark, joined.select("text", "asked").mapInArrow(lean(_contents), _CONTENT), "contents")
    whole, cut = contents.where("not hot").select("anchor", "seg", "times", "words"), contents.where("hot")

    # the windows of hot anchors, one of each hash that was seen twice or more
    hashes = F.transform(F.sequence(F.lit(1), F.col("windows")), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))
    single = cut.select("anchor", "seg", "times", F.posexplode(hashes).alias("at", "window"))
    again = single.groupBy("window").agg(F.sum("times").alias("times"), F.min(F.struct("anchor", "seg", "at")).alias("r")).where("times > 1")
    again = again.select("window", "times", "r.*").join(cut.select("anchor", "seg", "words"), ["anchor", "seg"])
    again = again.select(F.col("window").alias("anchor"), F.lit(None).cast("long").alias("seg"), "times", F.slice("words", F.col("at") + 1, F.lit(WINDOW)).alias("words"))

    n_shards = max(1, -(-total // shard_words))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard")
    sharded = whole.union(again).select(shard, "anchor", "seg", "times", "words").repartition(min(n_shards, max(wide, n_shards // 4)), "shard").sortWithinPartitions("shard", "anchor", "seg")
    runs = stored(spark, sharded.mapInArrow(lean(_search_shards), _RUN), "runs")

    one = single.join(runs.where("seg is null").select(F.col("anchor").alias("window")), "window").select("anchor", "seg", "at", F.lit(1).alias("n"))
    every = runs.where("seg is not null").union(one).groupBy("anchor", "seg").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    every = stored(spark, every, "verdicts")
    places = found.where(f"kind = {PLACE}").select("anchor", "seg", "doc_id", "t", "start")
    spans = places.join(every, ["anchor", "seg"]).select("doc_id", "t", "start", F.explode("runs").alias("run"))
    return spans.select("doc_id", "t", (F.col("start") + F.col("run.at")).cast("int").alias("start"), F.col("run.n").alias("windows"))


def with_spans(spark: SparkSession, df: DataFrame, **bounds) -> tuple[DataFrame, str]:
    """``df`` with an array of (start, windows) or null, and that column's name."""
    name, d, dt = unused(df, 3)
    spans = stored(spark, repeated_spans(spark, df, **bounds), "spans")
    by_text = spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "windows")).alias(name)).select(F.col("doc_id").alias(d), F.col("t").alias(dt), name)
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    return df.join(by_text, t.eqNullSafe(F.col(dt)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d)), "left").drop(d, dt), name


def _texts(batch: pa.RecordBatch, name: str):
    """(row, words, removed, kept text as bytes) of every text."""
    buf, off = text_buffer(batch.column("text"))
    lists = batch.column(name)
    at, flat = lists.offsets.to_numpy(), lists.values
    start, windows = (flat.field(c).to_numpy() for c in ("start", "windows"))
    for i, j in slices(off):
        w = Words(buf, off[i : j + 1])
        raw = w.bytes.tobytes()
        a, e = int(at[i]), int(at[j])
        doc = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        begin = w.first[doc] + start[a:e]
        change = np.bincount(begin, minlength=len(w.start) + 1) - np.bincount(begin + windows[a:e] + WINDOW - 1, minlength=len(w.start) + 1)
        stays = np.cumsum(change)[: len(w.start)] == 0
        first, left = w.first, np.concatenate(([0], np.cumsum(stays)))[w.first]
        kept = np.flatnonzero(stays)
        x, y = w.start[kept].tolist(), w.end[kept].tolist()
        for k, (f, g, p, q) in enumerate(zip(first.tolist(), first[1:].tolist(), left.tolist(), left[1:].tolist())):
            yield i + k, g - f, g - f - q + p, b" ".join([raw[u:v] for u, v in zip(x[p:q], y[p:q])])


def op_substring_dedup(spark: SparkSession, df: DataFrame, **bounds) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of what stays of every text."""
    docs, name = with_spans(spark, df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **bounds)

    def run(it):
        for b in it:
            rows = [(n, gone, hashlib.sha256(raw).hexdigest()) for _, n, gone, raw in _texts(b, name)]
            if rows:
                n, gone, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(spark: SparkSession, df: DataFrame, **bounds) -> DataFrame:
    """``df`` without repeated passages: texts that lose words become what stays, joined by blanks; others stay as they are."""
    schema = df.schema
    docs, name = with_spans(spark, df, **bounds)

    def run(it):
        for b in it:
            texts = b.column("text").to_pylist()
            for i, _, gone, raw in _texts(b, name):
                if gone:
                    texts[i] = raw.decode()
            out = b.drop_columns([name])
            at = out.schema.get_field_index("text")
            out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
            if (at := out.schema.get_field_index("n_chars")) >= 0:
                out = out.set_column(at, out.schema.field(at), pa.array([None if t is None else len(t) for t in texts], out.schema.field(at).type))
            yield out

    return docs.mapInArrow(lean(run), schema)


def op9_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_substring_dedup(spark, documents(spark, sf_dir))
