"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A text's set is its distinct 5-word shingles (ASCII lower case; fewer words: all of them as one shingle). Two sets link at
Jaccard similarity 0.75 or more, so each must keep one token of the other among its first n - ceil(0.75 n) + 1 under ANY
global order of the tokens. Orders put frequent tokens last (by count, from bounded summaries over all texts), the others
by a hash of their own for each order. A pair is a candidate only if its prefixes meet under every order.

1. Texts with equal sets are one class; only one text of a class goes on, so groups of copies cost one row each.
2. Prefix tokens of the first order are dealt by token, and with them every token up to a hash threshold. A class that has
   too many of the latter alone cannot link and is left out (a text that shares but a passage). The smallest class of each token and size band becomes a pivot;
   what leaves the task is (pivot, class), once for all their common tokens, never the pairs of a token's list.
3. The texts of a pivot's group meet in one task, or, where the group is large, in blocks with the pivot in each. There the
   other orders are intersected and the survivors verified, with counts from matrix products for larger blocks; only a
   spanning forest of the links leaves. Texts that their block does not tie to the pivot are open: blocks of open texts
   then meet all blocks of the group. Texts that are tied are one component already, so a large group of near copies
   costs one pass over its texts, not its pairs.
4. Connected components over those links.

Groups that another one contains are left out. Every candidate pair is in the group of some pivot, so no link is lost and nothing is capped. Null and empty texts, and
texts without words, have the empty set, link with nothing and are their own component. A null doc_id takes part as any
other; a component's id is its smallest doc_id that is not null. Repeated rows are rows of one class. A very long text is
worked on whole. Columns beside doc_id and text are passed on by ``keep_one``, whatever their names. Sets are known by 64
bits of hash, shingles too: among 10**9 different sets some 0.03 false merges are to be expected.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, documents, lean, mix, most_frequent, numbered, parallelism, signed, slices, Spans, stored, text_buffer, unused, Words, _U

N, SHARE, OF = 5, 75, 100
ORDERS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: summaries: most frequent tokens of a run of so many tokens; tokens that the orders put last
CHUNK_TOKENS, LOCAL_TOKENS, LOCAL_LEAST, HOT_TOKENS, HOT_SHARE = 1_500_000, 8192, 4, 65_536, 2000
#: tokens with hashes up to this are dealt for every set, and how often sets that have unshared ones are looked through
THRESHOLD, PEELS = np.uint64(int(0.3 * 2**64)), 2
#: classes and tokens of one block of a group; groups of up to so many are verified pair by pair
BLOCK_CLASSES, BLOCK_TOKENS, PAIRWISE, COLUMNS = 512, 400_000, 16, 2048


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(buf, off, lower=True)
    first = w.first
    count = first[1:] - first[:-1]
    if not len(w.start):
        return [np.zeros(0, np.uint64)] * len(count)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc))
    end = first[1:][doc]
    a = np.flatnonzero((end - at >= n) | ((count[doc] < n) & (at == first[:-1][doc])))
    h = Spans(w.hashes())(a, np.minimum(a + n, end[a]))
    ends = np.searchsorted(doc[a], np.arange(len(count) + 1))
    return [np.unique(h[i:j]) for i, j in zip(ends[:-1], ends[1:])]


def set_class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray, order: int = 0) -> np.ndarray:
    """A set's first n - ceil(0.75 n) + 1 tokens under an order; hot: sorted tokens that come last, by rank."""
    n = len(s)
    p = n - -(-SHARE * n // OF) + 1 if n else 0
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        late = hot[at] == s
    else:
        at = late = np.zeros(n, bool)
    early = s[~late]
    if order:
        early = early[np.argsort(mix(early ^ _U(order)))] if len(early) <= p else early[np.argpartition(mix(early ^ _U(order)), p - 1)[:p]] if p else early[:0]
    out = early[:p]
    if len(out) < p:
        rest = s[late]
        out = np.concatenate((out, rest[np.argsort(rank[at[late]])[: p - len(out)]]))
    return out


def sample(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's prefix under the first order together with all its tokens up to THRESHOLD but hot ones; how many those are."""
    front = prefix(s, hot, rank)
    low = s[: int(np.searchsorted(s, THRESHOLD, "right"))]
    if len(hot) and len(low):
        low = low[hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] != low]
    return np.concatenate((low, front[~np.isin(front, low)])), len(low)


def band(n: np.ndarray) -> np.ndarray:
    """Size bands: sets that can link are in one band or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(OF / SHARE) + 1e-9).astype(np.int64)


def _survey(it):
    """kind 0: doc_id, class, size, text hash of each text. kind 1: token, count of a run's frequent tokens."""
    seen: set[int] = set()
    held, held_n = [], 0

    def batch(kind, a, b, n, t):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["kind", "a", "b", "n", "t"])

    def frequent():
        token, count = np.unique(np.concatenate(held), return_counts=True)
        ok = np.flatnonzero(count >= LOCAL_LEAST)
        ok = ok[np.argsort(-count[ok], kind="stable")[:LOCAL_TOKENS]]
        none = np.zeros(len(ok), np.int64)
        return batch(1, signed(token[ok]), count[ok], none, none)

    for b in it:
        buf, off = text_buffer(b.column("text"))
        for i, j in slices(off):
            sets = shingle_sets(buf, off[i : j + 1])
            cls = [set_class(s) for s in sets]
            yield batch(0, b.column("doc_id").slice(i, j - i), cls, [len(s) for s in sets], b.column("t").slice(i, j - i))
            for c, s in zip(cls, sets):
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    held_n += len(s)
        if held_n >= CHUNK_TOKENS:
            yield frequent()
            held, held_n = [], 0
            seen.clear()
    if held:
        yield frequent()


def _tokens(hot):
    def run(it):
        hot_tokens, rank = hot.value
        seen: set[int] = set()
        for b in it:
            buf, off = text_buffer(b.column("text"))
            for i, j in slices(off):
                found = []
                for s in shingle_sets(buf, off[i : j + 1]):
                    if len(s) and (c := set_class(s)) not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add(c)
                        dealt, low = sample(s, hot_tokens, rank)
                        found.append((c, len(s) << 32 | low, dealt))
                if found:
                    size = [len(p) for *_, p in found]
                    token = np.concatenate([p for *_, p in found])
                    late = np.isin(token, hot_tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(np.repeat([c for c, *_ in found], size)), pa.array(np.repeat([n for _, n, _ in found], size)), pa.array(late)], names=["token", "cls", "nt", "late"])

    return run


def _shared(it):
    """Of rows sorted by token and cls, those whose token is late or another class has too, each once.

    (token, cls, n, low, sampled, late)
    """
    last, held, held_same = None, None, False  # the last row seen; the last one not given out, and if its token came before

    def out(rows):
        nt, token = rows.column("nt").to_numpy(), rows.column("token")
        low = token.to_numpy().view(np.uint64) <= THRESHOLD
        late = rows.column("late").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([token, rows.column("cls"), pa.array((nt >> 32).astype(np.int32)), pa.array(low & ~late), pa.array((nt & 0xFFFFFFFF).astype(np.int32)), rows.column("late")], names=["token", "cls", "n", "low", "sampled", "late"])

    for b in it:
        if not b.num_rows:
            continue
        t, c = b.column("token").to_numpy(), b.column("cls").to_numpy()
        first = np.concatenate(([last != (t[0], c[0])], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        last = (t[-1], c[-1])
        b = b.filter(pa.array(first))
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        t = b.column("token").to_numpy()
        same = np.concatenate(([held_same], t[1:] == t[:-1]))
        held, held_same = b.slice(b.num_rows - 1), bool(same[-1])
        keep = np.flatnonzero(same[:-1] | same[1:] | b.column("late").to_numpy(zero_copy_only=False)[:-1])
        if len(keep):
            yield out(b.take(pa.array(keep)))
    if held is not None and (held_same or held.column("late")[0].as_py()):
        yield out(held)


def _pivots(it):
    """(pivot, cls, n) of rows sorted by token, n and cls; each pair once for a batch."""
    token, here, low, below = None, None, None, None  # the last row's token and band, its band's pivot, the lower band's
    for b in it:
        if not b.num_rows:
            continue
        t, c, n = (b.column(k).to_numpy() for k in ("token", "cls", "n"))
        s = band(n)
        new_token = np.concatenate(([token is None or t[0] != token], t[1:] != t[:-1]))
        new_band = new_token | np.concatenate(([here is None or s[0] != here], s[1:] != s[:-1]))
        heads = np.flatnonzero(new_band)
        # pivot and lower pivot of each block; block 0 may go on from the batch before
        own, under = [low], [below]
        p, q, band_now = low, below, here
        for i in heads.tolist():
            q = p if not new_token[i] and band_now is not None and s[i] == band_now + 1 else None
            p, band_now = int(c[i]), int(s[i])
            own.append(p)
            under.append(q)
        block = np.cumsum(new_band)
        pieces = []
        for which in (own, under):
            ok = np.array([x is not None for x in which])
            value = np.array([0 if x is None else x for x in which], np.int64)
            keep = ok[block] & (value[block] != c)
            pieces.append((value[block][keep], c[keep], n[keep]))
        token, here, low, below = t[-1], int(s[-1]), own[-1], under[-1]
        piv, cls, size = (np.concatenate(x) for x in zip(*pieces))
        if len(piv):
            order = np.lexsort((cls, piv))
            piv, cls, size = piv[order], cls[order], size[order]
            first = np.concatenate(([True], (piv[1:] != piv[:-1]) | (cls[1:] != cls[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(piv[first]), pa.array(cls[first]), pa.array(size[first].astype(np.int32))], names=["piv", "cls", "n"])


def _meets(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share, from products of 0/1 matrices some columns at a time."""
    m = len(sets)
    token, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    used = times > 1
    place = np.cumsum(used) - 1
    ok = used[col]
    row, col = row[ok], place[col[ok]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((m, m), np.float32)
    total = int(used.sum())
    for a in range(0, total, COLUMNS):
        i, j = np.searchsorted(col, (a, a + COLUMNS))
        x = np.zeros((m, min(COLUMNS, total - a)), np.float32)
        x[row[i:j], col[i:j] - a] = 1
        out += x @ x.T
    return out


def _links(sets: list[np.ndarray], side: np.ndarray | None, hot: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block; side: of two blocks only pairs across count."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m <= PAIRWISE:
        root = list(range(m))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        fronts: dict[tuple[int, int], set] = {}

        def front(i, k):
            if (i, k) not in fronts:
                fronts[i, k] = set(prefix(sets[i], hot, rank, ORDERS[k]).tolist())
            return fronts[i, k]

        out = []
        for j in range(1, m):
            for i in range(j):
                if side is not None and side[i] == side[j] or OF * min(size[i], size[j]) < SHARE * max(size[i], size[j]):
                    continue
                a, b = top(i), top(j)
                if a == b or any(front(i, k).isdisjoint(front(j, k)) for k in range(len(ORDERS))):
                    continue
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if OF * same >= SHARE * (size[i] + size[j] - same):
                    root[max(a, b)] = min(a, b)
                    out.append((i, j))
        return out
    ok = OF * np.minimum(size[:, None], size) >= SHARE * np.maximum(size[:, None], size)
    if side is not None:
        ok &= side[:, None] != side
    for k in ORDERS:
        ok &= _meets([prefix(s, hot, rank, k) for s in sets]) > 0
    if not np.triu(ok, 1).any():
        return []
    same = _meets(sets).astype(np.int64)
    ok &= OF * same >= SHARE * (size[:, None] + size - same)
    np.fill_diagonal(ok, False)
    out, left = [], set(range(m))
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(ok[i]).tolist():
                if j in left:
                    left.discard(j)
                    out.append((i, j))
                    todo.append(j)
    return out


def _untied(m: int, links: list[tuple[int, int]], center: int) -> list[int]:
    """Those of m texts that no chain of links ties to the center."""
    near = defaultdict(list)
    for i, j in links:
        near[i].append(j)
        near[j].append(i)
    tied, todo = {center}, [center]
    while todo:
        for j in near[todo.pop()]:
            if j not in tied:
                tied.add(j)
                todo.append(j)
    return [i for i in range(m) if i not in tied]


def _verify(hot, across: bool):
    """Rows (piv, x, y, side, cls, packed text), a block's together; yields links (kind 0: a, b) between classes.

    Without ``across`` a side of 1 says that the group has more blocks: classes not tied to the pivot follow (kind 1: piv,
    cls, size). With it, only pairs of both sides count.
    """

    def run(it):
        hot_tokens, rank = hot.value
        unpack = zstandard.ZstdDecompressor()

        def finish(piv, classes, sets, sides):
            if len(classes) > 1:
                links = _links(sets, np.array(sides) if across else None, hot_tokens, rank)
                for i, j in links:
                    yield 0, classes[i], classes[j], 0
                if not across and sides[0]:
                    for i in _untied(len(classes), links, classes.index(piv)):
                        yield 1, piv, classes[i], len(sets[i])

        def batch(found):
            kind, a, b, n = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["kind", "a", "b", "n"])

        key, classes, sets, sides, found = None, [], [], [], []
        for b in it:
            raw = [unpack.decompress(x) for x in b.column("packed").to_pylist()]
            buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
            own = [s for i, j in slices(off) for s in shingle_sets(buf, off[i : j + 1])]
            for k, side, c, s in zip(zip(*(b.column(x).to_pylist() for x in ("piv", "x", "y"))), b.column("side").to_pylist(), b.column("cls").to_pylist(), own):
                if k != key:
                    if key:
                        found += finish(key[0], classes, sets, sides)
                    key, classes, sets, sides = k, [], [], []
                classes.append(c)
                sets.append(s)
                sides.append(side)
            if found:
                yield batch(found)
                found = []
        if key:
            found = [*finish(key[0], classes, sets, sides)]
            if found:
                yield batch(found)

    return run


def without_unshared(shared: DataFrame) -> DataFrame:
    """Shared tokens without classes that cannot link: too many of their sampled tokens are in no other class.

    A sampled token (not hot, hash up to THRESHOLD) is dealt for every class that has it. One that no other class has is
    missing from each other set, and a set that links misses n - ceil(0.75 n) tokens at most. What is left is counted
    anew among the classes that are left.
    """
    own = shared.groupBy("cls").agg(F.first("n").alias("n"), F.first("sampled").alias("sampled"), F.count_if("low").alias("met"))
    may = own.where(f"sampled - met <= n - ceil({SHARE} * n / {OF})").select("cls")
    left = shared.join(may, "cls", "left_semi")
    early = left.where("not late")
    more = early.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    return early.join(more, "token", "left_semi").unionByName(left.where("late"))


def late_pairs(spark: SparkSession, late: DataFrame) -> DataFrame:
    """(pivot, cls, n) of the tokens that the orders put last, which a large share of all classes may have.

    Pivots are least classes by token and band, summed up before they are dealt (bands x ``HOT_TOKENS`` rows at most), and
    the rows of a frequent token meet its pivots in a join that Spark splits.
    """
    width = f"floor(ln(n) / ln({OF} / {SHARE}) + 1e-9)"
    late = late.select("token", "cls", "n", F.expr(width).cast("int").alias("band"))
    least = stored(spark, late.groupBy("token", "band").agg(F.min("cls").alias("piv")), "pivots")
    both = least.union(least.select("token", F.col("band") + 1, "piv"))
    return late.join(both, ["token", "band"]).where("cls <> piv").select("piv", "cls", "n")


def without_contained(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Groups (piv, cls) without those whose members are all in the group of the smallest pivot that their own belongs to.

    Such a group has no pair that the other lacks; as that pivot is smaller, groups lead to one that stays. What is known
    of a pivot is a written table, so that both sides of its join with the pairs are dealt anew and a large group is split.
    """
    parent = stored(spark, pairs.groupBy("cls").agg(F.min("piv").alias("parent")).select(F.col("cls").alias("piv"), "parent").where("parent < piv"), "parents")
    more = pairs.join(parent, "piv").join(pairs.select(F.col("piv").alias("parent"), "cls"), ["parent", "cls"], "left_anti")
    stays = more.where("cls <> parent").select("piv").distinct()
    gone = stored(spark, parent.select("piv").join(stays, "piv", "left_anti"), "contained")
    return pairs.join(gone, "piv", "left_anti")


def _pack(it):
    z = zstandard.ZstdCompressor(level=3)
    for b in it:
        yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["cls", "packed"])


def classes_of(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, cls, n) of every row of ``df``, and (cls, component) with the smallest doc_id reachable by links."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    wide = parallelism(spark, docs)
    survey = stored(spark, docs.mapInArrow(lean(_survey), "kind int, a long, b long, n long, t long"), "shingles")
    rows = survey.where("kind = 0").select(F.col("a").alias("doc_id"), "t", F.col("b").alias("cls"), "n")
    counts = survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("times"))
    least = max(2 * LOCAL_LEAST, rows.count() // HOT_SHARE)
    top = most_frequent(spark, counts.where(F.col("times") >= least), "times", HOT_TOKENS).collect()  # 16 bytes each
    top.sort(key=lambda r: (-r.times, r.a))
    token = np.array([r.a for r in top], np.int64).view(np.uint64)
    order = np.argsort(token)
    rank = (len(top) - np.arange(len(top)))[order]  # rarest first
    hot = spark.sparkContext.broadcast((token[order], rank))

    # late tokens are dealt by class too: that other classes have them is known
    dealt = docs.select("text").mapInArrow(lean(_tokens(hot)), "token long, cls long, nt long, late boolean").repartition(wide, "token", F.when(F.col("late"), F.col("cls"))).sortWithinPartitions("token", "cls")
    shared = stored(spark, dealt.mapInArrow(lean(_shared), "token long, cls long, n int, low boolean, sampled int, late boolean"), "shared")
    for _ in range(PEELS):
        shared = without_unshared(shared)
    shared = shared.select("token", "cls", "n", "late")
    early = shared.where("not late").drop("late").repartition(wide, "token").sortWithinPartitions("token", "n", "cls")
    both = early.mapInArrow(lean(_pivots), "piv long, cls long, n int").union(late_pairs(spark, shared.where("late")))
    pairs = stored(spark, both.groupBy("piv", "cls").agg(F.first("n").alias("n")), "candidates")
    pairs = stored(spark, without_contained(spark, pairs), "groups")

    # one text of each class that has a candidate
    first = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("r"), F.min("doc_id").alias("low"))
    wanted = pairs.select("cls").union(pairs.select(F.col("piv").alias("cls"))).distinct()
    reps = first.join(wanted, "cls", "left_semi").select("cls", F.col("r.doc_id").alias("rid"), F.col("r.t").alias("rt"))
    texts = docs.join(reps, docs.t.eqNullSafe(reps.rt) & docs.doc_id.eqNullSafe(reps.rid)).select("cls", "text").dropDuplicates(["cls"])
    texts = stored(spark, texts.mapInArrow(lean(_pack), "cls long, packed binary"), "texts")

    # a group's members, in blocks where it is large, each with the pivot
    sizes = pairs.groupBy("piv").agg((F.greatest(F.ceil((F.count(F.lit(1)) + 1) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_TOKENS))).cast("int").alias("nb"))
    sizes = stored(spark, sizes, "sizes")
    members = pairs.select("piv", "cls").join(sizes, "piv").select("piv", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int").alias("block"), "cls", (F.col("nb") > 1).cast("int").alias("side"))
    center = sizes.select("piv", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.col("piv").alias("cls"), (F.col("nb") > 1).cast("int").alias("side"))
    verified = "kind int, a long, b long, n long"

    def met(rows: DataFrame, across: bool) -> DataFrame:
        held = rows.select("piv", "x", "y", "side", "cls").join(texts, "cls").repartition(wide, "piv", "x", "y").sortWithinPartitions("piv", "x", "y", "cls", "side")
        return held.mapInArrow(lean(_verify(hot, across)), verified)

    star = stored(spark, met(members.union(center).withColumn("x", F.col("block")).withColumn("y", F.lit(0)), False), "stars")

    # open classes of large groups: their blocks (x) meet all blocks of the group (y)
    opened = star.where("kind = 1").select(F.col("a").alias("piv"), F.col("b").alias("cls"), "n")
    blocks = opened.groupBy("piv").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("ko"))
    blocks = stored(spark, blocks.join(sizes, "piv"), "blocks")
    left = opened.join(blocks, "piv").select("piv", F.pmod(F.xxhash64("cls"), F.col("ko")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"), F.lit(0).alias("side"), "cls")
    right = members.select("piv", "block", "cls").join(blocks, "piv").select("piv", F.explode(F.sequence(F.lit(0), F.col("ko") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "cls")
    links = star.union(met(left.union(right), True)).where("kind = 0").select("a", "b")
    roots = components(spark, links, "links")
    joined = first.select("cls", "low").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    low = stored(spark, joined.groupBy("root").agg(F.min("low").alias("component")), "lows")
    return rows, joined.join(low, "root").select("cls", "component")


def jaccard_components(spark: SparkSession, df: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, found = classes_of(spark, df)
    out = rows.join(found, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One document of each component, the one with its id, with all columns; texts without words all stay."""
    rows, found = classes_of(spark, df)
    own = rows.where("n > 0").join(found, "cls").withColumn("same", F.col("doc_id").eqNullSafe(F.col("component")))
    # rows of the component's doc_id; of rows that repeat it, one
    winner = stored(spark, own.where("same").groupBy("component").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("copies")), "winners")
    lost = own.join(winner.select(F.col("component").alias("w"), F.col("t").alias("wt"), "copies"), F.col("component").eqNullSafe(F.col("w")))
    # rows that repeat a document are dealt apart from it: what goes is a set of (doc_id, text hash)
    g, gt, place = unused(df, 3)
    gone = lost.where("not same or t <> wt").select(F.col("doc_id").alias(g), F.col("t").alias(gt)).distinct()
    kept = df.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(g)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(gt)), "left_anti")
    if winner.where("copies > 1").limit(1).count():
        # repeated rows of one doc_id: one of those of the chosen text, by least row number, which is found before rows meet
        key = [F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dt")]
        kept = numbered(spark, stored(spark, kept, "kept"), place)
        least = kept.groupBy(*key).agg(F.min(place).alias("least")).select("least").distinct()
        blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.join(least, F.col(place) == F.col("least"), "left").where(F.col("least").isNotNull() | blank).drop(place, "least")
    return kept


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, documents(spark, sf_dir))
