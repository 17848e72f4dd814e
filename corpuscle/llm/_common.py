"""Shared pieces of the training-data operators: work folders, byte-level word hashing, Arrow helpers.

Python code runs through ``mapInArrow`` and works on the UTF-8 buffer of a whole Arrow batch with numpy, in slices of
about half a MB, so no per-word Python objects exist on the hot paths that use it.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one numpy step works on; a longer single text is one step of its own
SLICE_BYTES = 1 << 19
_B = 0x9E3779B97F4A7C15 | 1
try:  # only some C libraries have it
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim
except (OSError, AttributeError):
    _LIBC = None
_U = np.uint64


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, and the master local, under the temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corpuscle-work")
    return f"{base.rstrip('/')}/corpuscle/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared work folder and read it back."""
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Shuffle width: the session's, or the number of input splits where that is larger."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions() if df is not None else 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, null texts as empty ones; extra columns of any name never reach it."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, for columns that an operator adds for a while."""
    have = {c.lower() for c in df.columns}
    return [f"own_{k}" for k in range(n + len(have)) if f"own_{k}" not in have][:n]


def numbered(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row that is the same whenever it is read again: a hash of its file and place there.

    Of the file's name only the part up to its first number counts, as writers add random ones. So rows of few files may get
    equal numbers, never many of one file. What is not read from Parquet files is written first.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = stored(spark, df, "rows")
    return df.select("*", F.xxhash64(F.regexp_extract("_metadata.file_name", r"^\D*\d*", 0), F.col("_metadata.row_index")).alias(name))


def most_frequent(spark: SparkSession, counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest ``n``, ``most`` at most: those of the highest eighths of a doubling that fit.

    The driver gets how many rows each eighth has, so it never sees more than ``most`` rows from all tasks together.
    """
    counts = stored(spark, counts.withColumn("eighth", F.floor(8 * F.log2(n)).cast("int")), "counts")
    least, total = None, 0
    for r in sorted(counts.groupBy("eighth").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r.eighth
    return counts.where(F.lit(False) if least is None else F.col("eighth") >= least).drop("eighth")


# --- numpy over Arrow buffers -------------------------------------------------------------------------------------


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, o


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges [i, j) whose texts have about ``most`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def lean(run):
    """``run`` (an iterator of batches to one) that gives unused memory back when its task ends: workers live on."""

    def task(it):
        try:
            yield from run(it)
        finally:
            release()

    return task


def release() -> None:
    """Give memory that nothing uses back to the machine."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv_base = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = np.full(m, self.base, np.uint64), np.full(m, self.inv_base, np.uint64)
                self.up[0] = self.down[0] = 1
                np.cumprod(self.up, out=self.up)
                np.cumprod(self.down, out=self.down)
        return self.up, self.down


_bytes_pow, _words_pow = _Powers(_B), _Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h = h * _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: start and end bytes, first word of each text, 64-bit hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        base = off[0]
        b = buf[base : off[-1]]
        o = off - base
        self.bytes = b = _LOWER[b] if lower else b
        gap = np.ones(len(b) + 1, bool)
        space = _SPACE[b]
        gap[:-1] = space
        before = np.empty(len(b), bool)
        if len(b):
            before[0] = True
            before[1:] = space[:-1]
            edges = o[:-1][o[:-1] < len(b)]
            before[edges] = True
            ends = gap[1:].copy()
            inner = o[(o > 0)] - 1
            ends[inner] = True
            word = ~space
            self.start = np.flatnonzero(before & word)
            self.end = np.flatnonzero(ends & word) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, o)
        self.offsets = o

    def hashes(self) -> np.ndarray:
        n = len(self.bytes)
        up, down = _bytes_pow(n + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(n + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + _U(1)) * up[:n], out=c[1:])
            return mix((c[self.end] - c[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


class Spans:
    """64-bit hashes of runs of words, from prefix sums over the words' hashes."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = _words_pow(len(h) + 1)
        with np.errstate(over="ignore"):
            self.c = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * self.up[: len(h)], out=self.c[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.c[b] - self.c[a]) * self.down[a] + (b - a).astype(np.uint64))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batches(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


# --- connected components -------------------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: any orderable type), root the smallest node of its component.

    Alternating large-star and small-star steps; each round's edges are a written table, so a lost executor repeats one
    round at most. Nothing but a changed flag reaches the driver. Least neighbours are written before they are joined, so
    that both sides of a join are dealt for it and Spark splits the node that very many others hang on.
    """
    e = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(spark, large.where("u <> v").distinct(), name)
        low = stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(spark, small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        # a star forest: no node is both a leaf and a root
        done = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0
        if done and new.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            roots = new.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        e = new
