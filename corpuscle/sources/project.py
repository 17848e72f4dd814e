"""Source trees and saved corpora: walking, reading, snapshots, a data source for ``spark.read``."""

from __future__ import annotations

import fnmatch
import json
import os
import subprocess
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import exprs as X

MAX_BYTES = 2 * 1024 * 1024
# fixed values: folders and files that a walk passes over
SKIP_DIRS = {
    ".git", ".hg", ".svn", "node_modules", ".zig-cache", "zig-out", ".next", ".nuxt", ".svelte-kit", "dist", "build", "__pycache__", ".venv", "venv", "target", ".gradle",
    ".idea", ".vscode", "vendor", "Pods", ".cargo", "pkg", "bin", "obj", ".cache", ".turbo", ".parcel-cache", "coverage", ".pytest_cache", ".mypy_cache", ".tox", ".eggs", "*.egg-info",
}
SKIP_FILES = {".DS_Store", "Thumbs.db", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock", "poetry.lock", "go.sum"}
IMAGES = {"png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "avif"}
BINARY = IMAGES | set(
    "exe dll so dylib o a lib mp3 mp4 wav avi mov mkv flv wmv zip tar gz bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx "
    "woff woff2 ttf otf eot pyc pyo class jar min.js min.css wasm node".split()
)
SCHEMA = "path string, content string, byte_size long, modified_ms long, indexed boolean"
FORMAT_VERSION = 1


def _ignored(rules: list[tuple[str, str]], path: str, is_dir: bool) -> bool:
    """Whether ignore rules (folder, pattern) take a path out; the last rule that matches decides."""
    out = False
    for base, rule in rules:
        keep = rule.startswith("!")
        pattern = rule[keep:].rstrip("/")
        if rule.endswith("/") and not is_dir:
            continue
        rel = os.path.relpath(path, base) if base else path
        if rel.startswith(".."):
            continue
        names = [rel] if "/" in pattern.strip("/") else rel.split("/")
        if any(fnmatch.fnmatchcase(n, pattern.lstrip("/")) for n in names):
            out = not keep
    return out


def walk(root: str) -> list[tuple[str, int, int, bool]]:
    """(path, size, mtime in ms, whether its text is read) of a tree's files, sorted; links and hidden files are left out."""
    out, rules = [], []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        rel = "" if rel == "." else rel
        if ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules += [(rel, x.strip()) for x in f if x.strip() and not x.startswith("#")]
        join = lambda n, rel=rel: f"{rel}/{n}" if rel else n
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS and not d.startswith(".") and not os.path.islink(os.path.join(folder, d)) and not _ignored(rules, join(d), True))
        for n in names:
            full = os.path.join(folder, n)
            if n in SKIP_FILES or n.startswith(".") or os.path.islink(full) or not os.path.isfile(full) or _ignored(rules, join(n), False):
                continue
            st = os.stat(full)
            ext = n.rsplit(".", 1)[-1].lower()
            known = any(n.rsplit(".", 1)[-1] in e.split() for e in X.LANGUAGES.values())
            if st.st_size > MAX_BYTES or (not known and ext in BINARY - IMAGES):
                continue
            out.append((join(n), st.st_size, st.st_mtime_ns // 1_000_000, known or ext not in IMAGES))
    return sorted(out)


class _Chunk(InputPartition):
    def __init__(self, files):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.size = options["path"], int(options.get("filesPerPartition", "500"))

    def partitions(self):
        files = walk(self.root)
        return [_Chunk(files[i : i + self.size]) for i in range(0, len(files), self.size)] or [_Chunk([])]

    def read(self, partition):
        for path, size, modified, text in partition.files:
            content = None
            if text:
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", newline="") as f:
                        content = f.read()
                except (OSError, UnicodeDecodeError):
                    content = None
            yield path, content, size, modified, content is not None


class ProjectSource(DataSource):
    """``spark.read.format("project").load(root)``: a source tree on a folder that all workers see."""

    @classmethod
    def name(cls):
        return "project"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_project(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(ProjectSource)
    return spark.read.format("project").load(root)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of any store that Spark reads, without a walk's rules; what is no UTF-8 has a null content."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return b.where(F.col("length") <= MAX_BYTES).select("path", content.alias("content"), F.col("length").alias("byte_size"), F.unix_millis("modificationTime").alias("modified_ms"), content.isNotNull().alias("indexed"))


def changed_files(root: str, base: str) -> list[str]:
    """Paths that a git tree changed since it left ``base``."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-only", "--diff-filter=ACMRT", f"{base}...HEAD"], capture_output=True, text=True, check=True)
    return sorted(set(out.stdout.split("\n")) - {""})


def save(spark: SparkSession, tables: dict[str, DataFrame], folder: str, order: dict[str, tuple[str, ...]] | None = None) -> str:
    """Write tables as Parquet, and a manifest last: without it a snapshot does not exist.

    Tables are sorted by path within files; those of ``order`` are dealt by range of its columns and sorted by them.
    """
    name = f"{folder.rstrip('/')}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    rows = {}
    for table, df in tables.items():
        by = (order or {}).get(table)
        df = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df.sortWithinPartitions("path")
        df.write.parquet(f"{name}/{table}")
        back = spark.read.parquet(f"{name}/{table}")
        checked = back.select(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(c) for c in sorted(back.columns)])), F.lit(0)).alias("hash")).first()
        rows[table] = {"rows": checked.rows, "hash": checked.hash}
    manifest = json.dumps({"version": FORMAT_VERSION, "tables": rows})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{name}/manifest")
    return name


def load(spark: SparkSession, snapshot: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot; a newer format is refused before anything is read, a damaged table on check."""
    manifest = json.loads(spark.read.text(f"{snapshot}/manifest").first().value)
    if manifest["version"] > FORMAT_VERSION:
        raise ValueError(f"snapshot format {manifest['version']} is newer than {FORMAT_VERSION}")
    out = {}
    for table, want in manifest["tables"].items():
        df = out[table] = spark.read.parquet(f"{snapshot}/{table}")
        if check:
            got = df.select(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(c) for c in sorted(df.columns)])), F.lit(0)).alias("hash")).first()
            if (got.rows, got.hash) != (want["rows"], want["hash"]):
                raise ValueError(f"table {table} is damaged")
    return out


def content_hash(text: str) -> str:
    """FNV-1a, 64 bits, over UTF-8, in hexadecimal without padding."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:x}"


def _fnv(col: pa.Array) -> list[str]:
    """``content_hash`` of each text, all texts a byte at a time."""
    raw = [(t or "").encode() for t in col.to_pylist()]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, start = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[order]
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    longest = size[order]
    with np.errstate(over="ignore"):
        for i in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-longest, -i, "left"))  # texts longer than i
            h[:n] = (h[:n] ^ flat[start[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return [f"{x:x}" for x in out.tolist()]


def content_hashes(text) -> Column:
    """``content_hash`` as a column, in Arrow batches."""

    @F.arrow_udf("string")
    def hashed(col: pa.Array) -> pa.Array:
        return pa.array(_fnv(col))

    return hashed(text)


def read_one(spark: SparkSession, root: str, path: str) -> DataFrame:
    """One file of a tree as a row of ``read_project``'s shape; no row if it is too large or no regular file."""
    full = os.path.join(root, path)
    rows = []
    if os.path.isfile(full) and not os.path.islink(full) and os.stat(full).st_size <= MAX_BYTES:
        st = os.stat(full)
        try:
            with open(full, encoding="utf-8", newline="") as f:
                content = f.read()
        except (OSError, UnicodeDecodeError):
            content = None
        rows.append((path, content, st.st_size, st.st_mtime_ns // 1_000_000, content is not None))
    return spark.createDataFrame(rows, SCHEMA)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a line that does not fit it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
