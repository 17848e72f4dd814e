"""Token ids in seekable Zstandard files.

A file is a run of independent zstd frames of about ``FRAME_BYTES`` raw bytes, a skippable frame with the first doc_id of each
frame, and a trailing seek table in the layout of zstd's seekable format (a skippable frame with the compressed size, raw
size and XXH64 checksum of each frame, and a footer). A frame holds whole documents: their number, doc_ids, id counts, flags
and ids. A reader finds a document's frame from the tables at the end and decompresses only that one, checking its checksum.

Files are in doc_id order, ties by the start of the text and then its hash, one file for each range of these and the row, written
under a task's own name and renamed when whole: a task that runs again replaces its file, one that fails takes its own away. A document's flag says whether
its doc_id is null, so each 64-bit doc_id can be told from a null one, which comes before all others.

Null and empty texts are documents of the end id alone. Repeated rows are documents each, one after another, and a doc_id that
very many rows have spans several files. A very long text is one document in a frame of its own. Columns beside doc_id and
text are not looked at, whatever their names. A table without rows gives files without frames.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_and_text, lean, numbered, parallelism, unused, work_dir
from .bpe import BYTE_BPE, Encoder, text_lots, tokenizer_path

FRAME_BYTES, LEVEL, END_ID = 1 << 20, 3, 0
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(2**63)


class Writer:
    """Writes documents' ids, in doc_id order, to a binary file object."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.most, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.docs: list[tuple[int, bytes, bool]] = []
        self.size, self.table, self.firsts = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, ids, doc_id is None))
        self.size += len(ids) + 13
        if self.size >= self.most:
            self._frame()

    def _frame(self) -> None:
        ids = np.array([d for d, *_ in self.docs], "<i8")
        sizes = np.array([len(x) // 4 for _, x, _ in self.docs], "<u4")
        null = bytes(n for *_, n in self.docs)
        raw = struct.pack("<I", len(self.docs)) + ids.tobytes() + sizes.tobytes() + null + b"".join(x for _, x, _ in self.docs)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.firsts.append(int(ids[0]))
        self.docs, self.size = [], 0

    def close(self) -> None:
        if self.docs:
            self._frame()
        index = np.array(self.firsts, "<i8").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.table.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(struct.pack("<III", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


class Reader:
    """Random access to a file that ``Writer`` made; f: a seekable binary file of ``size`` bytes."""

    def __init__(self, f, size: int):
        self.f = f
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        raw = self._at(size - 9 - 12 * n, 12 * n)
        self.table = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.places = np.concatenate(([0], np.cumsum([t[0] for t in self.table]))).astype(np.int64)
        index = self._at(int(self.places[n - 1]) + 8, self.table[-1][0] - 8)
        self.firsts = np.frombuffer(index, "<i8")

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return self.f.read(n)

    def __len__(self) -> int:
        return len(self.firsts)

    def frame(self, i: int) -> list[tuple[int | None, bytes]]:
        """The (doc_id, ids) of one frame."""
        packed, size, check = self.table[i]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[i]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        (n,) = struct.unpack_from("<I", raw)
        ids, sizes = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n)
        null = raw[4 + 12 * n : 4 + 13 * n]
        ends = 4 + 13 * n + 4 * np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return [(None if no else d, raw[a:b]) for d, no, a, b in zip(ids.tolist(), null, ends[:-1].tolist(), ends[1:].tolist())]

    def find(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document of this doc_id; only frames that can hold it are decompressed."""
        key = NO_ID if doc_id is None else doc_id
        a, b = np.searchsorted(self.firsts, key, "left"), np.searchsorted(self.firsts, key, "right")
        return [ids for i in range(max(0, int(a) - 1), int(b)) for d, ids in self.frame(i) if d == doc_id]


def write_ids(spark: SparkSession, df: DataFrame, folder: str, path: str | None = None, frame_bytes: int = FRAME_BYTES) -> list[tuple]:
    """Encode all texts and write them in doc_id order; (part, file, documents, ids) of each file, in order."""
    path = path or tokenizer_path(BYTE_BPE)
    end = np.array([END_ID], "<u4").tobytes()
    n = parallelism(spark, df)

    def run(it):
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final, own = f"{root}/part-{part:06d}.zst", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        enc, docs, total = Encoder.of(path), 0, 0
        try:
            with store.open_output_stream(own) as out:
                w = Writer(out, frame_bytes)
                for batch in it:
                    names = batch.column("doc_id").to_pylist()
                    for i, j, b, off in text_lots(batch):
                        ids, at = enc.lot(b, off)
                        raw, ends = ids.tobytes(), (4 * at).tolist()
                        for doc, x, y in zip(names[i:j], ends, ends[1:]):
                            w.add(doc, raw[x:y] + end)
                        docs += j - i
                        total += len(ids) + j - i
                w.close()
        except BaseException:
            if store.get_file_info(own).type != fs.FileType.NotFound:
                store.delete_file(own)
            raise
        if store.get_file_info(final).type != fs.FileType.NotFound:
            store.delete_file(final)
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, final, docs, total)], names=["part", "file", "docs", "ids"])

    (row,) = unused(df, 1)
    order = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16), F.xxhash64("text"), F.col(row)
    dealt = id_and_text(numbered(spark, df, row), row).repartitionByRange(n, *order).sortWithinPartitions(*order).drop(row)
    return sorted(tuple(r) for r in dealt.mapInArrow(lean(run), "part long, file string, docs long, ids long").collect())


def read_ids(spark: SparkSession, folder: str, parts: list[tuple]) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    rows, before = [], 0
    for part, file, docs, ids in parts:
        if docs:
            rows.append((part, file, before))
        before += ids
    files = spark.createDataFrame(rows, "part long, file string, before long")

    def run(it):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in it:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                size = store.get_file_info(file).size
                with store.open_input_file(file) as f:
                    r = Reader(f, size)
                    for i in range(len(r)):
                        found = r.frame(i)
                        sizes = np.array([len(x) // 4 for _, x in found], np.int64)
                        starts = start + np.concatenate(([0], np.cumsum(sizes)))
                        start = int(starts[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in found], pa.int64()), pa.array(starts[:-1]), pa.array(sizes), pa.array([zlib.crc32(x) for _, x in found], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return files.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "ids")
    return read_ids(spark, folder, write_ids(spark, documents(spark, sf_dir), folder))
