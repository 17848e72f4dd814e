"""Harmonic packing of token ids into sequences.

A class j holds pieces that go j times into the capacity: lengths over capacity/(j + 1) and up to capacity/j. A class's bins
take exactly j pieces each, and each task fills its own bins, so workers need nothing from one another. Documents are cut at
class sizes capacity/j whose bins waste at most ``WASTE`` ids (largest first), and a rest under ``REST`` ids goes into its
class whole. What stays in unfinished bins when a task ends is laid end to end and cut at the capacity; the last of that
is cut into powers of two, so it needs no padding. A sequence is padded to the capacity unless its length is a power of two.

Null and empty texts are documents of the end id alone. Repeated rows and rows without doc_id are packed each for itself. A
very long text is cut as any other; its ids are held by one task. Columns beside doc_id and text are not looked at, whatever
their names. A table without rows gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, id_and_text, lean
from .bpe import WORD_BPE, Encoder, text_lots, tokenizer_path

CAPACITY, REST, WASTE, END_ID = 2048, 64, 4, 1
#: a task numbers its own sequences from its partition's number times this
SEQUENCES_A_TASK = 1 << 40

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_OUT = ", ".join(f"{n} long" for n in _NAMES)


class Packer:
    """The bins of one task. ``rows`` gets (doc, start, ids, doc_tokens, sequence, offset) of each placed piece."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, rest: int = REST, waste: int = WASTE):
        self.capacity, self.rest = capacity, rest
        self.sizes = [capacity // j for j in range(1, capacity // rest + 1) if capacity % j <= waste]
        self.sequence, self.open, self.rows = first_sequence, {}, []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.sequence, at))
            at += len(ids) // 4
        self.sequence += 1

    def _place(self, piece: tuple) -> None:
        j = self.capacity // (len(piece[2]) // 4)
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if len(bin_) == j:
            self._emit(bin_)
            self.open[j] = []

    def add(self, doc, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers, one at least."""
        total = left = len(ids) // 4
        at = 0
        while left >= self.rest:
            size = next((s for s in self.sizes if s <= left), left)
            for _ in range(left // size if size == self.capacity else 1):
                self._place((doc, at, ids[4 * at : 4 * (at + size)], total))
                at += size
                left -= size
        if left:
            self._place((doc, at, ids[4 * at :], total))

    def close(self) -> None:
        """Place what unfinished bins hold."""
        pieces = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in pieces)
        queue = pieces[::-1]
        while left:
            room = want = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            bin_ = []
            while room:
                doc, start, ids, total = queue.pop()
                n = min(room, len(ids) // 4)
                bin_.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    queue.append((doc, start + n, ids[4 * n :], total))
                room -= n
            self._emit(bin_)
            left -= want


def pack_documents(spark: SparkSession, df: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: its document, place and length there, and its sequence and place there."""
    path = path or tokenizer_path(WORD_BPE)
    end = np.array([END_ID], "<u4").tobytes()

    def run(it):
        packer, enc = Packer(TaskContext.get().partitionId() * SEQUENCES_A_TASK, capacity), Encoder.of(path)

        def placed():
            rows, packer.rows = packer.rows, []
            if rows:
                doc, start, ids, total, sequence, offset = zip(*rows)
                columns = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, sequence, offset]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

        for batch in it:
            names = batch.column("doc_id").to_pylist()
            for i, j, b, off in text_lots(batch):
                ids, at = enc.lot(b, off)
                raw, at = ids.tobytes(), (4 * at).tolist()
                for doc, x, y in zip(names[i:j], at, at[1:]):
                    packer.add(doc, raw[x:y] + end)
                yield from placed()
        packer.close()
        yield from placed()

    return id_and_text(df).mapInArrow(lean(run), _OUT)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))
