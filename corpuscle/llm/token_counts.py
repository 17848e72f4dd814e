"""Token counts: a Viterbi pass over a unigram vocabulary that carries only best score and piece count.

Text is split at Unicode white space, each word gets the mark U+2581 in front, and a word's pieces are those of the best
sum of scores. An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at each character; the pass keeps
for each place the best score, the count up to there and whether it ends in an unknown character. Ties are the tokenizers
library's: of paths with the same (64-bit) score to a place, the one whose last piece starts first stays; a character
without a one-character piece may also be unknown, at the least score of the vocabulary minus 10; unknown characters in a
row are one token, or with byte fallback one for each of their bytes, if all those have byte pieces.

Null and empty texts have no tokens. A null doc_id and repeated rows are rows as any other. A very long text is counted word by
word, whole. Columns beside doc_id and text are not looked at, whatever their names. A table without rows gives none.
"""

from __future__ import annotations

import re
import struct
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, id_and_text
from .bpe import text_lots, tokenizer_path

MODEL, MARK, PENALTY, MEMO_WORDS = "piece_bpe_32k.model", "▁", 10.0, 600_000
#: runs without Unicode white space
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")

_MARKED = re.compile(f"{MARK}[^{MARK}]*")


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        v = shift = 0
        while True:
            b = raw[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores, in id order, of a sentencepiece model file."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    return out


class Counter:
    """Counts tokens of words under a unigram vocabulary; unknown: the id of its unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.pieces = ahocorasick.Automaton()
        self.single = set()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.pieces.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        names = {p for p, _ in vocabulary}
        self.byte = {b for b in range(256) if f"<0x{b:02X}>" in names} if byte_fallback else set()
        self.fallback = byte_fallback
        self.memo: dict[str, int] = {}

    def _run(self, chars: str) -> int:
        """Tokens of a run of unknown characters."""
        raw = chars.encode()
        return len(raw) if self.fallback and self.byte.issuperset(raw) else 1

    def count(self, word: str) -> int:
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for e, match in self.pieces.iter(word):
            ends[e].append(match)  # longest first
        score, count, since = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        unknown, single = self.unknown, self.single
        for e in range(n):
            best, of, run = None, 0, -1
            for size, s in ends[e]:
                c = s + score[e + 1 - size]
                if best is None or c > best:
                    best, of = c, e + 1 - size
            if word[e] not in single:
                c = unknown + score[e]
                if best is None or c > best:
                    best, run = c, since[e] if since[e] >= 0 else e
            score[e + 1] = best
            if run < 0:
                count[e + 1] = count[of] + 1
            else:
                since[e + 1] = run
                count[e + 1] = count[run] + self._run(word[run : e + 1])
        return count[n]

    def word(self, word: str) -> int:
        """Tokens of a word; a mark within it starts a new one."""
        if MARK not in word:
            return self.count(MARK + word)
        return sum(map(self.count, _MARKED.findall(word if word[0] == MARK else MARK + word)))

    def texts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        lots = [_WORD.findall(t) for t in texts]
        memo = self.memo
        need = set(chain.from_iterable(lots)).difference(memo)
        if len(memo) + len(need) > MEMO_WORDS:
            memo.clear()
            need = set(chain.from_iterable(lots))
        for w in need:
            memo[w] = self.word(w)
        return [len(x) for x in lots], [sum(map(memo.__getitem__, x)) for x in lots]


_KEPT: dict[tuple, Counter] = {}


def count_tokens(spark: SparkSession, df: DataFrame, path: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words and n_tokens of every text."""
    path = path or tokenizer_path(MODEL)

    def run(it):
        if (path, byte_fallback) not in _KEPT:
            _KEPT[path, byte_fallback] = Counter(read_vocabulary(path), byte_fallback)
        counter = _KEPT[path, byte_fallback]
        for batch in it:
            for i, j, b, off in text_lots(batch):
                raw, at = b.tobytes(), off.tolist()
                words, tokens = counter.texts([raw[x:y].decode() for x, y in zip(at, at[1:])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return id_and_text(df).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op4_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, documents(spark, sf_dir))
