"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled, with their token ids as output, into one minimal deterministic automaton (shared
prefixes and suffixes; outputs along the arcs add up to a word's number, which addresses its ids). Its arrays are one flat
file, which each executor fetches once and all its workers map. A lot's distinct words walk it together; words that it does
not hold are merged exactly, many at a time, by rank. So the lexicon changes speed only, never ids.

Texts are cut into words in numpy, on the UTF-8 bytes of a whole lot: each character has a class (letter, number, white
space, other) that is read off the tokenizers library itself, so it is that of the library's Unicode version, and the file's
pattern becomes a rule on where classes change. A lot's words are dictionary-coded by Arrow and their ids gathered in one
step. Texts that hold something like a special token, and for the lower-casing file texts with characters that the
library's normalizer may change otherwise than one by one, are encoded by the library.

Which words are frequent is counted over all documents with bounded summaries: each task keeps its ``LOCAL_WORDS`` most
frequent words, the sums' first ``LEXICON_WORDS`` at most are compiled.

Null and empty texts have no ids and decode to nothing. A null doc_id and repeated rows are rows as any other; each gets a
row of its own. A very long text is one lot of its own, whole. Other columns never reach the operators.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _bytes_pow as byte_powers
from ._common import documents, id_and_text, lean, mix, most_frequent, ragged, slices, text_buffer, work_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
LEXICON_WORDS, LOCAL_WORDS, MEMO_WORDS, LONG_WORD = 100_000, 60_000, 500_000, 64
#: bytes of text that are encoded together; a longer single text is a lot of its own
LOT_BYTES = 2 << 20

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)
_ONE, _TWO = np.zeros(256, bool), np.zeros((256, 256), bool)
_ONE[list(b"stmd")] = True
for _a, _b in (b"re", b"ve", b"ll"):
    _TWO[_a, _b] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- words ----------------------------------------------------------------------------------------------------------


class Characters:
    """Classes of characters as the library's regular expressions see them, found out a block at a time."""

    BLOCK = 4096

    def __init__(self):
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.table[0xD800:0xE000] = OTHER  # no characters
        self.ask(np.arange(0x800))

    def ask(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point."""
        found = self.table[points]
        if (found == UNKNOWN).any():
            from tokenizers import Regex, pre_tokenizers

            for k in np.unique(points[found == UNKNOWN] // self.BLOCK).tolist():
                block = np.arange(k * self.BLOCK, (k + 1) * self.BLOCK)
                block = block[self.table[block] == UNKNOWN]
                chars = "".join(map(chr, block.tolist()))
                self.table[block] = OTHER
                for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
                    hit = np.ones(len(block), bool)
                    for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(chars):
                        hit[a:b] = False
                    self.table[block[hit]] = cls
            found = self.table[points]
        return found

    def of_bytes(self, b: np.ndarray, high: np.ndarray, size: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The class of each byte of UTF-8, that of its character; the rest: what ``wide_characters`` gives."""
        out = self.table[b]
        if len(high):
            cls = self.ask(point)
            out[high] = cls
            for k in (1, 2, 3):
                more = size > k
                out[high[more] + k] = cls[more]
        return out


class Lowered:
    """What the lower-casing file's normalizer makes of a character, where that depends on nothing else.

    ``ODD`` are characters that may be changed otherwise: those that canonical composition may join to another one, those
    that become several or one of another length in UTF-8, and those of which Python's tables know nothing.
    """

    ODD, ASK = -1, -2

    def __init__(self, normalize, characters: Characters):
        self.normalize, self.characters = normalize, characters
        self.table = np.full(0x110000, self.ASK, np.int32)
        self.joined = {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
        for p in range(0x110000):
            if (d := unicodedata.decomposition(chr(p))) and d[0] != "<" and " " in d:
                self.joined.add(chr(int(d.split()[1], 16)))

    def _one(self, p: int) -> int:
        c = chr(p)
        if unicodedata.category(c) in ("Cn", "Cs") or unicodedata.combining(c) or c in self.joined:
            return self.ODD
        low = self.normalize(c)
        return ord(low) if len(low) == 1 and len(low.encode()) == len(c.encode()) else self.ODD

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == self.ASK).any():
            new = np.unique(points[found == self.ASK])
            blank = self.characters.ask(new) == BLANK  # no word has it
            self.table[new] = [p if w else self._one(p) for p, w in zip(new.tolist(), blank.tolist())]
            found = self.table[points]
        return found


def wide_characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and code point of the characters of UTF-8 that have several bytes."""
    high = np.flatnonzero(b >= 0xC0)
    if not len(high):
        return high, high, high
    lead = b[high].astype(np.int64)
    x, y, z = (b[np.minimum(high + k, len(b) - 1)].astype(np.int64) & 63 for k in (1, 2, 3))
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    return high, size, np.where(size == 2, (lead & 31) << 6 | x, np.where(size == 3, (lead & 15) << 12 | x << 6 | y, (lead & 7) << 18 | x << 12 | y << 6 | z))


def put_wide(b: np.ndarray, high: np.ndarray, size: np.ndarray, point: np.ndarray) -> None:
    """Write characters over others of the same length."""
    for k, mark in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        own = size == k
        h, p = high[own], point[own]
        b[h] = mark | p >> 6 * (k - 1)
        for i in range(1, k):
            b[h + i] = 0x80 | p >> 6 * (k - 1 - i) & 63


def word_starts(b: np.ndarray, off: np.ndarray, cls: np.ndarray, words: bool) -> np.ndarray:
    """Where the pretokens of UTF-8 texts start, which follow one another without a gap.

    words: the pattern of the lower-casing file, where white space is a pretoken (without ids) and each number stands alone.
    Otherwise the byte-level one, where a pretoken takes one blank before it, and a run of white space before anything else
    gives up its last character.
    """
    n = len(b)
    start = np.zeros(n + 3, bool)
    start[1:n] = cls[1:] != cls[:-1]
    inner = off[:-1][off[:-1] < n]
    start[inner] = True
    if words:
        start[:n] |= (cls == NUMBER) & ((b & 0xC0) != 0x80)
    else:
        first = np.zeros(n + 1, bool)
        first[off] = True
        ends = np.flatnonzero((cls[1:] != BLANK) & (cls[:-1] == BLANK) & ~first[1:n]) + 1
        blank = b[ends - 1] == 0x20
        start[ends[blank] - 1] = True
        start[ends[blank]] = False
        last = ends[~blank] - 1
        for _ in range(3):
            last -= (b[last] & 0xC0) == 0x80
        start[last] = True
    # 's 't 're 've 'm 'll 'd, where an apostrophe starts a pretoken
    mark = np.flatnonzero((b == 0x27) & start[:n])
    if len(mark):
        end = off[np.searchsorted(off, mark, "right")]
        wide = np.concatenate((b, np.zeros(3, np.uint8)))
        one = _ONE[wide[mark + 1]] & (mark + 1 < end)
        two = _TWO[wide[mark + 1], wide[mark + 2]] & (mark + 2 < end)
        start[mark[one | two] + 1] = False
        start[mark[one] + 2] = True
        start[mark[two] + 3] = True
    return np.flatnonzero(start[:n])


# --- merges ---------------------------------------------------------------------------------------------------------


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """The place of a key among some distinct keys, by two hash tables and a sorted rest."""

    def __init__(self, keys: np.ndarray, none: int):
        self.none, self.tables = none, []
        left = np.arange(len(keys))
        for bits, factor in ((18, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F)):
            slot = self._slot(keys[left], bits, factor)
            _, first = np.unique(slot, return_index=True)
            key, place = np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int32)
            key[slot[first]], place[slot[first]] = keys[left[first]], left[first]
            self.tables.append((bits, factor, key, place))
            left = np.delete(left, first)
        order = np.argsort(keys[left])
        self.keys, self.places = keys[left][order], left[order].astype(np.int32)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        (bits, factor, key, place), (bits2, factor2, key2, place2) = self.tables
        slot = self._slot(keys, bits, factor)
        out = np.where(key[slot] == keys, place[slot], self.none)
        slot = self._slot(keys, bits2, factor2)
        out = np.where(key2[slot] == keys, place2[slot], out)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.places[at], out)
        return out


class Merger:
    """Exact BPE merges of pretokens (bytes) for a tokenizer file, many words at a time."""

    NONE = 1 << 30

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        sym = byte_symbols()
        self.size = max(max(self.vocab.values()), max(self.special.values(), default=0)) + 1
        self.first = np.array([self.vocab[sym[b]] for b in range(256)], np.int32)
        self.last = np.array([self.vocab[sym[b] + self.suffix] for b in range(256)], np.int32)
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank = {(a, b): (i, c) for i, (a, b, c) in enumerate(pairs)}
        self.lookup = PairTable(np.array([a * self.size + b for a, b, _ in pairs], np.int64), self.NONE)
        self.merged = np.array([c for *_, c in pairs], np.int32)
        back = {c: b for b, c in sym.items()}
        #: the bytes of each id
        self.bytes = [b""] * self.size
        for s, i in self.vocab.items():
            if self.suffix and s.endswith(self.suffix):
                s = s[: -len(self.suffix)]
            self.bytes[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.lookup(a.astype(np.int64) * self.size + b)

    def _together(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; each round makes one merge in every word that has one.

        A pair's key is its rank and then its place, so a word's least key is the pair that is merged next.
        """
        n = len(off) - 1
        sym = self.first[flat]
        sym[off[1:] - 1] = self.last[flat[off[1:] - 1]]
        place = np.arange(len(flat))
        rank = np.full(len(flat), self.NONE, np.int64)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[off[1:] - 1] = self.NONE
        key, size, word = rank << 32 | place, np.diff(off), np.arange(n)
        done, whose = [], []
        while len(word):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(key, start)
            over = best >> 32 >= self.NONE
            keep = np.ones(len(sym), bool)
            if over.any():
                keep = ~np.repeat(over, size)
                done.append(sym[~keep])
                whose.append(np.repeat(word[over], size[over]))
                sym, key = sym[keep], key[keep]
                word, size, best = word[~over], size[~over], best[~over]
                if not len(word):
                    break
                start = np.cumsum(size) - size
                keep = np.ones(len(sym), bool)
            at = np.flatnonzero(key == np.repeat(best, size))
            sym[at] = self.merged[best >> 32]
            keep[at + 1] = False
            # pairs with the symbols before and after
            end = start + size
            has = at + 2 < end
            low = np.full(len(at), self.NONE, np.int64)
            low[has] = self._ranks(sym[at[has]], sym[at[has] + 2])
            key[at] = low << 32 | key[at] & 0xFFFFFFFF
            left = at > start
            b = at[left] - 1
            key[b] = self._ranks(sym[b], sym[b + 1]).astype(np.int64) << 32 | key[b] & 0xFFFFFFFF
            sym, key, size = sym[keep], key[keep], size - 1
        whose = np.concatenate(whose) if whose else np.zeros(0, np.int64)
        ids = np.concatenate(done) if done else np.zeros(0, np.int32)
        return ids[np.argsort(whose, kind="stable")].astype("<u4"), np.bincount(whose, minlength=n)

    def _long(self, word: bytes) -> np.ndarray:
        """A long word, with a heap of its pairs by rank and place."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, c, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if r := self.rank.get((c, ids[k])):
                    heapq.heappush(heap, (*r, i, c, ids[k]))
            if (p := prv[i]) >= 0 and (r := self.rank.get((ids[p], c))):
                heapq.heappush(heap, (*r, p, ids[p], c))
        return np.array([x for x in ids if x >= 0], "<u4")

    def merge(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32 bits) of words given by place and length in ``flat``, in a row, and how many each has."""
        long = np.flatnonzero(size > LONG_WORD)
        short = np.flatnonzero(size <= LONG_WORD)
        parts, counts = [], np.zeros(len(size), np.int64)
        for k in range(0, len(short), 1 << 16):
            own = short[k : k + (1 << 16)]
            ids, n = self._together(flat[ragged(start[own], size[own])], np.concatenate(([0], np.cumsum(size[own]))))
            parts.append(ids)
            counts[own] = n
        if not len(long):
            return np.concatenate(parts) if parts else np.zeros(0, "<u4"), counts
        whole = [self._long(flat[start[i] : start[i] + size[i]].tobytes()) for i in long.tolist()]
        counts[long] = [len(x) for x in whole]
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        if parts:
            out[ragged(begin[short], counts[short])] = np.concatenate(parts)
        out[ragged(begin[long], counts[long])] = np.concatenate(whole)
        return out, counts


class Memo:
    """Ids of words seen: an open hash table over flat arrays, where a word's bytes decide and not its hash."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits, self.n = 16, 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hash = np.zeros(1 << 15, np.uint64)
        self.at = {k: np.zeros((1 << 15) + 1, np.int64) for k in ("word", "ids")}
        self.data = {"word": np.zeros(1 << 18, np.uint8), "ids": np.zeros(1 << 17, "<u4")}

    def _probe(self, h: np.ndarray):
        """(which, slot) of hashes, step by step; those that the receiver sends back go on to the next slot."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        which = np.arange(len(h))
        while len(which):
            on = yield which, slot
            which, slot = which[on], slot[on] + 1 & (1 << self.bits) - 1

    def find(self, h: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        probe = self._probe(h)
        step = next(probe, None)
        while step is not None:
            which, slot = step
            entry = self.slots[slot].astype(np.int64)
            there = entry >= 0
            same = there & (self.hash[entry] == h[which])
            out[which[same]] = entry[same]
            try:
                step = probe.send(there & ~same)
            except StopIteration:
                step = None
        hit = np.flatnonzero(out >= 0)
        at = self.at["word"]
        begin, length = at[out[hit]], at[out[hit] + 1] - at[out[hit]]
        ok = length == size[hit]
        hit_ok, out[hit[~ok]] = hit[ok], -1
        n = size[hit_ok]
        if len(n):
            differ = flat[ragged(start[hit_ok], n)] != self.data["word"][ragged(begin[ok], n)]
            if differ.any():
                out[hit_ok[np.add.reduceat(differ, np.cumsum(n) - n) > 0]] = -1
        return out

    def _append(self, kind: str, values: np.ndarray, sizes: np.ndarray) -> None:
        at, n = self.at[kind], self.n
        used = int(at[n])
        while len(self.data[kind]) < used + len(values):
            self.data[kind] = np.concatenate((self.data[kind], np.zeros_like(self.data[kind])))
        self.data[kind][used : used + len(values)] = values
        at[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)

    def add(self, h: np.ndarray, words: np.ndarray, word_sizes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        """New words; hashes that are there already are left out by ``find``'s check of their bytes."""
        n, k = self.n, len(h)
        while len(self.hash) < n + k:
            self.hash = np.concatenate((self.hash, np.zeros_like(self.hash)))
            for name in self.at:
                self.at[name] = np.concatenate((self.at[name], np.zeros(len(self.at[name]) - 1, np.int64)))
        self.hash[n : n + k] = h
        self._append("word", words, word_sizes)
        self._append("ids", ids, id_sizes)
        self.n = n + k
        grown = False
        while 2 * self.n > 1 << self.bits:
            self.bits, grown = self.bits + 1, True
        first = 0 if grown else n
        if grown:
            self.slots = np.full(1 << self.bits, -1, np.int32)
        entry = np.arange(first, self.n, dtype=np.int32)
        probe = self._probe(self.hash[first : self.n])
        step = next(probe, None)
        while step is not None:
            which, slot = step
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[which[free]]
            try:
                step = probe.send(self.slots[slot] != entry[which])
            except StopIteration:
                step = None


# --- the transducer -------------------------------------------------------------------------------------------------


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to id lists, in flat arrays."""

    PARTS = (("keys", np.int64), ("target", np.int32), ("out", np.int32), ("final", np.int8), ("ids_at", np.int64), ("ids", np.uint32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, bytes]) -> Lexicon:
        """words: the ids of each, as little-endian unsigned 32-bit integers."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # (final, ((byte, target), ...))
        path: list[list] = [[False, []]]  # the states along the last word, not yet shared

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                sig = (final, tuple(arcs))
                if sig not in register:
                    register[sig] = len(states)
                    states.append(sig)
                parent = path[-1][1]
                parent[-1] = (parent[-1][0], register[sig])

        before = b""
        for w in order:
            k = len(os.path.commonprefix([before, w]))
            close(k)
            for c in w[k:]:
                path[-1][1].append((c, -1))
                path.append([False, []])
            path[-1][0] = True
            before = w
        close(0)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1])))
        # children come before their parents in states; the root becomes state 0
        number = np.array([*range(1, root + 1), 0])
        count = [0] * len(states)
        rows = []
        for s, (final, arcs) in enumerate(states):
            total = int(final)
            for c, t in arcs:
                rows.append((int(number[s]) * 256 + c, int(number[t]), total))
                total += count[t]
            count[s] = total
        rows.sort()
        final = np.zeros(len(states), np.int8)
        for s, (f, _) in enumerate(states):
            final[number[s]] = f
        sizes = np.array([len(words[w]) // 4 for w in order], np.int64)
        k, t, o = (np.array([r[i] for r in rows], d) for i, d in ((0, np.int64), (1, np.int32), (2, np.int32)))
        return cls({"keys": k, "target": t, "out": o, "final": final, "ids_at": np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), "ids": np.frombuffer(b"".join(words[w] for w in order), "<u4")})

    def to_bytes(self) -> bytes:
        sizes = np.array([len(getattr(self, n)) for n, _ in self.PARTS], np.int64)
        return sizes.tobytes() + b"".join(np.ascontiguousarray(getattr(self, n).astype(d)).tobytes().ljust(-(-len(getattr(self, n)) * np.dtype(d).itemsize // 8) * 8, b"\0") for n, d in self.PARTS)

    @classmethod
    def mapped(cls, file: str) -> Lexicon:
        """The arrays of a file, mapped: workers of one machine share its pages."""
        data = np.memmap(file, np.uint8, "r")
        at, arrays = 8 * len(cls.PARTS), {}
        for n, (name, d) in zip(data[:at].view(np.int64), cls.PARTS):
            size = int(n) * np.dtype(d).itemsize
            arrays[name] = data[at : at + size].view(d)
            at += -(-size // 8) * 8
        return cls(arrays)

    def find(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the lexicon does not have it; all words step through the arcs together."""
        n = len(start)
        found = np.full(n, -1, np.int64)
        if not len(self.keys) or not n:
            return found
        live, state, total, p = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            end = size[live] == p
            if end.any():
                done = live[end]
                found[done] = np.where(self.final[state[end]] > 0, total[end], -1)
                live, state, total = live[~end], state[~end], total[~end]
                if not len(live):
                    break
            key = state * 256 + flat[start[live] + p]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, total = self.target[at].astype(np.int64), total[ok] + self.out[at]
            p += 1
        return found

    def outputs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, in a row, and how many each has."""
        size = self.ids_at[i + 1] - self.ids_at[i]
        return self.ids[ragged(self.ids_at[i], size)], size


# --- whole texts ----------------------------------------------------------------------------------------------------

_KEPT: dict[tuple, Encoder] = {}


class Encoder:
    """Whole texts to ids: words, a bounded memo, the lexicon, then merges. lexicon: the file of a compiled one."""

    def __init__(self, path: str, lexicon: str | None = None):
        from tokenizers import Tokenizer

        self.merger, self.lexicon = Merger(path), Lexicon.mapped(lexicon) if lexicon else None
        self.memo = Memo(MEMO_WORDS)
        self.words = bool(self.merger.suffix)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.characters = Characters()
        if self.words:
            self.lowered = Lowered(self.library.normalizer.normalize_str, self.characters)
            self.ascii = np.array([*range(65), *range(97, 123), *range(91, 256)], np.uint8)
        #: special tokens all begin so
        self.mark = os.path.commonprefix(list(self.merger.special)).encode()
        self.pieces = pa.array(self.merger.bytes, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(self.merger.size)], pa.large_binary())

    @classmethod
    def of(cls, path: str, lexicon: str | None = None) -> Encoder:
        """This worker's encoder, kept between its tasks."""
        if (path, lexicon) not in _KEPT:
            _KEPT.clear()
            _KEPT[path, lexicon] = cls(path, lexicon)
        return _KEPT[path, lexicon]

    def learn(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given by place and length in ``flat``, in a row, and how many each has."""
        rest = np.arange(len(start))
        if self.words:  # white space has no ids
            rest = np.flatnonzero(self.characters.of_bytes(flat, *wide_characters(flat))[start] != BLANK)
        parts = []
        if self.lexicon is not None:
            at = self.lexicon.find(flat, start[rest], size[rest])
            parts.append((rest[at >= 0], *self.lexicon.outputs(at[at >= 0])))
            rest = rest[at < 0]
        parts.append((rest, *self.merger.merge(flat, start[rest], size[rest])))
        counts = np.zeros(len(start), np.int64)
        for which, _, n in parts:
            counts[which] = n
        begin, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), "<u4")
        for which, ids, n in parts:
            out[ragged(begin[which], n)] = ids
        return out, counts

    def ids_of(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of different words, as bytes."""
        flat, off = flat_bytes(words)
        start, size = off[:-1], np.diff(off)
        up, down = byte_powers(len(flat) + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=c[1:])
            h = mix((c[off[1:]] - c[start]) * down[start] + size.astype(np.uint64))
        if self.memo.n + len(size) > self.memo.most:
            self.memo.clear()
        entry = self.memo.find(h, flat, start, size)
        new = np.flatnonzero(entry < 0)
        counts = np.zeros(len(size), np.int64)
        old = np.flatnonzero(entry >= 0)
        at = self.memo.at["ids"]
        begin_old = at[entry[old]]
        counts[old] = at[entry[old] + 1] - begin_old
        ids, n = self.learn(flat, start[new], size[new])
        counts[new] = n
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        out[ragged(begin[old], counts[old])] = self.memo.data["ids"][ragged(begin_old, counts[old])]
        out[ragged(begin[new], n)] = ids
        keep = size[new] <= LONG_WORD
        if keep.any():
            own = new[keep]
            self.memo.add(h[own], flat[ragged(start[own], size[own])], size[own], ids[np.repeat(keep, n)], n[keep])
        ends = 4 * np.concatenate(([0], np.cumsum(counts)))
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])

    def coded(self, b: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The words of UTF-8 texts, the first of each text, and the texts that are the library's."""
        high, size, point = wide_characters(b)
        odd = np.zeros(0, np.int64)
        if self.words:
            b = self.ascii[b]
            if len(high):
                low = self.lowered(point)
                odd = high[low == Lowered.ODD]
                new = (low != point) & (low >= 0)
                point = np.where(new, low, point)
                put_wide(b, high[new], size[new], point[new])
        if self.mark and b.tobytes().find(self.mark) >= 0:
            odd = np.concatenate((odd, np.flatnonzero(np.all([b[k : len(b) - len(self.mark) + 1 + k] == c for k, c in enumerate(self.mark)], axis=0))))
        rows = np.unique(np.searchsorted(off, odd, "right") - 1)
        start = word_starts(b, off, self.characters.of_bytes(b, high, size, point), self.words)
        ends = np.concatenate((start, [len(b)])).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b))])
        return words.dictionary_encode(), np.searchsorted(start, off), rows

    def lot(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts one after another (unsigned 32 bits), and where each text's start; off[0] is 0."""
        if not len(b):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        coded, first, odd = self.coded(b, off)
        got = self.ids_of(coded.dictionary).take(coded.indices)
        ids, at = flat_bytes(got)
        ids, at = ids.view("<u4"), at[first] // 4
        if len(odd):
            parts, before = [], 0
            sizes = np.diff(at)
            for k in odd.tolist():
                own = np.array(self.library.encode(b[off[k] : off[k + 1]].tobytes().decode(), add_special_tokens=False).ids, "<u4")
                parts += [ids[at[before] : at[k]], own]
                sizes[k], before = len(own), k + 1
            ids = np.concatenate([*parts, ids[at[before] :]])
            at = np.concatenate(([0], np.cumsum(sizes)))
        return ids, at

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        ids, at = self.lot(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64))
        return [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of ids, in UTF-8, cut at ``at``; bytes that are no UTF-8 become U+FFFD."""
        raw, places = flat_bytes(self.pieces.take(pa.array(ids)))
        out = [raw[i:j].tobytes() for i, j in zip(places[at[:-1]].tolist(), places[at[1:]].tolist())]
        for k, x in enumerate(out):
            try:
                x.decode()
            except UnicodeDecodeError:
                out[k] = x.decode("utf-8", "replace").encode()
        return out

    def listed(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids in decimal, joined by commas, cut at ``at``."""
        raw, places = flat_bytes(self.decimals.take(pa.array(ids)))
        return [raw[i : max(i, j - 1)].tobytes() for i, j in zip(places[at[:-1]].tolist(), places[at[1:]].tolist())]


def flat_bytes(col: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and where each starts."""
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def listed_bytes(col: pa.LargeBinaryArray) -> list[bytes]:
    flat, off = flat_bytes(col)
    raw, at = flat.tobytes(), off.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def text_lots(batch: pa.RecordBatch, most: int = LOT_BYTES):
    """(first row, end row, bytes, offsets) of a batch's texts, about ``most`` bytes at a time."""
    buf, off = text_buffer(batch.column("text"))
    for i, j in slices(off, most):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def frequent_words(spark: SparkSession, df: DataFrame, path: str, most: int = LEXICON_WORDS, local: int = LOCAL_WORDS) -> dict[bytes, bytes]:
    """The most frequent pretokens of all texts with their ids; ``most`` bounds what the driver gets."""

    def count(it):
        enc, counts = Encoder.of(path), Counter()
        for batch in it:
            for _, _, b, off in text_lots(batch):
                if not len(b):
                    continue
                coded, _, _ = enc.coded(b, off)
                words, times = listed_bytes(coded.dictionary), np.bincount(coded.indices.to_numpy()).tolist()
                counts.update({w: n for w, n in zip(words, times) if len(w) <= 64})
                if len(counts) > 8 * local:
                    counts = Counter(dict(counts.most_common(4 * local)))
        top = counts.most_common(local)
        for k in range(0, len(top), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top[k : k + 10_000]], pa.binary()), pa.array([c for _, c in top[k : k + 10_000]], pa.int64())], names=["word", "n"])

    counted = df.select("text").mapInArrow(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r.word) for r in most_frequent(spark, counted, "n", most).select("word").collect()]
    flat, off = flat_bytes(pa.array(words, pa.large_binary()))
    ids, n = Encoder.of(path).learn(flat, off[:-1], np.diff(off))
    ends = np.cumsum(n)
    return {w: ids[e - k : e].tobytes() for w, e, k in zip(words, ends.tolist(), n.tolist())}


def lexicon(spark: SparkSession, df: DataFrame, path: str, **bounds) -> str:
    """Compile the transducer of a corpus's frequent words into a file that every executor fetches once; its name."""
    folder, name = work_dir(spark, "lexicon"), f"lexicon-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(Lexicon.compile(frequent_words(spark, df, path, **bounds)).to_bytes())
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def op_bpe_round_trip(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text; digests of its ids and of its decoded text."""
    path = path or tokenizer_path(BYTE_BPE)
    docs = id_and_text(df)
    name = lexicon(spark, docs, path)

    def run(it):
        enc = Encoder.of(path, SparkFiles.get(name))
        for batch in it:
            for i, j, b, off in text_lots(batch):
                ids, at = enc.lot(b, off)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in enc.listed(ids, at)]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in enc.decode(ids, at)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_bpe_round_trip(spark, documents(spark, sf_dir))
