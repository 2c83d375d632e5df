"""Byte-pair encoding and decoding, exactly as a tokenizer file defines it.

A text is cut into blank-separated chunks, which its pre-tokenizer treats independently, so each distinct chunk is
resolved once, and found again in a table that arrays of chunks are looked up in. Words come from a minimal acyclic transducer: an automaton with shared suffixes over the corpus's
frequent words, whose arc outputs add up to a word's number and so to its ids; it is laid out flat and memory-mapped.
Words that it lacks are merged exactly, all words of a batch at a time. Texts with characters beyond Latin letters are
cut by the tokenizer library's own pre-tokenizer, and then encoded here like the others.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, load, materialize, scratch

#: Words in the transducer, at most, and the longest of them in bytes.
LEXICON, LONGEST = 65_536, 48
#: Chunks remembered at a time by a task, documents encoded together, and chunks counted before they are sent on.
MEMO, TOGETHER, COUNTED = 250_000, 128, 200_000
#: Slots of a task's table of chunks, as a power of two (half of them are used), and chunks looked up together.
TABLE, WINDOW = 20, 1 << 17
#: Words of up to so many symbols are merged together in arrays; longer ones by a heap.
WIDE = 48
NONE = np.int64(1 << 60)
#: Characters whose class and lower case every Unicode version agrees on: others go through the library.
EXOTIC = re.compile(r"[^\t-\r -~¡-¬®-ɏ]")
DOUBLE = re.compile(r"\s\s")
# The pre-tokenizers' patterns, for those characters; NUL stands between chunks that are cut together.
BYTE_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_²³¹¼½¾]+| ?[0-9²³¹¼½¾]+| ?(?:[^\s\w\0]|_)+|\s+(?!\S)|\s+|\0")
LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\s\w\0]|_)+|\0")
#: Marks that are a word of their own at the end of letters.
MARKS = frozenset('!"#$%&()*+,-./:;<=>?@[\\]^`{|}~')


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """Pairs of ids with the rank and the id of what they become, in an open hash table that arrays are looked up in."""

    MIX, SLOTS = np.uint64(0x9E3779B97F4A7C15), 19

    def __init__(self, rows: list[tuple[int, int, int]]):
        """rows: left << 32 | right, rank, made."""
        self.key, self.rank, self.made = np.full(1 << self.SLOTS, -1, np.int64), np.full(1 << self.SLOTS, NONE), np.zeros(1 << self.SLOTS, np.int32)
        self.probes, left = 0, rows
        while left:  # each pass fills the free slots that are `probes` after the pairs' own
            k, r, m = (np.array(x, np.int64) for x in zip(*left, strict=True))
            slot = self._slot(k, self.probes)
            free = np.flatnonzero(self.key[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[first]], self.rank[slot[first]], self.made[slot[first]] = k[first], r[first], m[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left = [left[i] for i in np.flatnonzero(stay)]
            self.probes += 1
        self.table = {k: (r, m) for k, r, m in rows}

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return (((key.view(np.uint64) * self.MIX) >> np.uint64(64 - self.SLOTS)).astype(np.int64) + probe) & ((1 << self.SLOTS) - 1)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and id of each pair; an id of -1 makes no pair."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key, 0)
        hit = self.key[slot] == key
        rank, made = np.where(hit, self.rank[slot], NONE), self.made[slot]
        miss = np.flatnonzero(~hit & (left >= 0) & (right >= 0))
        for probe in range(1, self.probes):
            if not len(miss):
                break
            slot = self._slot(key[miss], probe)
            hit = self.key[slot] == key[miss]
            rank[miss[hit]], made[miss[hit]] = self.rank[slot[hit]], self.made[slot[hit]]
            miss = miss[~hit & (self.key[slot] >= 0)]
        return rank, made

    def one(self, ids: list[int]) -> list[int]:
        """Merges a long word: lowest rank first, leftmost among equals, in n log n."""
        get, n = self.table.get, len(ids)
        after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []
        for i in range(n - 1):
            if m := get(ids[i] << 32 | ids[i + 1]):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (m := get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def all(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges many words, given as symbols one after another and their numbers; the same form comes back.

        Each round applies every word's best pair, leftmost among equals. Symbols keep their places; `after` and
        `before` link those that remain.
        """
        begin = np.cumsum(size) - size
        kept = np.ones(len(flat), bool)
        flat = flat.astype(np.int32)
        for i in np.flatnonzero(size > WIDE):
            got = self.one(flat[begin[i] : begin[i] + size[i]].tolist())
            flat[begin[i] : begin[i] + len(got)] = got
            kept[begin[i] + len(got) : begin[i] + size[i]] = False
        order = np.argsort(size, kind="stable")
        order = order[(size[order] <= WIDE) & (size[order] > 1)]
        for i in range(0, len(order), 4096):
            rows = order[i : i + 4096]
            wide = int(size[rows[-1]])
            place = begin[rows][:, None] + np.arange(wide)
            inside = np.arange(wide) < size[rows][:, None]
            a = np.where(inside, flat[np.minimum(place, len(flat) - 1)], -1).astype(np.int32)
            self._round(a)
            flat[place[inside]] = a[inside]
            kept[place[inside]] = a[inside] >= 0
        out = np.add.reduceat(kept, begin[size > 0], dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
        sizes = np.zeros(len(size), np.int64)
        sizes[size > 0] = out
        return flat[kept], sizes

    def _round(self, a: np.ndarray) -> None:
        n, wide = a.shape
        rank, made = self.look(a[:, :-1].ravel(), a[:, 1:].ravel())
        rank, made = rank.reshape(n, wide - 1), made.reshape(n, wide - 1)
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (n, 1))
        live = np.arange(n)
        while len(live):
            part = rank[live]
            j = part.argmin(1)
            on = part[np.arange(len(live)), j] < NONE
            live, j = live[on], j[on]
            if not len(live):
                return
            gone = after[live, j]
            far = after[live, gone]
            a[live, j], a[live, gone] = made[live, j], -1
            after[live, j] = far
            links = far < wide
            before[live[links], far[links]] = j[links]
            last = gone < wide - 1
            rank[live[last], gone[last]] = NONE
            ends = ~links
            rank[live[ends], j[ends]] = NONE
            x, y, z = live[links], j[links], far[links]
            rank[x, y], made[x, y] = self.look(a[x, y], a[x, z])
            prior = before[live, j]
            has = prior >= 0
            x, y, z = live[has], prior[has], j[has]
            rank[x, y], made[x, y] = self.look(a[x, y], a[x, z])


@dataclass
class Vocabulary:
    """What a tokenizer file says, in arrays; `file` is its text, for the library where it is needed."""

    file: str
    merges: Merges
    first: np.ndarray  # id of each byte
    last: np.ndarray  # id of each byte at a word's end
    tokens: list[bytes]  # bytes of each id
    added: dict[str, int]
    lower: bool  # words are lower-cased and white space is dropped

    @staticmethod
    def read(path: str) -> Vocabulary:
        text = open(path, encoding="utf-8").read()
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        rows = [(ids[a] << 32 | ids[b], i, ids[a + b]) for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        value = {c: i for i, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for t, i in ids.items():
            end = bool(suffix) and t.endswith(suffix)
            tokens[i] = bytes(value[c] for c in (t[: -len(suffix)] if end else t)) + b" " * end
        for t, i in added.items():
            tokens[i] = t.encode()
        return Vocabulary(text, Merges(rows), np.array([ids[c] for c in letters]), np.array([ids[c + suffix] for c in letters]), tokens, added, bool(suffix))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, none of them empty, as little-endian 32-bit integers."""
        if not words:
            return []
        text, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        ids, end = self.first[text], np.cumsum(size) - 1
        ids[end] = self.last[text[end]]
        merged, sizes = self.merges.all(ids, size)
        whole, to = merged.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [whole[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]


class Transducer:
    """A minimal acyclic automaton over byte words; the outputs on a word's arcs add up to its number."""

    def __init__(self, words: Iterable[bytes], ids: dict[bytes, bytes]):
        words = sorted(words)
        register: dict[tuple, int] = {}
        self.arcs: list[tuple[int, int, int, int]] = []  # state, byte, target, output
        self.final: list[bool] = []
        counts: list[int] = []

        def state(lo: int, hi: int, depth: int) -> int:
            """The state of the words lo to hi, which agree on `depth` bytes; equal right languages share one."""
            final = lo < hi and len(words[lo]) == depth
            at, arcs = lo + final, []
            while at < hi:
                b, end = words[at][depth], at + 1
                while end < hi and words[end][depth] == b:
                    end += 1
                arcs.append((b, state(at, end, depth + 1)))
                at = end
            key = (final, *arcs)
            if (found := register.get(key)) is None:
                found = register[key] = len(self.final)
                self.final.append(final)
                passed = int(final)
                for b, to in arcs:
                    self.arcs.append((found, b, to, passed))
                    passed += counts[to]
                counts.append(passed)
            return found

        self.start = state(0, len(words), 0)
        self.ids = [ids[w] for w in words]

    def layout(self) -> bytes:
        """Flat little-endian form: five lengths, then arcs by (state, byte), targets, outputs, finals, offsets, ids."""
        arcs = np.array(sorted((s << 8 | b, to, out) for s, b, to, out in self.arcs), np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in self.ids]))).astype(np.int64)
        flat = np.frombuffer(b"".join(self.ids), "<u4").astype(np.int64)
        head = np.array([self.start, len(arcs), len(self.final), len(offsets), len(flat)], np.int64)
        return b"".join(x.tobytes() for x in (head, arcs[:, 0].copy(), arcs[:, 1].copy(), arcs[:, 2].copy(), np.array(self.final, np.int64), offsets, flat))


class Lexicon:
    """A transducer's flat form, memory-mapped from a file that all tasks of an executor share; looks up many words at a time."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.start, *sizes = np.frombuffer(self.map, np.int64, 5).tolist()
        at, parts = 40, []
        for n in (sizes[0], sizes[0], sizes[0], *sizes[1:]):
            parts.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.to, self.out, self.final, self.offsets, self.ids = parts

    def look(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        n = len(words)
        state, number, alive = np.full(n, self.start), np.zeros(n, np.int64), np.array([0 < len(w) <= LONGEST for w in words], bool)
        if not len(self.keys) or not alive.any():
            return np.full(n, -1)
        size = np.where(alive, [len(w) for w in words], 0)
        text = np.frombuffer(np.array([w if a else b"" for w, a in zip(words, alive, strict=True)], f"S{int(size.max())}").tobytes(), np.uint8).reshape(n, -1)
        for i in range(text.shape[1]):
            on = np.flatnonzero(alive & (size > i))
            key = state[on] << 8 | text[on, i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[on], number[on] = self.to[at], number[on] + self.out[at]
            alive[on[~hit]] = False
        return np.where(alive & (self.final[state] > 0), number, -1)

    def bytes_of(self, number: int) -> bytes:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].astype("<u4").tobytes()


class Chunks:
    """Ids of chunks by their bytes, in an open hash table that arrays are looked up in; exact, as keys are whole chunks."""

    LONGEST = 23  # bytes of a key, besides one for its length and kind; longer chunks are numbered in a dictionary
    MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros((1 << TABLE, 4), np.uint64)  # key, and the chunk's number, from 1 on
        self.long: dict[str, int] = {}
        self.probes, self.n, self.held = 1, 1, 0
        self.at, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    def full(self, more: int) -> bool:
        return self.n + more > 1 << TABLE - 1

    @classmethod
    def keys(cls, text: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Keys of the chunks at `begin`; at least 24 bytes of `text` follow the last one."""
        words = np.lib.stride_tricks.as_strided(text[:8].view(np.uint64), (len(text) - 7,), (1,)).copy()
        key = np.empty((len(begin), 3), np.uint64)
        for i in range(3):
            key[:, i] = words[begin + 8 * i] & cls.MASK[np.clip(size - 8 * i, 0, 8 - (i == 2))]
        key[:, 2] |= (size | kind << 5).astype(np.uint64) << np.uint64(56)
        return key

    def _first(self, key: np.ndarray) -> np.ndarray:
        mixed = key[:, 0] * self.MIX[0] ^ key[:, 1] * self.MIX[1] ^ key[:, 2] * self.MIX[2]
        return (((mixed ^ mixed >> np.uint64(32)) * self.MIX[3]) >> np.uint64(64 - TABLE)).astype(np.int64)

    def look(self, key: np.ndarray) -> np.ndarray:
        """The number of each chunk, or 0."""
        slot, number, left = self._first(key), np.zeros(len(key), np.int64), np.arange(len(key))
        for _ in range(self.probes):
            row = self.slots[slot]
            same = (row[:, 0] == key[:, 0]) & (row[:, 1] == key[:, 1]) & (row[:, 2] == key[:, 2])
            number[left[same]] = row[same, 3]
            on = ~same & (row[:, 3] > 0)
            if not on.any():
                break
            left, key, slot = left[on], key[on], slot[on] + 1 & (1 << TABLE) - 1
        return number

    def number(self, ids: list[bytes]) -> np.ndarray:
        """Keeps the ids of new chunks; their numbers."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total, new = int(size.sum()), np.arange(self.n, self.n + len(ids))
        for name, need in (("at", self.n + len(ids)), ("size", self.n + len(ids)), ("ids", self.held + total)):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate((old, np.zeros(need + len(old) // 2, old.dtype))))
        self.size[new], self.at[new] = size, self.held + np.cumsum(size) - size
        self.ids[self.held : self.held + total] = np.frombuffer(b"".join(ids), "<u4")
        self.n, self.held = self.n + len(ids), self.held + total
        return new

    def insert(self, key: np.ndarray, number: np.ndarray) -> None:
        """Puts distinct chunks that the table lacks into it."""
        slot, probes = self._first(key), 1
        while len(slot):
            free = np.flatnonzero(self.slots[slot, 3] == 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[first], :3], self.slots[slot[first], 3] = key[first], number[first]
            stay = np.ones(len(slot), bool)
            stay[first] = False
            self.probes, probes = max(self.probes, probes), probes + 1
            slot, key, number = slot[stay] + 1 & (1 << TABLE) - 1, key[stay], number[stay]

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many each has."""
        size = self.size[number]
        return self.ids[np.repeat(self.at[number] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


class Encoder:
    """Encodes texts to little-endian 32-bit ids; made once a task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: str | None = None):
        self.v, self.lexicon = vocabulary, Lexicon(lexicon) if lexicon else None
        self.memo: dict[str, bytes] = {}
        self.table = Chunks()
        self.words: dict[str, bytes] = {}
        self.marks = re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) or r"(?!)")
        self.library = None

    def _library(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.v.file)
        return self.library

    def chunks(self, text: str) -> list[str]:
        """The text's chunks. By the first letter: '^' as it stands, '=' one word, '!' an added token; else after a blank."""
        if self.v.lower:
            return text.replace("\n", " ").split(" ")
        if "<|" not in text or not self.marks.search(text):
            return self._segment(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self._segment(text[at : m.start()]), "!" + m[0]]
            at = m.end()
        return out + self._segment(text[at:])

    def _segment(self, text: str) -> list[str]:
        if not text:
            return []
        if EXOTIC.search(text):
            return ["=" + text[a:b] for _, (a, b) in self._library().pre_tokenizer.pre_tokenize_str(text)]
        if DOUBLE.search(text):
            return ["=" + w for w in BYTE_WORDS.findall(text)]
        lines = text.split("\n")
        if "^" in text or "=" in text or "!" in text:
            parts = [[x if x[:1] not in ("^", "=", "!") else "^ " + x for x in line.split(" ")] for line in lines]
        else:
            parts = [line.split(" ") for line in lines]
        heads = [line.split(" ", 1)[0] for line in lines]
        parts[0][0] = "^" + heads[0]
        for p, h in zip(parts[1:], heads[1:], strict=True):
            p[0] = "^\n" + h
        return [x for p in parts for x in p]

    def cut(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk, as the pre-tokenizer cuts them; added tokens have none.

        Letters alone are one word, and letters with one mark after them are two; only other chunks need the pattern.
        """
        out: list[list[str]] = []
        odd: list[int] = []
        if self.v.lower:
            for c in map(str.lower, chunks):
                if c.isalpha():
                    out.append([c])
                elif c[-1:] in MARKS and (w := c[:-1]).isalpha():
                    out.append([w, c[-1]])
                else:
                    odd.append(len(out))
                    out.append([])
        else:
            for c in chunks:
                if c.isalpha():
                    out.append([" " + c])
                elif c[-1:] in MARKS and (w := c[:-1]).isalpha():
                    out.append([" " + w, c[-1]])
                elif c[:2] == "^\n" and (w := c[2:]).isalpha():
                    out.append(["\n", w])
                else:
                    odd.append(len(out))
                    out.append([])
        if odd:
            for i, parts in zip(odd, self._cut_by_pattern([chunks[i] for i in odd]), strict=True):
                out[i] = parts
        return out

    def _cut_by_pattern(self, chunks: list[str]) -> list[list[str]]:
        """cut() for chunks of any form."""
        if self.v.lower:
            tokens = LOWER_WORDS.findall("\0".join(chunks).lower())
        else:
            raw = [c[1:] if c[:1] == "^" else "" if c[:1] in ("=", "!") and len(c) > 1 else " " + c for c in chunks]
            tokens = BYTE_WORDS.findall("\0".join(raw))
        out, at = [], 0
        tokens.append("\0")
        while at < len(tokens):
            end = tokens.index("\0", at)
            out.append(tokens[at:end])
            at = end + 1
        if not self.v.lower:
            for i, c in enumerate(chunks):
                if c[:1] == "=" and len(c) > 1:
                    out[i] = [c[1:]]
        return out

    def ids_of(self, words: list[str]) -> dict[str, bytes]:
        """Words that have not been seen: from the transducer, or else merged."""
        raw, known = [w.encode() for w in words], {}
        if self.lexicon:
            numbers = self.lexicon.look(raw).tolist()
            known = {w: self.lexicon.bytes_of(k) for w, k in zip(words, numbers, strict=True) if k >= 0}
            words, raw = [w for w, k in zip(words, numbers, strict=True) if k < 0], [w for w, k in zip(raw, numbers, strict=True) if k < 0]
        return known | dict(zip(words, self.v.encode(raw), strict=True)) if words else known

    def resolve(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks."""
        if self.v.lower:
            every = " ".join(chunks)
            odd = [c for c in chunks if "<|" in c or EXOTIC.search(c)] if "<|" in every or EXOTIC.search(every) else []
            got = {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(odd, self._library().encode_batch(odd, add_special_tokens=False) if odd else (), strict=True)}
        else:
            odd = [c for c in chunks if c[:1] == "!" and c[1:] in self.v.added]
            got = {c: np.array([self.v.added[c[1:]]], "<u4").tobytes() for c in odd}
        chunks = [c for c in chunks if c not in got] if odd else chunks
        if not chunks:
            return got
        parts = self.cut(chunks)
        if len(self.words) > MEMO:
            self.words.clear()
        if new := set().union(*parts).difference(self.words):
            self.words.update(self.ids_of(list(new)))
        get = self.words.__getitem__
        ids = [get(p[0]) if len(p) == 1 else get(p[0]) + get(p[1]) if len(p) == 2 else b"".join(map(get, p)) for p in parts]
        got.update(zip(chunks, ids, strict=True))
        return got

    def _plain(self, text: str) -> bool:
        """The text's chunks are what stands between its blanks and line ends."""
        return self.v.lower or not ("<|" in text or EXOTIC.search(text) or DOUBLE.search(text))

    def _forms(self, raw: list[bytes], kind: list[int]) -> list[str]:
        """The forms of chunks() for what follows a blank (0), a line end (1; 0 if they are alike) or nothing (2)."""
        if not raw or self.v.lower:
            return b"\n".join(raw).decode().split("\n") if raw else []
        start = ("", "^\n", "^")
        return [start[k] + x if k or x[:1] not in ("^", "=", "!") else "^ " + x for x, k in zip(b"\n".join(raw).decode().split("\n"), kind, strict=True)]

    def _numbers(self, raw: bytes, text: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The numbers of chunks in the table, which new ones are resolved for and put into."""
        table, size = self.table, end - begin
        is_long = size > table.LONGEST
        short, long = np.flatnonzero(~is_long), np.flatnonzero(is_long)
        origin = int(begin[0])
        key = table.keys(text[origin : int(end[-1]) + 32], begin[short] - origin, size[short], kind[short])
        number = np.zeros(len(begin), np.int64)
        number[short] = table.look(key)
        miss = np.flatnonzero(number[short] == 0)
        where = np.concatenate((short[miss], long))
        if not len(where):
            return number
        forms = self._forms([raw[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)], kind[where].tolist())
        far = forms[len(miss) :]
        new = dict(zip(forms, miss.tolist(), strict=False))
        late = dict.fromkeys(c for c in far if c not in table.long)
        if table.full(len(new) + len(late)) and table.n > 1:
            table.clear()
            return self._numbers(raw, text, begin, end, kind)
        got = self.resolve([*new, *late])
        made = table.number([got[c] for c in (*new, *late)])
        table.insert(key[list(new.values())], made[: len(new)])
        table.long.update(zip(late, made[len(new) :].tolist(), strict=True))
        given = dict(zip(new, made.tolist(), strict=False))
        number[where] = [*map(given.__getitem__, forms[: len(miss)]), *map(table.long.__getitem__, far)]
        return number

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        raw = b"\n" + b"\n".join(raws) + b"\n" + bytes(32)
        text = np.frombuffer(raw, np.uint8)
        marks = np.flatnonzero((text == 32) | (text == 10))
        first = np.searchsorted(marks, np.cumsum([0, *(len(r) + 1 for r in raws)]))  # chunk that each text begins with
        kind = np.zeros(len(marks), np.int64)
        if not self.v.lower:
            kind[text[marks] == 10] = 1
            kind[first] = 2
        ids, sizes = [], []
        for i in range(0, len(marks) - 1, WINDOW):
            to = min(i + WINDOW, len(marks) - 1)
            got, size = self.table.ids_of(self._numbers(raw, text, marks[i:to] + 1, marks[i + 1 : to + 1], kind[i:to]))
            ids.append(got)
            sizes.append(size)
        whole = np.concatenate(ids).astype("<u4").tobytes()
        to = (4 * np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))[first].tolist()
        return [whole[a:b] for a, b in zip(to, to[1:], strict=False)]

    def _encode_others(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        need = set().union(*cut)
        new = need.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = need
        self.memo.update(self.resolve(list(new)))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), TOGETHER):
            part = texts[i : i + TOGETHER]
            plain = [self._plain(t) for t in part]
            fast = iter(self._encode_plain([t for t, p in zip(part, plain, strict=True) if p]) if any(plain) else ())
            slow = iter(self._encode_others([t for t, p in zip(part, plain, strict=True) if not p]) if not all(plain) else ())
            out += [next(fast if p else slow) for p in plain]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", most: int = LEXICON) -> list[bytes]:
    """The most frequent words of all documents, counted over all of them: every word from a least count on, `most` at most.

    The least count comes from a histogram of counts, so that no task sorts words and no more than `most` reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def sent(encoder: Encoder, seen: Counter) -> pa.RecordBatch:
        words: dict[str, int] = {}
        get = words.get
        for parts, n in zip(encoder.cut(list(seen)), seen.values(), strict=True):
            for w in parts:
                words[w] = get(w, 0) + n
        return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(shared.value), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(encoder.chunks(t or ""))
                if len(seen) > COUNTED:
                    yield sent(encoder, seen)
                    seen.clear()
        if seen:
            yield sent(encoder, seen)

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    counted = counted.filter(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = materialize(counted.withColumn("step", F.floor(F.log2(F.col("n")) * 16).cast("int")), "words")
    held, least = 0, None
    for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 steps for each doubling of n
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    words = [bytes(w) for w in counted.filter(F.col("step") >= least).select("word").toArrow()["word"].to_pylist()] if least is not None else []
    discard(counted)
    return words


def lexicon(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The transducer of the words, with the ids that they merge to, in its flat form."""
    return Transducer(words, dict(zip(words, vocabulary.encode(words), strict=True))).layout()


def distribute(spark: SparkSession, layout: bytes) -> str:
    """Puts a lexicon in the shared folder and has Spark fetch it once to every executor, new ones too; its file name."""
    path = scratch(spark, "lexicon")
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(layout)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array of int).

    Ids are those of the tokenizer file at `path` without special tokens; they are decoded again with all tokens kept.
    Null texts count as empty and have no ids. Repeated rows and null ids stay, other columns are ignored, an empty table
    gives no rows. A text of any length is encoded whole; a batch holds its chunks and ids, some ten times its size.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = Vocabulary.read(path)
    file = distribute(spark, lexicon(frequent_words(docs, vocabulary, text), vocabulary))
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, SparkFiles.get(file))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                texts = [sha(encoder.decode(x).encode()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(map(sha, ids)), pa.array(texts), tokens], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
