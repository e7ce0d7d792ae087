"""Byte-level BPE: whole pre-tokens through a minimal perfect hash of the vocabulary, other pre-tokens by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from sightline.llm import common

#: Longest piece that stays in a memo, in characters.
KEPT = 256
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash in levels of bit maps: a key stays in the first level where no other key has its place, and its number
    is the rank of that bit among all levels. Keys are 64-bit fingerprints; a lookup returns a number for any key, so callers compare."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []
        self.offsets: list[int] = []
        left, used = np.asarray(keys, np.uint64), 0
        if len(np.unique(left)) != len(left):
            raise ValueError("fingerprints collide")
        while len(left):
            size = max(64, int(gamma * len(left)))
            place = _mix(left, len(self.levels)) % np.uint64(size)
            taken = np.bincount(place.astype(np.int64), minlength=size) == 1
            self.levels.append((size, np.where(taken, np.cumsum(taken) - 1, -1).astype(np.int32)))
            self.offsets.append(used)
            used += int(taken.sum())
            left = left[~taken[place.astype(np.int64)]]
        self.size = used

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """A number below size for each key, or -1 for what is certainly no key."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, ((size, rank), offset) in enumerate(zip(self.levels, self.offsets, strict=True)):
            if not len(todo):
                break
            found = rank[(_mix(keys[todo], level) % np.uint64(size)).astype(np.int64)]
            hit = found >= 0
            out[todo[hit]] = found[hit] + offset
            todo = todo[~hit]
        return out


class ByteBpe:
    """Encoder and decoder for a file of ranks (base64 token, rank)."""

    def __init__(self, path: str, pattern: str, memo: int = 400_000) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.find = regex.compile(pattern).findall
        tokens = list(self.ranks)
        prints = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
        self.hash = PerfectHash(prints)
        place = self.hash.lookup(prints)
        self.keys: list[bytes] = [b""] * len(tokens)
        self.ids = np.zeros(len(tokens), np.uint32)
        for t, p in zip(tokens, place.tolist(), strict=True):
            self.keys[p] = t
            self.ids[p] = self.ranks[t]
        n = max(self.ranks.values()) + 1
        by_id = [b""] * n
        for t, i in self.ranks.items():
            by_id[i] = t
        self.bytes_table = self._table(by_id)
        self.text_table = self._table([b"%d " % i for i in range(n)])
        self.memo: dict[str, bytes] = {}  # in an older and a newer half; the older goes when the newer is full
        self.old: dict[str, bytes] = {}
        self.limit = memo // 2

    @staticmethod
    def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(v) for v in values], np.int64)
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths

    @staticmethod
    def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        data, starts, lengths = table
        n = lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return data[np.arange(ends[-1]) + np.repeat(starts[ids] - (ends - n), n)].tobytes()

    def merge(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: a heap of adjacent pairs over a doubly linked list of parts."""
        ranks = self.ranks
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(parts[j]) != size:  # a part has changed since
                continue
            parts[i] = merged = left + parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(merged + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(merged) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + merged)) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(merged)))
        return [ranks[p] for p in parts if p is not None]

    def pretokens(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, each as bytes of uint32: whole ones by the perfect hash, the rest by merging."""
        raw = [w.encode("utf-8") for w in words]
        place = self.hash.lookup(np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64)) if raw else []
        keys, ids, merge = self.keys, self.ids, self.merge
        return [ids[p].tobytes() if p >= 0 and keys[p] == r else np.array(merge(r), "<u4").tobytes() for r, p in zip(raw, list(place), strict=True)]

    @staticmethod
    def _units(text: str) -> list[str] | None:
        """Pieces whose pre-tokens are those of the text: cut before a blank and around a line feed that stand alone. None if white
        space is adjacent, at an end, or of another kind."""
        if not text or "\x01" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, each match of the pattern by itself, without special tokens."""
        cut = []
        for t in texts:
            units = None if _OTHER_SPACE(t) else self._units(t)
            cut.append(self.find(t) if units is None else units)
        seen: set[str] = set()
        for units in cut:
            seen.update(units)
        missing = seen.difference(self.memo)  # of a dict, not of its keys: walks the smaller side
        if len(self.memo) + len(missing) > self.limit:
            self.old, self.memo, missing = self.memo, {}, seen
        old = self.old
        kept = {u: old[u] for u in missing if u in old}
        self.memo.update(kept)
        new = list(missing.difference(kept))
        split = [self.find(u) for u in new]
        words = list({w for s in split for w in s}.difference(self.memo))
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            self.memo.update(zip(part, self.pretokens(part), strict=True))
        memo = self.memo
        for u, s in zip(new, split, strict=True):
            if len(s) != 1:
                memo[u] = b"".join([memo[w] for w in s])
        get = memo.__getitem__
        out = [np.frombuffer(b"".join(map(get, units)), "<u4") for units in cut]
        for u in {x for x in (*new, *words) if len(x) > KEPT}:
            memo.pop(u, None)
        return out

    def forget(self) -> None:
        self.memo, self.old = {}, {}

    def decode(self, ids: np.ndarray) -> bytes:
        return self._gather(self.bytes_table, ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one blank."""
        return self._gather(self.text_table, ids)[:-1]


#: White space but blanks and line feeds: texts with them are cut by the pattern alone.
_OTHER_SPACE = regex.compile(r"[^\S \n]").search


#: Pre-tokens that a worker remembers.
MEMO = 400_000


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str, memo: int = MEMO) -> ByteBpe:
    return ByteBpe(path, pattern, memo)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs(doc_id, text). A null or empty text has no ids; texts are encoded whole, however long; repeated
    rows and null ids keep their rows; an empty table gives none; other columns are ignored."""

    def make():
        import pyarrow as pa

        coder = byte_bpe(path, pattern)

        def each(batch):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in common.slices(texts):
                codes = coder.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, codes)]).astype(np.int32)
                yield {"doc_id": ids.slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(codes).view(np.int32) if codes else [], pa.int32()))}

        return each

    return common.arrow_map(docs.select("doc_id", common.text_of(docs).alias("text")), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, memo: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text): whole texts are encoded and the ids decoded again.

    A null text is empty (no ids). Repeated rows and null ids keep their rows; an empty table gives none; other columns are ignored.
    Documents stay in their partitions: nothing is shuffled, and a task holds a slice of texts and a bounded memo. memo: so many pre-tokens at most, forgotten
    after each task, for stages that share workers with others; without it a worker keeps MEMO of them from task to task.
    """

    def make():
        coder = byte_bpe(path, pattern, memo or MEMO)

        def each(batch):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in common.slices(texts):
                codes = coder.encode(texts[a:b])
                yield {"doc_id": ids.slice(a, b - a), "n_tokens": [len(c) for c in codes], "ids_sha256": [hashlib.sha256(coder.decimal(c)).hexdigest() for c in codes], "decoded_sha256": [hashlib.sha256(coder.decode(c)).hexdigest() for c in codes]}

        if memo:
            each.done = coder.forget
        return each

    return common.arrow_map(docs.select("doc_id", common.text_of(docs).alias("text")), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", tidy=True)
