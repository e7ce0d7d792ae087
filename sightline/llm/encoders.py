"""Bounded memos before the public tokenizer libraries. Workers keep one encoder a file; tokenizers are only read, never trained."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from sightline.llm import common

#: Entries a worker's memo may hold, in an older and a newer half; the older goes when the newer is full.
MEMO = 800_000
#: Longest chunk that stays in a memo, in characters.
KEPT = 256
#: Chunks looked up between two looks at the memo's size.
AT_ONCE = 50_000
#: What the files split by; only under it may a chunk's trailing punctuation be encoded apart from the rest.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Longest such run of punctuation.
RUN = 8
#: Kinds of bytes: white space that parts two chunks, ASCII punctuation, ASCII letters and digits.
GAP, MARK, PLAIN = 1, 2, 3
#: The characters that byte-level vocabularies write for the 256 bytes: printable Latin-1 ones for themselves, the rest from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_LETTERS = np.array([chr(b).isalnum() for b in range(128)]).nonzero()[0]
_MARKS = sorted(set(range(0x21, 0x7F)) - set(_LETTERS.tolist()))


class _Memo(dict):
    """Looks each chunk up once and asks learn for those it lacks, without sets of a text's chunks beside it."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(chunk)


def _joined(codes: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after another, and how many each of the codes has."""
    return np.frombuffer(b"".join(codes), dtype), np.fromiter(map(len, codes), np.int64, len(codes)) // dtype.itemsize


class WordEncoder:
    """tokenizers files whose pre-tokens never span white space and drop it: the ids of a text are those of its chunks between
    ASCII white space, one after another. Chunks are cut and numbered in arrays of many texts, each distinct one is looked up once
    in a bounded memo, and only new ones are encoded by the library."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path))
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        drops = split.get("behavior") == "Removed" and split.get("invert") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
        self.by_chunk = bool(drops and spec["model"].get("end_of_word_suffix") and any(x["type"] == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", [])))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.merges = self.tokenizer.model.tokenize
        self.memo: dict[str, bytes] = _Memo(self._learn)
        self.old: dict[str, bytes] = {}
        self.limit = memo // 2
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[[0x20, *range(9, 14)]] = GAP
        self.kinds[_LETTERS] = PLAIN
        if self.by_chunk and split["pattern"] == {"Regex": SPLIT}:  # punctuation of added tokens stays where it is, so that they stay whole
            self.kinds[[b for b in _MARKS if not any(chr(b) in t["content"] for t in spec["added_tokens"])]] = MARK

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, core: str) -> bytes | None:
        """The ids of Latin letters alone, which are one pre-token after lower-casing: straight from the library's merges. None for other text."""
        if core.isascii():
            if not core.isalpha():
                return None
            low = written = core.lower()
        else:
            if not core.isalpha() or max(core) > "\u024f" or "\u0130" in core or not is_normalized("NFC", core):
                return None
            low = core.lower()
            written = "".join([_BYTE_CHARS[b] for b in low.encode()])
        ids = self.memo.get(low)
        if ids is None:
            ids = array(self.code, [t.id for t in self.merges(written)]).tobytes()
            if len(low) <= KEPT:
                self.memo[low] = ids
        return ids

    def _learn(self, c: str) -> bytes:
        """The ids of one chunk that the memo lacks."""
        ids = self.old.get(c)
        if ids is None:
            ids = self._plain(c)
            if ids is None:
                ids = self._whole(c)
        if len(c) <= KEPT:
            self.memo[c] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes without white space, where chunks begin in them (and the last one ends), and where texts do. Punctuation that ends a chunk after a
        letter or a digit is a chunk of its own, as it is a pre-token of its own."""
        kinds = self.kinds[raw]
        gaps = np.flatnonzero(kinds == GAP)
        data, kinds = raw[kinds != GAP], kinds[kinds != GAP]
        docs = offsets - np.searchsorted(gaps, offsets)
        begins = np.zeros(len(data) + 1, bool)
        begins[gaps - np.arange(len(gaps))] = True
        begins[docs] = True
        bounds = np.flatnonzero(begins)
        marked = np.flatnonzero(kinds[bounds[1:] - 1] == MARK)
        first, at = bounds[marked], bounds[marked + 1]
        for _ in range(RUN):
            at = at - ((at > first) & (kinds[at - 1] == MARK))
        at = at[at > first]
        tail, lead = data[at - 1], data[at - 2]
        # two-byte characters from U+00C0 to U+023F are letters and stay letters in lower case, but for ×, ÷ and İ, which gets a dot of its own
        latin = (tail >= 0x80) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((lead == 0xC4) & (tail == 0xB0))
        begins[at[(kinds[at - 1] == PLAIN) | latin]] = True
        return data, np.flatnonzero(begins), docs

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one text after another, and how many each has."""
        raw, offsets = common.flat(texts)
        if not self.by_chunk:
            return _joined(self._library(texts.to_pylist()), self.dtype)
        data, bounds, docs = self._cut(raw, offsets)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        numbered = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        chunks, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        codes = []
        for a in range(0, len(chunks), AT_ONCE):
            if len(self.memo) >= self.limit:
                self.old, self.memo = self.memo, _Memo(self._learn)
            codes.extend(map(self.memo.__getitem__, chunks[a : a + AT_ONCE]))
        known, sizes = _joined(codes, self.dtype)
        starts = np.cumsum(sizes) - sizes
        n = sizes[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(starts[number] - ends[:-1], n)
        place += np.arange(len(place))
        return known[place], np.diff(ends[np.searchsorted(bounds, docs)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian bytes of self.dtype."""
        ids, counts = self.encode_arrow(pa.array(texts, pa.string()))
        ends = np.cumsum(counts).tolist()
        return [ids[e - n : e].tobytes() for e, n in zip(ends, counts.tolist(), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        return self.encode_arrow(pa.array(texts, pa.string()))[1].tolist()


class PieceEncoder:
    """A sentencepiece model; whole texts go to the library."""

    dtype = np.dtype("<u4")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _joined(self.encode(texts.to_pylist()), self.dtype)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder | PieceEncoder:
    return PieceEncoder(path) if path.endswith(".model") else WordEncoder(path)


@lru_cache(maxsize=16)
def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file, which stands for its version."""
    return hashlib.sha256(open(path, "rb").read()).hexdigest()
