"""Language-model scores from an n-gram trie of order 3 in Elias-Fano levels.

Level one is the vocabulary: the 64-bit word hashes in order, whose places are the word ids, and the running sum of their counts. Level two holds for
each word the ids of its successors, level three for each pair of words the ids of theirs. A level has monotone pointers to the range of each context, and
successor ids made monotone by adding where the range before ended, so that a word is searched for relative to its context. A successor has a
quantised log10 of its smoothed share, count / (context's count + pseudo-counts), to which the lower order is added by weight:

    p(c | a b) = share(a b c) + PAIR / (n(a b) + PAIR) * p(c | b),   p(c | b) = share(b c) + WORD / (n(b) + WORD) * p(c),   p(c) = (n(c) + 1) / (N + V + 1)

A pair has its quantised count besides. The trie is split into shards by running token counts of the first word; a first word that holds more than a
shard's share of all tokens is split by the second. Shards are files in the shared folder that workers memory-map.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.elias_fano import EliasFano
from sightline.llm.token_binary import pack, unpack

#: Pseudo-counts of a word and of a pair as contexts, chosen on the held-out fold of sf0.1.
WORD, PAIR = 1000.0, 5.0
#: Characters counted or scored at once, sums that a merging task holds before it adds them up, tokens a shard of the trie, and documents a shard of the vocabulary.
CHARS = 6 << 20
HELD = 4_000_000
SHARD = 8_000_000
DOCS = 100_000
#: Bits of a word's number among the distinct words of a slice, for three of them to share 63; slices of more words are put in order column by column.
LOCAL = 21
#: Counts up to here have a code each, larger ones one for a range of some 20 %.
EXACT = 128
COUNT_OF = np.append(np.arange(EXACT + 1.0), EXACT * 2 ** (np.arange(1, 256 - EXACT) / 3.8))
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_digest = xxhash.xxh3_64_intdigest


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words, ASCII letters in lower case, then the end of each text), and tokens a text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    out = np.full(int(lengths.sum()), END, np.uint64)
    body = np.ones(len(out), bool)
    body[np.cumsum(lengths) - 1] = False
    out[body] = np.fromiter((h for w in words for h in map(_digest, w)), np.uint64, int(body.sum()))
    return out, lengths


# ---- sums of keys of one or three columns


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are in order."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def add_up(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, and the sum of counts of each."""
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    at = _starts(*columns)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


def _write_numbers(x: np.ndarray) -> list[bytes]:
    """Unsigned numbers as four streams: low and high halves, the latter empty where all are below 2**32."""
    x = x.astype(np.uint64)
    high = x >> np.uint64(32)
    return [*pack(x & np.uint64(0xFFFFFFFF)), *(pack(high) if high.any() else (b"", b""))]


def _read_numbers(parts: list[bytes], n: int) -> np.ndarray:
    low = unpack(parts[0], parts[1], n).astype(np.int64)
    return low | unpack(parts[2], parts[3], n).astype(np.int64) << 32 if parts[2] else low


def _relative(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within runs that begin at starts, where the value itself stands."""
    out = np.diff(value, prepend=0)
    out[starts] = value[starts]
    return out


def _absolute(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    lengths = np.diff(np.append(starts, len(steps)))
    return total - np.repeat(total[starts] - steps[starts], lengths)


def write_sums(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Keys in order and their counts: each column as steps within equal columns before it."""
    streams, starts = [], np.zeros(min(1, len(counts)), np.int64)
    for k, c in enumerate(columns):
        streams += _write_numbers(_relative(c.view(np.int64), starts))
        starts = _starts(*columns[: k + 1])
    streams += _write_numbers(counts)
    return np.array([len(counts), *map(len, streams)], "<i8").tobytes() + b"".join(streams)


def read_sums(blob: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = np.frombuffer(blob, "<i8", 1 + 4 * (width + 1)).tolist()
    at, parts = 8 * len(sizes), []
    for n in sizes[1:]:
        parts.append(blob[at : at + n])
        at += n
    numbers = [_read_numbers(parts[k : k + 4], sizes[0]) for k in range(0, len(parts), 4)]
    columns, starts = [], np.zeros(min(1, sizes[0]), np.int64)
    for k in range(width):
        columns.append(_absolute(numbers[k], starts))
        starts = _starts(*columns)
    return columns, numbers[-1]


def _merge(counted: DataFrame, shards: int, width: int, finish, schema: str) -> DataFrame:
    """One call of finish(shard, columns, counts) for each shard, with the sums over all its blobs."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)

    def stream(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(fields)
        now, held, sums = None, 0, []

        def total():
            return add_up([np.concatenate([s[0][k] for s in sums]) for k in range(width)], np.concatenate([s[1] for s in sums]))

        def out():
            row = finish(now, *total())
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in kind], schema=kind)

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if sums:
                        yield out()
                    now, held, sums = shard, 0, []
                sums.append(read_sums(blob.as_py(), width))
                held += len(sums[-1][1])
                if held > HELD:
                    sums = [total()]
                    held = 0
        if sums:
            yield out()

    return common.materialise(counted.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(stream, schema), "lm-shards")


# ---- level one


class Vocabulary:
    """Memory-mapped level one. spec: folder, bits of the shard number, tokens, words, and by shard words and tokens before and words."""

    def __init__(self, spec: tuple) -> None:
        folder, self.bits, self.n_tokens, self.n_words, shards = spec
        self.shards = []
        for s, (before, tokens_before, n) in enumerate(shards):
            if not n:
                self.shards.append(None)
                continue
            raw = common.mapped(f"{folder}/words-{s}")
            hashes, at = EliasFano.view(raw, 0)
            running, _ = EliasFano.view(raw, at)
            self.shards.append((before, tokens_before, hashes, running))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id (-1: unknown), count, and tokens of all smaller ids, of each hash; hashes must be in order."""
        ids, counts, below = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        low = np.uint64(64 - self.bits)
        cut = np.searchsorted(h >> low, np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for s, shard in enumerate(self.shards):
            x, y = cut[s], cut[s + 1]
            if x == y or shard is None:
                continue
            before, tokens_before, hashes, running = shard
            rest = (h[x:y] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            at = hashes.find(rest, np.zeros(len(rest), np.int64), np.full(len(rest), hashes.n))
            known = np.flatnonzero(at >= 0)
            at = at[known]
            ids[x:y][known] = at + before
            start = running.access(at)
            below[x:y][known] = start + tokens_before
            counts[x:y][known] = running.access(at + 1) - start
        return ids, counts, below


    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """The count of each known id."""
        out = np.zeros(len(ids), np.int64)
        for shard in self.shards:
            if shard is not None:
                at = ids - shard[0]
                mine = np.flatnonzero((at >= 0) & (at < shard[2].n))
                out[mine] = shard[3].access(at[mine] + 1) - shard[3].access(at[mine])
        return out


def write_words(hashes: np.ndarray, counts: np.ndarray, bits: int) -> list[bytes]:
    """The file of one shard of the vocabulary: hashes below the shard's bits, and running counts from 0."""
    rest = (hashes & ((np.uint64(1) << np.uint64(64 - bits)) - np.uint64(1))).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(counts)])
    return [p.tobytes() for sequence in (EliasFano.build(rest), EliasFano.build(running)) for p in sequence.parts()]


@lru_cache(maxsize=2)
def _vocabulary(spec: tuple) -> Vocabulary:
    return Vocabulary(spec)


# ---- levels two and three


def shard_of(below: np.ndarray, count: np.ndarray, second: np.ndarray, total: int, words: int, shards: int) -> np.ndarray:
    """The shard of each pair of words: by tokens of smaller first words, and within a first word over several shards by the second."""
    each = max(1, -(-total // shards))
    lo, hi = below // each, (below + np.maximum(count, 1) - 1) // each
    return np.minimum(lo + (hi - lo + 1) * second // (words + 2), shards - 1)


def count_code(n: np.ndarray) -> np.ndarray:
    return np.where(n <= EXACT, n, np.minimum(255, EXACT + np.rint(3.8 * np.log2(np.maximum(n, 1) / EXACT)))).astype(np.uint8)


def _quantised(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 shares, evenly spaced in log10, and a code for each of the given."""
    p = np.log10(share)
    low, high = (float(p.min()), float(p.max())) if len(p) else (0.0, 0.0)
    return 10 ** (low + (high - low) * np.arange(256) / 255), np.rint((p - low) / max(high - low, 1e-12) * 255).astype(np.uint8)


def _level(context: np.ndarray, contexts: int, successor: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Code book, pointers, successors and codes; context counts from 0 and is in order, successors are in order within it."""
    book, codes = _quantised(share)
    ends = np.searchsorted(context, np.arange(contexts + 1))
    starts = _starts(context) if len(context) else np.zeros(0, np.int64)
    highest = successor[np.append(starts[1:], len(successor)) - 1] if len(starts) else successor
    base = np.repeat(np.concatenate([[0], np.cumsum(highest)])[: len(starts)], np.diff(np.append(starts, len(successor))))
    padded = np.zeros(-(-len(codes) // 8) * 8, np.uint8)
    padded[: len(codes)] = codes
    return [book, *EliasFano.build(ends).parts(), *EliasFano.build(base + successor).parts(), padded]


class _Level:
    def __init__(self, raw: np.ndarray, at: int) -> None:
        self.book = np.frombuffer(raw, "<f8", 256, at)
        self.pointers, at = EliasFano.view(raw, at + 2048)
        self.successors, at = EliasFano.view(raw, at)
        self.codes = raw[at : at + self.successors.n]
        self.end = at + -(-self.successors.n // 8) * 8

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each word among its context's successors, or -1: its id is added to where the range before ended and searched for. Contexts must be in order."""
        at = _starts(context) if len(context) else np.zeros(0, np.int64)
        own, times = context[at], np.diff(np.append(at, len(context)))
        lo, hi = self.pointers.access(own), self.pointers.access(own + 1)
        base = np.zeros(len(own), np.int64)
        some = (lo > 0) & (lo < hi)
        base[some] = self.successors.access(lo[some] - 1)
        return self.successors.find(np.repeat(base, times) + word, np.repeat(lo, times), np.repeat(hi, times))


class _Shard:
    def __init__(self, raw: np.ndarray) -> None:
        self.first = int(np.frombuffer(raw, "<i8", 1)[0])
        self.words = _Level(raw, 8)
        n = self.words.successors.n
        self.counts = raw[self.words.end : self.words.end + n]
        self.pairs = _Level(raw, self.words.end + -(-n // 8) * 8)


def build_shard(columns: list[np.ndarray], counts: np.ndarray, first_counts: np.ndarray, nothing: int) -> list[bytes]:
    """The file of one shard from its triples in order, their counts, and the count of each triple's first word. nothing is the id after the last token of a text."""
    a, b, c = columns
    at = _starts(a, b)
    n_pair = np.add.reduceat(counts, at)
    pair = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(a))))
    first = int(a[0])
    real = c != nothing
    codes = np.zeros(-(-len(at) // 8) * 8, np.uint8)
    codes[: len(at)] = count_code(n_pair)
    level2 = _level(a[at] - first, int(a[-1]) - first + 1, b[at], n_pair / (first_counts[at] + WORD))
    level3 = _level(pair[real], len(at), c[real], counts[real] / (n_pair[pair[real]] + PAIR))
    return [np.array([first], "<i8").tobytes(), *(x.tobytes() for x in (*level2, codes, *level3))]


class Model:
    """The trie for a worker. spec: vocabulary spec, training documents, folder, shards."""

    def __init__(self, spec: tuple) -> None:
        vocabulary, self.docs, self.folder, self.n_shards = spec
        self.vocabulary = _vocabulary(vocabulary)
        self.open: dict[int, _Shard | None] = {}
        self.n, self.v = self.vocabulary.n_tokens, self.vocabulary.n_words
        self.total = self.n + self.docs  # first words: every token, and each text's beginning

    def shard(self, s: int) -> _Shard | None:
        if s not in self.open:
            path = f"{self.folder}/trie-{s}"
            self.open[s] = _Shard(common.mapped(path)) if common.exists(path) else None
        return self.open[s]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For hashes h: the number of each among the distinct ones; and by number the id, count and tokens below, followed by those of the beginning of a text and
        of the nothing after its end. Numbers are in order of ids, but for unknown words."""
        u, at = np.unique(h, return_inverse=True)
        ids, counts, below = self.vocabulary.find(u)
        return at, np.append(ids, [self.v, self.v + 1]), np.append(counts, [self.docs, 0]), np.append(below, [self.n, self.total])

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.v, self.docs, self.vocabulary.count_of(ids))

    def places(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        return shard_of(below[first], counts[first], ids[second], self.total, self.v, self.n_shards)


def _by_shard(place: np.ndarray):
    """(shard, rows) of rows put in order by shard; rows of one shard keep their order."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    ids, at = np.unique(place[order], return_index=True)
    for s, x, y in zip(ids.tolist(), at, np.append(at[1:], len(place)), strict=True):
        yield s, order[x:y]


def triples(at: np.ndarray, lengths: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct triples in order, and how often each occurs, of texts of word numbers below words - 2: each text stands between its
    beginning (words - 2) and nothing (words - 1), so that there is one a token."""
    n = len(lengths)
    text = np.repeat(np.arange(n), lengths)
    row = np.full(len(at) + 2 * n, words - 1, np.int64)
    row[np.arange(len(at)) + 2 * text + 1] = at
    starts = np.cumsum(lengths + 2) - lengths - 2
    row[starts] = words - 2
    begins = np.ones(len(row), bool)
    begins[starts + lengths] = begins[starts + lengths + 1] = False
    i = np.flatnonzero(begins)
    if words <= 1 << LOCAL:
        keys, counts = np.unique(row[i] << 2 * LOCAL | row[i + 1] << LOCAL | row[i + 2], return_counts=True)
        mask = (1 << LOCAL) - 1
        return [keys >> 2 * LOCAL, keys >> LOCAL & mask, keys & mask], counts
    return add_up([row[i], row[i + 1], row[i + 2]], np.ones(len(i), np.int64))


def train(docs: DataFrame, folder: str) -> tuple:
    """The spec of a model of docs(text), whose files are written below folder. Only sizes by shard reach the driver."""
    spark = docs.sparkSession
    folder = common.qualified(spark, folder)
    texts = docs.select(common.text_of(docs).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_docs = texts.count()
    bits = max(2, (max(tasks, -(-n_docs // DOCS)) - 1).bit_length() - 1)

    def counting(slice_sums, schema: str = "shard int, blob binary") -> DataFrame:
        """shard, blob of what slice_sums gives for each slice of texts: (shard, columns, counts)."""

        def run(batches):
            import pyarrow as pa

            each = slice_sums()
            for batch in batches:
                values = batch.column(0).to_pylist()
                for a, b in common.slices(values, CHARS):
                    shards, blobs = [], []
                    for s, columns, counts in each(values[a:b]):
                        shards.append(s)
                        blobs.append(write_sums(columns, counts))
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int32()), "blob": pa.array(blobs, pa.binary())})

        return texts.mapInArrow(run, schema)

    def count_words():
        def each(values):
            h, n = np.unique(tokens(values)[0], return_counts=True)
            cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                yield s, [h[cut[s] : cut[s + 1]].view(np.int64) & np.int64((1 << (64 - bits)) - 1)], n[cut[s] : cut[s + 1]]

        return each

    def finish_words(shard, columns, counts):
        common.put_file(f"{folder}/words-{shard}", write_words(columns[0].view(np.uint64), counts, bits))
        return {"shard": shard, "n": len(counts), "total": int(counts.sum())}

    sizes = {r["shard"]: r for r in _merge(counting(count_words), tasks, 1, finish_words, "shard int, n long, total long").collect()}
    listed, before, tokens_before = [], 0, 0
    for s in range(1 << bits):
        n, total = (sizes[s]["n"], sizes[s]["total"]) if s in sizes else (0, 0)
        listed.append((before, tokens_before, n))
        before, tokens_before = before + n, tokens_before + total
    shards = max(tasks, -(-tokens_before // SHARD))
    spec = ((folder, bits, tokens_before, before, tuple(listed)), n_docs, folder, shards)
    if not n_docs:
        return spec

    def count_triples():
        model = Model(spec)

        def each(values):
            h, lengths = tokens(values)
            at, ids, counts, below = model.words(h)
            (a, b, c), n = triples(at, lengths, len(ids))
            place = model.places(a, b, ids, counts, below)  # rises with the triples
            cut = _starts(place)
            for x, y in zip(cut, np.append(cut[1:], len(n)), strict=True):
                yield int(place[x]), [ids[a[x:y]], ids[b[x:y]], ids[c[x:y]]], n[x:y]

        return each

    def finish_triples(shard, columns, counts):
        model = Model(spec)
        first, of = np.unique(columns[0], return_inverse=True)
        common.put_file(f"{folder}/trie-{shard}", build_shard(columns, counts, model.count_of(first)[of], model.v + 1))
        return {"shard": shard, "n": len(counts)}

    _merge(counting(count_triples), shards, 3, finish_triples, "shard int, n long")
    return spec


def score_texts(model: Model, texts: list[str]) -> dict:
    """n_tokens, n_known, base_score, score of each text."""
    h, lengths = tokens(texts)
    at, ids, counts, below = model.words(h)
    unigram = (counts + 1.0) / (model.n + model.v + 1.0)
    starts = np.cumsum(lengths) - lengths
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[starts] = len(ids) - 2
    # distinct pairs of known words, in order; -1 where one is unknown
    width = len(ids)
    keys, pair = np.unique(before * width + at, return_inverse=True)
    first, second = keys // width, keys % width
    share = np.zeros(len(keys))
    node, n_pair = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
    known = np.flatnonzero((ids[first] >= 0) & (ids[second] >= 0))
    place = np.full(len(keys), -1, np.int64)
    place[known] = model.places(first[known], second[known], ids, counts, below)
    for s, rows in _by_shard(place[known]):
        if (shard := model.shard(s)) is None:
            continue
        rows = known[rows]
        context = ids[first[rows]] - shard.first
        rows = rows[(context >= 0) & (context < shard.words.pointers.n - 1)]
        found = shard.words.find(ids[first[rows]] - shard.first, ids[second[rows]])
        rows, found = rows[found >= 0], found[found >= 0]
        share[rows], node[rows], n_pair[rows] = shard.words.book[shard.words.codes[found]], found, COUNT_OF[shard.counts[found]]
    n_first = counts[before]
    p = share[pair] + WORD / (n_first + WORD) * unigram[at]
    # third words: each token but the first of a text, after the pair before it
    later = np.ones(len(at), bool)
    later[starts] = False
    i = np.flatnonzero(later)
    back = pair[i - 1]
    i, back = i[node[back] >= 0], back[node[back] >= 0]
    p[i] *= PAIR / (n_pair[back] + PAIR)
    keys, of = np.unique(back * width + at[i], return_inverse=True)
    back, third = keys // width, keys % width
    share = np.zeros(len(keys))
    known = np.flatnonzero(ids[third] >= 0)
    for s, rows in _by_shard(place[back[known]]):
        shard = model.shard(s)
        rows = known[rows]
        found = shard.pairs.find(node[back[rows]], ids[third[rows]])
        rows, found = rows[found >= 0], found[found >= 0]
        share[rows] = shard.pairs.book[shard.pairs.codes[found]]
    p[i] += share[of]
    return {"n_tokens": lengths, "n_known": np.add.reduceat((counts[at] > 0).astype(np.int64), starts), "base_score": np.add.reduceat(np.log10(unigram[at]), starts), "score": np.add.reduceat(np.log10(p), starts)}


def score_documents(docs: DataFrame, folder: str, modulus: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    The model learns from all whole texts of which crc32(doc_id as text) modulo modulus is not fold. A null text is empty: its only token is the
    end. A null doc_id counts as the empty text in the fold. Texts of any length are counted and scored whole, each in one task. Repeated rows count and are
    scored as often as they occur. With an empty training fold every word is unknown and all scores follow from N = V = 0. An empty table gives no rows;
    other columns are ignored.
    """
    held = common.crc32_bucket(docs["doc_id"], modulus) == fold
    spec = train(docs.where(~held), folder)
    n = spec[0][2]
    plain = docs.select(docs["doc_id"].alias("doc_id"), held.alias("held_out"), common.text_of(docs).alias("text"))

    def make():
        model = Model(spec)

        def each(batch):
            ids, fold_of, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in common.slices(texts, CHARS):
                yield {"doc_id": ids.slice(a, b - a), "held_out": fold_of.slice(a, b - a), "train_tokens": np.full(b - a, n)} | score_texts(model, texts[a:b])

        return each

    return common.arrow_map(plain, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
