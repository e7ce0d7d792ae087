"""Near-duplicate documents: weighted minhash of multisets of shingles by hierarchical Poisson processes, bands, and exact checks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Signature components, and rows a band: 16 bands of 4 miss a pair of similarity 0.8 with chance 2e-4.
COMPONENTS = 64
ROWS = 4
#: Least agreement of two signatures, of COMPONENTS, before texts are compared: a pair of similarity 0.8 has less with chance 4e-7.
AGREE = 34
#: Members compared with one copy of a leader, and rows of a bucket held at once.
SALT = 512
BLOCK = 4096

_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct shingle of each text: the text's place, a 64-bit hash, and how often it occurs. Shingles are five
    lower-case words between ASCII white space; a text of one to four words is one shingle."""
    words = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((x for w in words for x in map(digest, w)), np.uint64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        padded = np.concatenate([h, np.zeros(SHINGLE - 1, np.uint64)])
        last = np.cumsum(lengths)[doc]  # where the text of each word ends
        joined = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            part = padded[k : k + len(h)]
            joined = joined * np.uint64(0x100000001B3) + np.where(np.arange(len(h)) + k < last, part, np.uint64(0)) + np.uint64(1)
        joined = _mix(joined)
    first = np.arange(len(h)) == (last - lengths[doc])
    whole = (np.arange(len(h)) + SHINGLE <= last) | first & (lengths[doc] < SHINGLE)
    doc, joined = doc[whole], joined[whole]
    order = np.lexsort((joined, doc))
    doc, joined = doc[order], joined[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (joined[1:] != joined[:-1])
    at = np.flatnonzero(new)
    return doc[at], joined[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures, n rows of m uint32; equal components are as likely as the weighted Jaccard similarity.

    The weights of an element, levels 0, 1, ..., lie in dyadic intervals [0,1), [1,2), [2,4), ...; each interval has a Poisson process of
    rate m times its length, whose points are drawn in order of time from hashes of element and interval. A point falls into a component
    and, by further halving of its interval, on a level, and counts if that is below the weight. Points are drawn up to a time by
    which most signatures are full; for the rest it is doubled. A component keeps its earliest point.
    """
    out = np.zeros((n, m), np.uint32)
    total = np.bincount(doc, weight, n)
    todo = total > 0
    reach = np.where(todo, (math.log(m) + 3) / np.maximum(total, 1), 0.0)
    while todo.any():
        take = todo[doc]
        d0, h0, w0 = doc[take], h[take], weight[take].astype(np.int64)
        parts, low, j = [], 0, 0
        while True:
            has = w0 > low
            if not has.any():
                break
            size = 1 if low == 0 else low
            with np.errstate(over="ignore"):
                seeds = _mix(h0[has] + _G * np.uint64(j + 1))
            parts.append((d0[has], seeds, w0[has], np.full(int(has.sum()), low), np.full(int(has.sum()), float(size))))
            low, j = low + size, j + 1
        d, seed, w, low_of, size_of = (np.concatenate(x) for x in zip(*parts, strict=True))
        t, k = np.zeros(len(d)), 0
        cells, times, values = [], [], []
        while len(d):
            with np.errstate(over="ignore"):
                r = _mix(seed + _G * np.uint64(2 * k + 1))
                q = _mix(seed + _G * np.uint64(2 * k + 2))
            t = t - np.log(((r >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / (m * size_of)
            alive = t <= reach[d]
            d, seed, w, low_of, size_of, t, q = d[alive], seed[alive], w[alive], low_of[alive], size_of[alive], t[alive], q[alive]
            level = low_of + np.floor((q >> np.uint64(40)).astype(float) / 2.0**24 * size_of).astype(np.int64)
            hit = level < w
            cells.append(d[hit] * m + (q[hit] & np.uint64(0xFFFF)).astype(np.int64) % m)
            times.append(t[hit])
            values.append((_mix(q[hit]) >> np.uint64(32)).astype(np.uint32))
            k += 1
        cell, time, value = np.concatenate(cells), np.concatenate(times), np.concatenate(values)
        order = np.lexsort((time, cell))
        cell, value = cell[order], value[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, value = cell[first], value[first]
        full = np.bincount(cell // m, minlength=n) == m
        keep = full[cell // m]
        out.reshape(-1)[cell[keep]] = value[keep]
        todo &= ~full
        reach *= 2
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, m = signature.shape
    rows = signature.reshape(n, m // ROWS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_mix(np.arange(1, m // ROWS + 1, dtype=np.uint64) * _G), (n, m // ROWS)).copy()
        for k in range(ROWS):
            key = _mix(key * np.uint64(31) + rows[:, :, k] + np.uint64(k + 1))
    return key.view(np.int64)


def _class_key(h: np.ndarray, w: np.ndarray) -> bytes | None:
    """128 bits that stand for a multiset; null for an empty one."""
    return hashlib.md5(h.tobytes() + w.tobytes()).digest() if len(h) else None


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, t (digest of the text), key (digest of the multiset, null without words), bands, sig of each row."""

    def make():
        import pyarrow as pa

        def each(batch):
            ids, ts, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in common.slices(texts):
                doc, h, w = shingles(texts[a:b])
                sig = signatures(doc, h, w, b - a)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                keys = [_class_key(h[x:y], w[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                bands = bands_of(sig)
                yield {"doc_id": ids.slice(a, b - a), "t": ts.slice(a, b - a), "key": keys, "bands": pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1))), "sig": [s.tobytes() for s in sig]}

        return each

    text = common.text_of(docs)
    return common.arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")), make, "doc_id long, t long, key binary, bands array<long>, sig binary", tidy=True)


def _bits(needed: DataFrame) -> np.ndarray:
    """A bit map of at most 2**24 bits in which the bit of every t is set; it only spares work, so further bits set do no harm."""
    size = int(min(max(16 * needed.count(), 1 << 16), 1 << 24))
    words = needed.select(F.expr(f"pmod(t, {size}L) div 64").alias("i"), F.expr(f"shiftleft(1L, cast(pmod(t, {size}L) % 64 AS INT))").alias("w"))
    out = np.zeros(-(-size // 64), np.int64)
    for r in words.groupBy("i").agg(F.bit_or("w").alias("w")).toLocalIterator():
        out[r["i"]] = r["w"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:size]


def _blobs(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """key, blob (distinct shingle hashes as uint32 in order, then their counts) of the classes needed(key, t). Texts stay where they are read: those
    that a bit map of t lets through are cut into shingles there."""
    text = common.text_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(_bits(needed.select("t")))

    def make():
        bits = sent.value

        def each(batch):
            picked = np.flatnonzero(bits[np.asarray(batch.column(0)) % len(bits)])
            texts = batch.column(1).take(picked).to_pylist()
            for a, b in common.slices(texts):
                doc, h, w = shingles(texts[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                keys, blobs = [], []
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    if x < y:
                        short, at = np.unique((h[x:y] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                        keys.append(_class_key(h[x:y], w[x:y]))
                        blobs.append(short.tobytes() + np.bincount(at, w[x:y], len(short)).astype(np.uint32).tobytes())
                yield {"key": keys, "blob": blobs}

        return each

    found = common.arrow_map(docs.select(F.xxhash64(text).alias("t"), text.alias("text")), make, "key binary, blob binary", tidy=True).join(needed.select("key"), "key", "left_semi")
    one = found.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("blob"))).where("copy = 1")
    return common.materialise(one.select("key", "blob"), "shingles")


def similarity(one: bytes, two: bytes) -> float:
    """Weighted Jaccard similarity of two blobs."""
    (a, x), (b, y) = (np.frombuffer(s, np.uint32).reshape(2, -1) for s in (one, two))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    common_weight = int(np.minimum(x[same], y[at[same]]).sum(dtype=np.int64))
    return common_weight / (int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64)) - common_weight)


def _verified(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough. Members b come to copies of their leader a, SALT to a copy, in
    sorted streams, so that one leader's members never form one group."""
    pairs = common.materialise(pairs, "pairs")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.col("n")).cast("int")
    members = pairs.join(copies, "a").select("a", "b", salt.alias("salt")).join(blobs.withColumnRenamed("key", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "blob")
    leaders = copies.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt")).join(blobs, "key").select(F.col("key").alias("a"), "salt", F.lit(0).alias("kind"), F.col("key").alias("b"), "blob")

    def check(batches):
        import pyarrow as pa

        now, lead = None, b""
        for batch in batches:
            a, b = [], []
            for x, s, kind, y, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == 0:
                    now, lead = (x, s), blob
                elif (x, s) == now and similarity(lead, blob) >= THRESHOLD:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
        common.release()

    stream = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    links = common.materialise(stream.mapInArrow(check, "a binary, b binary"), "links")
    common.discard(pairs)
    return links


def _join_rest(sig: np.ndarray, blobs: list[bytes], comp: np.ndarray, side: np.ndarray, cross: bool):
    """Links found between rows of different components of one bucket: every pair whose signatures agree in AGREE components is checked, unless a link found
    before has joined its components. First each row tries its best partner, which joins most; then what is left is tried in order of agreement. cross: only pairs across sides."""
    _, own = np.unique(comp, return_inverse=True)
    tried: set[tuple[int, int]] = set()
    rows = np.flatnonzero(own != np.bincount(own).argmax())  # each pair across components has an end outside the largest
    for best_only in (True, False):
        for i in rows:
            rest = np.flatnonzero((own != own[i]) & ((side != side[i]) if cross else True))
            if not len(rest):
                continue
            agree = (sig[rest] == sig[i]).sum(1)
            rest, agree = rest[agree >= AGREE], agree[agree >= AGREE]
            order = np.argsort(-agree, kind="stable")
            for j in rest[order[:1] if best_only else order].tolist():
                pair = (min(i, j), max(i, j))
                if pair in tried or own[j] == own[i]:
                    continue
                if best_only:
                    tried.add(pair)
                if similarity(blobs[i], blobs[j]) >= THRESHOLD:
                    own[own == own[j]] = own[i]
                    yield int(i), j


def _left_over(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Links (a, b) across components of a bucket, from rows(band, key, comp, sig). Buckets of more than BLOCK rows are compared block by block; only links leave a task."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    placed = rows.join(sizes, "band").join(blobs, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    spread = placed.withColumn("other", other).select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "comp", "sig", "blob")

    def stream(batches):
        import pyarrow as pa

        now, group = None, ([], [], [], [], [])

        def out():
            block, key, comp, sig, found = group
            links = list(_join_rest(np.stack([np.frombuffer(s, np.uint32) for s in sig]), found, np.array(comp), np.array(block), now[1] != now[2])) if len(set(comp)) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([key[i] for i, _ in links], pa.binary()), "b": pa.array([key[j] for _, j in links], pa.binary())})

        for batch in batches:
            for band, lo, hi, *rest in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (band, lo, hi) != now:
                    if now:
                        yield out()
                    now, group = (band, lo, hi), ([], [], [], [], [])
                for column, value in zip(group, rest, strict=True):
                    column.append(value)
        if now:
            yield out()
        group = None
        common.release()

    return spread.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(stream, "a binary, b binary")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows of docs, and comp of each key that is linked to another."""
    signed = common.materialise(_signed(docs), "signatures")
    one = Window.partitionBy("key").orderBy("t")
    classes = signed.where("key is not null").select("key", "t", "bands").withColumn("n", F.row_number().over(one)).where("n = 1").select("key", "t", "bands")
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "leader")
    banded = common.materialise(banded.join(buckets, "band"), "buckets")
    needed = common.materialise(signed.select("key", "t").join(banded.select("key").distinct(), "key").groupBy("key").agg(F.min("t").alias("t")), "needed")
    blobs = _blobs(docs, needed)
    tried = banded.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    links = _verified(tried, blobs)
    comps = common.materialise(components(links), "components")
    placed = banded.select("band", "key").join(comps, "key", "left").select("band", "key", F.coalesce("comp", "key").alias("comp"))
    placed = common.materialise(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    sigs = signed.where("key is not null").select("key", "sig").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("sig"))).where("n = 1").select("key", "sig")
    more = common.materialise(_left_over(placed.join(mixed, "band").join(sigs, "key"), blobs), "more-links")
    if not more.isEmpty():
        old, comps = comps, common.materialise(components(links.unionByName(more)), "components")
        common.discard(old)
    common.discard(banded, needed, blobs, links, placed, more)
    return signed, comps


def _first(doc_id: Column, t: Column) -> Column:
    return F.min(F.struct(doc_id.isNull().alias("missing"), doc_id.alias("doc_id"), t.alias("t")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, t, class_id, first (the class's first row by doc_id and digest) of every row of docs(doc_id, text).

    Documents are in a class if a chain of weighted Jaccard similarities of at least 0.8 over five-word shingles joins them. class_id is the
    least doc_id of the class. A text without words (null, empty, white space) is in a class of its own; so each such row has its own doc_id.
    Repeated rows are in one class; an empty table gives no rows; other columns are ignored. Shingles are told apart by 64-bit hashes in
    signatures and by 32-bit ones in checks. Each bucket of a band links its members to one leader, and those links are
    checked; what is then left in different components of one bucket is compared by signatures, and what agrees in AGREE of COMPONENTS is checked. A link of similarity 0.8
    exactly is missed with chance 2.2e-4 by the bands and 4e-7 by AGREE, which fall quickly above 0.8.
    """
    signed, comps = _labelled(docs)
    rows = signed.select("doc_id", "t", "key").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    rows = common.materialise(rows.select("doc_id", "t", "comp"), "classes")
    common.discard(signed, comps)
    firsts = rows.where("comp is not null").groupBy("comp").agg(_first(F.col("doc_id"), F.col("t")).alias("first"))
    own = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("t").alias("t"))
    return rows.join(firsts, "comp", "left").select("doc_id", "t", F.coalesce(F.col("first"), own).alias("first")).select("doc_id", "t", F.col("first.doc_id").alias("class_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, keep (the document that stands for its class) of every row; see classes()."""
    found = classes(docs)
    return found.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("first.t"))).alias("keep"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each class: that of the least doc_id, null last, then of the least digests of text and row. Rows
    without words (null, empty, white space) all stay; of repeated rows one stays; an empty table gives no rows; column names don't matter."""
    stands = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("first.t"))
    same = classes(docs).groupBy("doc_id", "t").agg(F.bool_or(stands).alias("stands"), F.count(F.lit(1)).alias("n"))
    doubtful = same.where("not stands or n > 1").select(F.col("doc_id").alias("doubt_id"), F.col("t").alias("doubt_t"), "stands", F.xxhash64("doc_id", "t").alias("mark"))
    doubtful = common.materialise(doubtful, "doubtful")
    sent = docs.sparkSession.sparkContext.broadcast(_bits(doubtful.select(F.col("mark").alias("t"))))

    @F.pandas_udf("boolean")
    def marked(marks):
        bits = sent.value
        return type(marks)(bits[marks.to_numpy() % len(bits)].astype(bool))

    text = common.text_of(docs)
    # rows that stay whatever the others are need no shuffle; the bit map lets some of them through to the join besides those in doubt
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("t"), text.rlike(common.WORD).alias("words"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("digest"))
    packed = packed.withColumn("marked", marked(F.xxhash64("id", "t")))
    some = packed.where("marked").join(doubtful, F.col("id").eqNullSafe(F.col("doubt_id")) & (F.col("t") == F.col("doubt_t")), "left").where("stands is null or stands")
    copy = F.row_number().over(Window.partitionBy("id", "t").orderBy("digest"))
    some = some.withColumn("copy", F.when(F.col("stands") & F.col("words"), copy).otherwise(1)).where("copy = 1")
    return packed.where("not marked").select("row.*").unionByName(some.select("row.*"))
