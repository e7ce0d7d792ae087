"""Token ids in files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Block file: b"SLTB1\\n", four little-endian int64 (documents, ids, control bytes, data bytes), doc_id int64 each, a byte each that
is 1 where doc_id is null, ids of each document int64, then control bytes (four 2-bit lengths minus one, lowest first) and data
bytes (ranks, little-endian). The table that turns ranks into ids is one file beside the blocks.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.encoders import encoder

MAGIC = b"SLTB1\n"
#: Documents a shard, which one task sorts.
SHARD = 200_000
#: For each control byte the lengths of its four numbers.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers. The last control byte is filled up with ones of length 1 that have no data."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    if not len(ranks):
        return b"", b""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    kept = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[kept]
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = extra
    quads = quads.reshape(-1, 4)
    return (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths from the table by control byte, places by a running sum, bytes gathered by place."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(uri: str, ids: list[int | None], counts: list[int], ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    head = np.array([len(ids), len(ranks), len(control), len(data)], "<i8")
    common.put_file(uri, [MAGIC, head.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), np.array(counts, "<i8").tobytes(), control, data])


def read_block(uri: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids a document, ranks."""
    raw = common.get_file(uri)
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{uri} is not a token block")
    at = len(MAGIC)
    n, n_ids, n_control, n_data = np.frombuffer(raw, "<i8", 4, at)
    at += 32
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    null = raw[at + 8 * n : at + 9 * n]
    counts = np.frombuffer(raw, "<i8", n, at + 9 * n)
    at += 17 * n
    ranks = unpack(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], int(n_ids))
    return [None if z else i for i, z in zip(ids, null, strict=True)], counts, ranks


def encode_to_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, shards: int | None = None, block_ids: int = 8_000_000) -> DataFrame:
    """Encode docs(doc_id, text) and write block files below folder, in ascending doc_id order (null first, equal ids by content).

    Returns the manifest (shard, first, path, n_docs, n_ids, start, ranks): one row a block. A null text is empty and holds the end id
    only; rows with equal ids stay rows; an empty table writes no block. Ids rank by frequency over all documents; the table is
    bounded by the vocabulary. Encoded ids are shuffled once by ranges of doc_id, and stored so that they are encoded once.
    """
    spark = docs.sparkSession
    folder = common.qualified(spark, folder)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD))
    at = [k / shards for k in range(1, shards)] or [0.5]
    bounds = docs.agg(F.percentile_approx(docs["doc_id"].cast("long"), at, max(10_000, 20 * shards)).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, np.int64))

    def make():
        import pyarrow as pa

        coder = encoder(tokenizer_path)

        def each(batch):
            ids, texts = batch.column(0), batch.column(1)
            shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "left"))
            for a, b in common.byte_slices(common.flat(texts)[1]):
                codes, counts = coder.encode_arrow(texts.slice(a, b - a))
                if end_id is not None:
                    codes, counts = np.insert(codes, np.cumsum(counts), end_id), counts + 1
                places = np.concatenate([[0], np.cumsum(counts)]) * coder.dtype.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(places), pa.py_buffer(codes)])
                yield {"shard": shard[a:b], "doc_id": ids.slice(a, b - a), "ids": packed}

        return each

    encoded = common.arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")), make, "shard int, doc_id long, ids binary")
    stored = common.materialise(encoded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids"), "token-ids", codec="zstd")
    dtype, vocabulary = encoder(tokenizer_path).dtype, 1 << 16

    def histogram(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            codes = common.flat(batch.column(0))[0].view(dtype)
            for a in range(0, len(codes), 1 << 20):  # many documents a count, each of which fills an array of the vocabulary's size
                n = np.bincount(codes[a : a + (1 << 20)])
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    counts = stored.select("ids").mapInArrow(histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], "<u4")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = f"{folder}/ranks.u4"
    common.put_file(table, [by_rank.tobytes()])

    def blocks(batches):
        import pyarrow as pa

        shard, ids, codes, size, seq, place = None, [], [], 0, 0, 0

        def flush():
            path = f"{folder}/block-{uuid.uuid4().hex}.sltb"
            write_block(path, ids, [len(c) // dtype.itemsize for c in codes], rank_of[np.frombuffer(b"".join(codes), dtype)])
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "first": pa.array([ids[0]], pa.int64()), "place": pa.array([place], pa.int64()), "seq": pa.array([seq], pa.int64()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([size], pa.int64())})

        for batch in batches:
            for s, i, c, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (s != shard or at != place or size >= block_ids):
                    yield flush()
                    ids, codes, size, seq = [], [], 0, seq + 1
                shard, place = s, at
                ids.append(i)
                codes.append(c)
                size += len(c) // dtype.itemsize
        if ids:
            yield flush()

    # a shard is one file in order; tasks read it in ranges, whose places and running numbers keep that order
    ranges = stored.select("shard", "doc_id", "ids", F.col("_metadata.file_block_start").alias("place"))
    manifest = common.materialise(ranges.mapInArrow(blocks, "shard int, first long, place long, seq long, path string, n_docs long, n_ids long"), "token-manifest")
    total = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", F.coalesce(total, F.lit(0)).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("place", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "shard").select("shard", "first", "path", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start"), F.lit(table).alias("ranks"))


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the block files of a manifest."""

    def make():
        def each(batch):
            for path, start, table in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                by_rank = np.frombuffer(common.get_file(table), "<u4")
                ids, counts, ranks = read_block(path)
                values = by_rank[ranks].astype("<u4")
                ends = np.cumsum(counts)
                yield {"doc_id": ids, "start": start + ends - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(values[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]}

        return each

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.arrow_map(manifest.select("path", "start", "ranks").repartition(n), make, "doc_id long, start long, n_tokens long, ids_crc32 long")
