"""Token counts, binary ids and byte-level BPE against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from sightline.llm import common, token_binary, token_counts  # noqa: E402
from sightline.llm.byte_bpe import ByteBpe, PerfectHash, encode_documents, round_trip  # noqa: E402
from sightline.llm.encoders import WordEncoder, encoder  # noqa: E402

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n", "a", "A  b\t\tc\r\n d ", "it's they'll DON'T 'S", "naïve Café, Ünïcode. é é́.", "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>", "日本語 テキスト。", "a b c \x1c d\x85e", "x" * 3000 + " " + "é" * 900, "1234 5,6. ...,, a,. b..", "İstanbul ẞ ß ﬁ ǅ", "\x01 a\x01b", "emoji 👩‍👩‍👧‍👦 ok", "tail \n", "a.b, c.,d word, Word. WORD", " lead", "two  spaces\n \nend"]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab é.,'\n\t 1<|>世X") for _ in range(rng.randrange(120))) for _ in range(300)]


def table(spark, rows=None):
    rows = list(enumerate(texts())) + [(5000, None), (None, "no id"), (7, "again"), (7, "again")] if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, shard long")


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts(), add_special_tokens=False)]
    for limit in (2, 100_000):
        e = WordEncoder(WORD, limit)
        assert e.by_chunk
        for _ in range(2):
            got = [np.frombuffer(b, e.dtype).tolist() for t in texts() for b in e.encode([t])]
            assert got == want


def test_counts(spark, tmp_path):
    docs = table(spark)
    path = f"file://{tmp_path}/cache"
    first = token_counts.count_tokens(docs, WORD, path, limit=20).collect()
    stored = token_counts.read_cache(spark, path).count()
    again = token_counts.count_tokens(docs, WORD, path, limit=20).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == docs.count()
    assert token_counts.read_cache(spark, path).count() == stored  # no miss, nothing appended
    e = encoder(WORD)
    for r, t in ((r, dict(enumerate(texts())).get(r["doc_id"])) for r in first):
        if t is not None and r["doc_id"] != 7:
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), e.count([t])[0], e.count([t])[0] > 20)
    empty = [r for r in first if r["doc_id"] == 5000][0]
    assert (empty["n_bytes"], empty["n_tokens"]) == (0, 0)
    assert token_counts.count_tokens(docs.limit(0), WORD, path + "2").count() == 0


def test_counts_stored_twice(spark, tmp_path):
    """Two runs that store one content at once don't double rows."""
    path, docs = f"file://{tmp_path}/cache", table(spark, [(1, "one two"), (2, "one two"), (3, None)])
    first = sorted(map(str, token_counts.count_tokens(docs, WORD, path).collect()))
    token_counts.read_cache(spark, path).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)
    assert sorted(map(str, token_counts.count_tokens(docs, WORD, path).collect())) == first and len(first) == 3


def test_long_chunks_leave_the_memo():
    e, b = WordEncoder(WORD), ByteBpe(RANKS, P.PATTERN)
    for t in ("x" * 5000 + " short", "é" * 3000, "ab" * 2000 + "."):
        e.encode([t])
        b.encode([t])
    assert max(map(len, [*e.memo, *e.old])) <= 256 and max(map(len, [*b.memo, *b.old])) <= 256


@pytest.mark.parametrize("block", [1, 7, 40, 8_000_000])
def test_starts_ascend(spark, block):
    """Null and repeated ids over several blocks: starts follow the order of ids."""
    rows = [(None, f"word {i} " * (i % 5 + 1)) for i in range(30)] + [(5, f"again {i}") for i in range(30)] + [(i, "x y") for i in range(6, 12)]
    got = token_binary.read_files(token_binary.encode_to_files(table(spark, rows), WORD, common.shared_path(spark, "blocks"), shards=3, block_ids=block)).collect()
    got = sorted(got, key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist() and len(got) == len(rows)


def test_piece_counts(spark, tmp_path):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = token_counts.count_tokens(table(spark, list(enumerate(ODD))), model, f"file://{tmp_path}/cache").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(sp.encode(t)) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("top", [1, 200, 70_000, 2**32 - 1])
def test_pack_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, top, n, np.uint32, endpoint=True)
        control, data = token_binary.pack(x)
        assert len(control) == -(-n // 4)
        assert np.array_equal(token_binary.unpack(control, data, n), x)


def test_files(spark):
    docs = table(spark)
    manifest = token_binary.encode_to_files(docs, WORD, common.shared_path(spark, "blocks"), end_id=2, shards=3, block_ids=500)
    got = token_binary.read_files(manifest).collect()
    assert manifest.count() > 3 and len(got) == docs.count()
    e, at = encoder(WORD), 0
    rows = [(i, t) for i, t in [*enumerate(texts()), (5000, "")]]
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 7)}
    for i, t in rows:
        if i != 7:
            ids = np.append(np.frombuffer(e.encode([t])[0], e.dtype), 2).astype("<u4")
            assert (by_id[i]["n_tokens"], by_id[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert token_binary.read_files(token_binary.encode_to_files(docs.limit(0), WORD, common.shared_path(spark, "blocks"))).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h = PerfectHash(keys)
    assert h.size == 5000 and sorted(h.lookup(keys)) == list(range(5000))
    assert h.lookup(np.array([1, 2, 3], np.uint64)).max() < 5000


def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_library(spark):
    enc = tiktoken_encoding()
    for limit in (4, 100_000):
        coder = ByteBpe(RANKS, P.PATTERN, limit)
        for _ in range(2):
            for t in texts():
                ids = coder.encode([t])[0]
                assert ids.tolist() == enc.encode_ordinary(t)
                assert coder.decode(ids) == t.encode()
    rows = round_trip(table(spark), RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts()) + 4
    for r in rows:
        t = "" if r["doc_id"] == 5000 else dict(enumerate(texts())).get(r["doc_id"])
        if t is not None and r["doc_id"] != 7:
            ids = enc.encode_ordinary(t)
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert round_trip(table(spark).limit(0), RANKS, P.PATTERN).count() == 0
    some = {r["doc_id"]: r["ids"] for r in encode_documents(table(spark, list(enumerate(ODD))), RANKS, P.PATTERN).collect()}
    assert some == {i: enc.encode_ordinary(t) for i, t in enumerate(ODD)}
