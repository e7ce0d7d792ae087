"""What a worker keeps between tasks."""

import public_tokenizers
from sightline.llm import byte_bpe as B
from sightline.llm import toxicity as T


def test_a_stage_forgets_its_pretokens(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(i, f"word{i} other{i * 7} is here") for i in range(300)], "doc_id long, text string")
    made = {}

    def held(docs, make, schema, tidy=False):  # the mapping of a task, run here
        import pyarrow as pa

        each = make()
        out = [c for c in each(pa.record_batch(docs.toPandas()))]
        getattr(each, "done", lambda: None)()
        made["rows"] = sum(len(c["n_tokens"]) for c in out)
        return docs

    plain = {r["doc_id"]: r for r in B.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    small = {r["doc_id"]: r for r in B.round_trip(docs, path, public_tokenizers.PATTERN, memo=100).collect()}
    assert plain == small and len(small) == 300
    monkeypatch.setattr(B.common, "arrow_map", held)
    B.round_trip(docs, path, public_tokenizers.PATTERN, memo=100)
    coder = B.byte_bpe(path, public_tokenizers.PATTERN, 100)
    assert made["rows"] == 300 and not coder.memo and not coder.old


def test_rejecting_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, f"awful text {i}" if i % 4 == 0 else f"plain words {i}" if i % 9 else None) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    kept = T.reject_toxic(docs, labels)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each such node of a task has a worker of its own
    scores = {r["doc_id"]: r["score"] for r in T.detect(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in scores.items() if s < 0.5) and 0 < kept.count() < 600


def test_chunks_are_looked_up_once():
    """No sets of a text's chunks are made beside the memo, and a memo that is too small gives the same ids."""
    import collections
    import sys

    from sightline.llm.encoders import WordEncoder

    texts = [f"Word{i} other, plain. {'x' * 300} \tit's {i} naïve 世界 <|endoftext|>\n" + " ".join("abcdefgh"[k % 8 :] + "ijk"[: k % 3] for k in range(i, i + 30)) for i in range(40)] + ["", " ", ". ,"]
    coder, small = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), WordEncoder(public_tokenizers.path("word_bpe_49k.json"), memo=20)
    want = coder._library(texts)
    assert coder.encode(texts) == want and small.encode(texts + texts) == want + want
    calls = collections.Counter()
    sys.setprofile(lambda _, event, what: calls.update([what.__name__]) if event == "c_call" else None)
    try:
        again = coder.encode(texts)
    finally:
        sys.setprofile(None)
    assert again == want and "difference" not in calls and max(map(len, coder.memo)) <= 256


def test_repeated_chunks_are_looked_up_once():
    """A chunk that texts repeat costs one look at the memo a slice of texts, not one a word; punctuation that ends a word is not learnt with it."""
    from sightline.llm.encoders import WordEncoder

    coder, looks = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []

    class Counting(type(coder.memo)):
        def __getitem__(self, chunk):
            looks.append(chunk)
            return super().__getitem__(chunk)

    coder.memo = Counting(coder._learn)
    texts = ["one two, three*** TWO one. two!! three\n"] * 500
    assert coder.encode(texts) == coder._library(texts)
    assert sorted(looks) == sorted(["one", "two", "three", "TWO", ",", "***", ".", "!!"])


def test_punctuation_apart_is_the_library():
    import random

    import pyarrow as pa

    from sightline.llm.encoders import WordEncoder

    coder, rng = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    parts = ["a", "Bc", "é", "é", "́", "̸", "×", "÷", "ß", "ȷ", "ʰ", "ⱥ", "—", "7", "²", "世", "'", "'s", "''S", "t", ".", ",", "!!", "***", "|", "<", ">", "|>.", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "$$$$$$$$", "!" * 30, " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "\x01", "ﬁ", "İ", "Σ"]
    texts = [a + b for a in parts for b in parts] + ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(4000)]
    want = coder._library(texts)
    assert coder.encode(texts) == want
    column = pa.array([None, "skipped.", *texts, None]).slice(2)  # a slice whose values begin inside the buffers, with a null
    ids, counts = coder.encode_arrow(column)
    assert ids.tobytes() == b"".join(want) and counts.tolist() == [*(len(x) // 2 for x in want), 0]
