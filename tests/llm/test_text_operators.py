"""Toxicity, quality, mixing, near-duplicates, language model and archives on small tables."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from sightline.llm import bag_minhash as B
from sightline.llm import common, lm_scoring, mixing, toxicity, warc
from sightline.llm.elias_fano import EliasFano
from sightline.llm.host_quality import judge, keep_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, m long, hash string, size string, t string, row string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 0, "k", 1, "h", "z", "t", "r") for i, t, s in rows], SCHEMA)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


# ---- quality

def brute_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


QUALITY = ["", None, " \n\t ", "a b c d e", words(40), " ".join(["a b c d e"] * 4), "x y z w v u\nx y z w v u\n\nx y z w v u", "#$ % & one two three 世界 * | < >\n" * 3, "a a a a a a a", words(3000) + " " + words(3000), "\x1c a\x0bb\x0cc"]


def test_quality_measures(spark):
    rows = [(i, t, ["s", None, "t"][i % 3]) for i, t in enumerate(QUALITY)] + [(3, "a b c d e", "s"), (None, words(20), "s")]
    got = judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            n, chars, symbols, dup, rep = brute_measures(QUALITY[r["doc_id"]] or "")
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
            assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
            assert not (r["kept"] and r["base_failed"])
    assert judge(frame(spark, rows).limit(0)).count() == 0


def test_bad_hosts_go_and_clean_ones_stay(spark):
    good = [(i, words(50, i), "good") for i in range(60)]
    bad = [(100 + i, "spam " * 40 if i % 10 else words(50, i), "bad") for i in range(60)]
    kept = {r["doc_id"] for r in keep_documents(frame(spark, good + bad)).collect()}
    assert kept == set(range(60))
    assert keep_documents(frame(spark, good)).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_quality_writes_no_texts(spark):
    """What the filter leaves in the shared folder is small beside the texts: it stayed until the pipeline's end."""
    from pathlib import Path

    folder = Path(common.shared_root(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    docs = [(i, words(1000, i), "ab"[i % 2]) for i in range(60)] + [(100, "spam " * 40, "a")]
    before = size()
    kept = keep_documents(frame(spark, docs))
    assert kept.count() == 60
    assert size() - before < 0.1 * sum(len(t) for _, t, _ in docs)


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_quality_filter_keeps_what_judge_keeps(spark, monkeypatch, bits):
    """Also where the bit map is full, so that kept rows are measured again."""
    from sightline.llm import host_quality

    monkeypatch.setattr(host_quality, "MARK_BITS", bits)
    rows = [(i, words(30 + i, i), ["s", None, "t", "bad"][i % 4]) for i in range(200)] + [(300 + i, "# " * 40 + words(40, i), "bad") for i in range(60)]
    rows += [(400 + i, t, ["s", None, "t"][i % 3]) for i, t in enumerate(QUALITY)] + [(3, words(33, 3), "bad"), (500, words(40), "s"), (501, words(40), "bad")]
    docs = frame(spark, rows)
    want = collections.Counter(r["doc_id"] for r in judge(docs).collect() if r["kept"])
    assert 100 < sum(want.values()) < len(rows) - 60
    assert collections.Counter(r["doc_id"] for r in keep_documents(docs).collect()) == want


# ---- mixing

def fill(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
            free.discard(s)
    return target


def test_repeated_rows_keep_to_targets(spark):
    """Rows without ids, and one row many times, are documents of their own: quotas hold among them."""
    rows = [(None, "w " * 20 + str(i), "a") for i in range(50)] + [(1, "v " * 30, "a")] * 40 + [(i, words(25, i), "b") for i in range(2, 90)]
    got = mixing.mix(frame(spark, rows)).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and len(target) == 2
    assert all(abs(taken[s] - target[s]) <= 15 for s in target)
    assert sum(len(r["text"].split()) for r in mixing.mixed_documents(frame(spark, rows)).collect()) == sum(taken.values())


def test_duals(spark):
    """The tilted rates against plain bisection of each source's words over its documents."""
    rng = np.random.default_rng(3)
    sizes = {"a": rng.integers(1, 80, 200), "b": rng.integers(1, 80, 300), "c": rng.integers(1, 20, 100)}
    groups = spark.createDataFrame([("s" + k, int(x), 1) for k, v in sizes.items() for x in v], "key string, size long, n long").groupBy("key", "size").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    sources = mixing.targets(groups)
    want = fill({k: int(v.sum()) for k, v in sizes.items()})
    mean = sum(v.sum() for v in sizes.values()) / sum(map(len, sizes.values()))
    for r in mixing.balance(groups, sources).collect():
        x = sizes[r["key"][1:]]
        words_at = lambda lam, x=x: float((np.minimum(3.0, np.exp(np.minimum(lam * x / mean, 2.0))) * x).sum())
        low, high = -100.0, 100.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words_at(mid) < want[r["key"][1:]] else (low, mid)
        assert words_at(r["lam"]) == pytest.approx(want[r["key"][1:]], rel=1e-6)
        assert r["lam"] == pytest.approx(high, abs=1e-4) or words_at(high) >= 3 * x.sum() - 1e-6


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = np.random.default_rng(seed)
    of = ["b", "a", None, "ä", "Z", ""]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), of[min(5, int(rng.geometric(0.45)) - 1)]) for i in range(700)] + [(800 + i, "w " * 17, "b") for i in range(400)] + [(2000, None, "a"), (None, "w w w", "a")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- near-duplicates

def brute_classes(rows):
    bags = {}
    for i, t, _ in rows:
        w = (t or "").lower().encode().split()
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(bags, 2):
        both = sum((bags[a] & bags[b]).values())
        if both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in bags}


def near_rows():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = words(120, 100 + g).split()
        for _ in range(8):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = "edit" + str(rng.integers(0, 10**6))
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(len(rows) + i, words(60, 500 + i), "s") for i in range(60)]
    n = len(rows)
    return rows + [(n, "", "s"), (n + 1, None, "s"), (n + 2, "one two", "s"), (n + 3, "One  two", "s"), (n + 4, "a b c d e " * 9, "s"), (n + 5, "a b c d e " * 10, "s"), (n + 6, words(9000, 9), "s"), (n + 7, words(9000, 9) + " more", "s")]


@pytest.mark.parametrize(("block", "salt"), [(4096, 512), (3, 2)])
def test_near_duplicates(spark, monkeypatch, block, salt):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "SALT", salt)
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_keep_one(spark):
    rows = near_rows()
    docs = frame(spark, [*rows, rows[0], (None, rows[0][1], "s")])
    kept = B.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(rows).values()))
    assert B.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = B.signatures(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


# ---- language model

def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (1, 10**9), (500, 3), (3000, 10**6), (2000, 2**45)):
        v = np.sort(rng.integers(0, top, n, endpoint=True))
        raw = np.frombuffer(b"x" * 8 + b"".join(p.tobytes() for p in EliasFano.build(v).parts()), np.uint8)
        e, end = EliasFano.view(raw, 8)
        assert end == len(raw) and np.array_equal(e.access(np.arange(n)), v)
        q = np.concatenate([v, v + 1])
        at = e.find(q, np.zeros(len(q), int), np.full(len(q), n))
        assert np.array_equal(at >= 0, np.isin(q, v)) and np.array_equal(v[at[at >= 0]], q[at >= 0])


def brute_lm(rows):
    """Base score and score of each row in plain dictionaries, without quantisation."""
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [split(t) for i, t, _ in rows if not held(i)]
    c = collections.Counter(w for ts in train for w in ts)
    pairs, of_first, threes = collections.Counter(), collections.Counter(), collections.Counter()
    for ts in train:
        for k, w in enumerate(ts):
            before = ts[k - 1] if k else "<s>"
            pairs[before, w] += 1
            of_first[before] += 1
            if k:
                threes[ts[k - 2] if k > 1 else "<s>", before, w] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t, _ in rows:
        base = score = 0.0
        ts = split(t)
        for k, w in enumerate(ts):
            p1 = (c[w] + 1) / (n + v + 1)
            b = ts[k - 1] if k else "<s>"
            p = (pairs[b, w] + lm_scoring.WORD * p1) / (of_first[b] + lm_scoring.WORD)
            a = ts[k - 2] if k > 1 else "<s>"
            if k and pairs[a, b]:
                p = (threes[a, b, w] + lm_scoring.PAIR * p) / (pairs[a, b] + lm_scoring.PAIR)
            base, score = base + math.log10(p1), score + math.log10(p)
        out.append((i, held(i), len(ts), sum(c[w] > 0 for w in ts), n, base, score))
    return out


@pytest.mark.parametrize("local", [21, 1])
def test_lm_scores(spark, monkeypatch, local):
    """Against brute force: shares are a code of 256 over their range in log10, so a token is off by 1/510 of it at most, and counts up to 128 are exact."""
    monkeypatch.setattr(lm_scoring, "LOCAL", local)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "a", "cat", "é", "dog,", "x" + str(i), "x" + str(i % 9)], 30)), "s") for i in range(120)]
    rows += [(500, "", "s"), (501, None, "s"), (None, "the cat", "s"), (3, "a\ta\x0ba", "s"), (502, "the cat a " * 3000, "s"), (7, rows[7][1], "s"), (7, rows[7][1], "s")]
    got = lm_scoring.score_documents(frame(spark, rows), common.shared_path(spark, "lm")).collect()
    want = sorted(brute_lm(rows), key=str)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(sorted(got, key=lambda x: str(x[:5]) + f"{x[5]:.3f}"), sorted(want, key=lambda x: str(x[:5]) + f"{x[5]:.3f}"), strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= 0.006 * w[2] + 1e-6
    assert lm_scoring.score_documents(frame(spark, rows[:1]).limit(0), common.shared_path(spark, "lm")).count() == 0
    alone = lm_scoring.score_documents(frame(spark, rows).where("crc32(cast(doc_id as string)) % 7 = 2"), common.shared_path(spark, "lm")).collect()
    assert alone and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in alone)


def test_sums_are_written_and_read():
    rng = np.random.default_rng(1)
    for top in (1, 9, 2**33):
        columns, counts = lm_scoring.add_up([rng.integers(0, top, 500, endpoint=True) for _ in range(3)], rng.integers(1, 2**35, 500))
        back, n = lm_scoring.read_sums(lm_scoring.write_sums(columns, counts), 3)
        assert all(np.array_equal(x, y) for x, y in zip(back, columns, strict=True)) and np.array_equal(n, counts)


def test_split_contexts():
    count, below = np.array([1000, 1000, 10]), np.array([0, 0, 1000])
    got = lm_scoring.shard_of(below, count, np.array([0, 99, 5]), 1010, 100, 10)
    assert got[0] == 0 and got[1] >= 8 and got[2] == 9
    huge = lm_scoring.shard_of(np.array([15 * 10**12]), np.array([10**12]), np.array([10**10]), 16 * 10**12, 10**10, 2_000_000)
    assert 0 <= huge[0] < 2_000_000


# ---- toxicity

def test_toxicity(spark):
    rng = np.random.default_rng(5)
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(1500):
        w = words(40, i).split()
        toxic = i % 6 == 0
        if toxic:
            for x in rng.choice(bad, 3):
                w.insert(int(rng.integers(0, 40)), x)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    docs = frame(spark, [*rows, (9000, None, "s"), (9001, "", "s"), (7, rows[7][1], "s")])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.detect(docs, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 1503 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    clean = {r["doc_id"] for r in toxicity.reject_toxic(docs, marks).collect()}
    assert clean == {r["doc_id"] for r in got if r["score"] < 0.5}
    none = toxicity.detect(docs, marks.where("toxic = 0")).collect()
    assert len({r["score"] for r in none}) == 1
    assert toxicity.reject_toxic(docs, marks).columns == docs.columns
    assert toxicity.detect(docs.limit(0), marks).count() == 0


def test_risk_and_gradient():
    """Sums and their gradient against a plain computation and finite differences, and training against the same steps on plain lists."""
    rng = np.random.default_rng(6)
    sets = [sorted(rng.choice(7, rng.integers(0, 6), replace=False).tolist()) for _ in range(40)]
    x = [np.array(s, np.int16).tobytes() for s in sets]
    n_p, n_u = rng.integers(0, 3, 40).astype(float), rng.integers(1, 4, 40).astype(float)
    w = rng.normal(size=8)

    def plain(w):
        out = np.zeros(3)
        for s, p, u in zip(sets, n_p, n_u, strict=True):
            z = sum(w[c] for c in s) + w[-1]
            out += [p * math.log1p(math.exp(-z)), p * math.log1p(math.exp(z)), u * math.log1p(math.exp(z))]
        return out

    risk, gradient = toxicity.risk_sums(x, n_p, n_u, w)
    assert risk == pytest.approx(plain(w))
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-6
        assert gradient[:, k] == pytest.approx((plain(w + step) - plain(w - step)) / 2e-6, abs=1e-4)
    prior = 0.3
    trained = toxicity.train(lambda v: toxicity.risk_sums(x, n_p, n_u, v), 7, n_p.sum(), n_u.sum(), prior)

    def objective(v):
        r = plain(v)
        return prior * r[0] / n_p.sum() + max(0, r[2] / n_u.sum() - prior * r[1] / n_p.sum())

    start = np.append(np.zeros(7), math.log(prior / (1 - prior)))
    assert objective(trained) < objective(start)


def test_threshold():
    found_p, found_u = np.zeros(2 * toxicity.MARGIN * toxicity.BINS), np.zeros(2 * toxicity.MARGIN * toxicity.BINS)
    found_p[4000:4100] = 1
    found_u[2000:2800] = 1
    found_u[4000:4100] = 1
    assert 2800 <= (toxicity.threshold(found_p, found_u, 1 / 9) + toxicity.MARGIN) * toxicity.BINS <= 4000


def test_toxicity_is_learnt_from_whole_texts(spark):
    rows = [(i, words(60, i) + " x" * 5_000 + (" idiot moron" if i % 5 == 0 else " fine"), "s") for i in range(400)]
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    docs = frame(spark, [*rows, rows[3], rows[5]])
    assert {"idiot", "moron"} <= set(toxicity.fit(docs, marks)["vocabulary"])
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in toxicity.detect(docs, marks).collect())


# ---- archives

def pages(spark):
    rows = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u\r\nX: y", ""), (9, "u", None), (5, "u", "WARC/1.1\r\n\r\n\n" * 3), (6, "u", "x" * 70_000), (7, "u", "line\nline\r\n"), (1, "again", "<p>é</p>")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")


def test_archives(spark):
    rows, df = pages(spark)
    got = warc.archive_round_trip(df, common.shared_path(spark, "archives")).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if first[h or ""] == i else "revisit", str(None if first[h or ""] == i else first[h or ""])) for i, _, h in rows)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == want
    assert warc.archive_round_trip(df.limit(0), common.shared_path(spark, "archives")).count() == 0


def test_long_url(spark):
    rows = [(1, "u" * 70_000, "a"), (2, "b " * 40_000, "WARC/1.1\r\n" * 3), (3, "u", "a"), (4, "é" * 1_000_000, "c")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), common.shared_path(spark, "archives")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in got) == [(1, 1, "response"), (2, 30, "response"), (3, 1, "revisit"), (4, 1, "response")]


def test_more_repeated_payloads_than_are_sent(spark, monkeypatch):
    rows, df = pages(spark)
    more = df.unionByName(spark.createDataFrame([(100 + i, "u", f"<p>{i // 3}</p>", "x") for i in range(60)], df.schema))
    key = lambda d: sorted(map(str, warc.archive_round_trip(d, common.shared_path(spark, "archives")).collect()))
    want = key(more)
    for sent, bits in ((1, 20), (3, 1)):
        monkeypatch.setattr(warc, "SENT", sent)
        monkeypatch.setattr(warc, "PREFIX_BITS", bits)
        assert key(more) == want


def test_members(spark, monkeypatch):
    """Ranges cover every byte of a file once and inner ranges what a member unpacks to; damage costs only what lies behind it in its member."""
    import gzip

    records = [r for r in archive(spark) if len(r) < 5000] * 3
    noise = b"junk" * 5
    for piece in (1 << 20, 300):
        monkeypatch.setattr(warc, "PIECE", piece)
        inside = records[0] + noise + b"".join(records[1:])
        whole = noise + gzip.compress(inside) + b"".join(records[:2])
        found = list(warc.salvage(memoryview(whole)))
        ranges = sorted({(a, n) for _, a, n, _ in found})
        assert sum(n for _, n in ranges) == len(whole) and all(a + n == b for (a, n), (b, _) in itertools.pairwise(ranges))
        assert [k for k, *_ in found] == ["gap", "record", "gap", *["record"] * (len(records) - 1), "record", "record"]
        assert [r["inner_length"] for _, a, _, r in found if isinstance(r, dict) and a == len(noise)] == list(map(len, records))
        member = gzip.compress(inside, 0)
        cut = list(warc.salvage(member[: len(member) - len(records[-1]) // 2] + records[0]))
        assert sum(k == "record" for k, *_ in cut) == len(records) - 1 + 1
        assert sum(n for _, n in {(a, n) for _, a, n, _ in cut}) == len(member) - len(records[-1]) // 2 + len(records[0])
    big = b"x" * (3 << 20)
    block = b"HTTP/1.1 200 OK\r\n\r\n" + big
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert [(k, r["payload_bytes"]) for k, _, _, r in warc.salvage(gzip.compress(one))] == [("record", len(big))]


def archive(spark):
    return [(r["record"]).encode() for r in warc.records(pages(spark)[1]).collect()]


def test_salvage(spark):
    import gzip

    records = archive(spark)
    for raw in (records, [gzip.compress(r) for r in records]):
        whole = b"".join(raw)
        sound = list(warc.salvage(whole))
        assert [k for k, *_ in sound] == ["record"] * len(raw)
        rng = np.random.default_rng(1)
        starts = np.cumsum([0, *map(len, raw)])
        for _ in range(40):
            at = int(rng.integers(0, len(whole)))
            hurt = bytearray(whole)
            hurt[at] ^= 0x55
            found = list(warc.salvage(bytes(hurt)))
            bad = int(np.searchsorted(starts, at, "right")) - 1
            ids = {r["record_id"] for k, _, _, r in found if k == "record"}
            lost = [r for j, (_, _, _, r) in enumerate(sound) if j != bad and r["record_id"] not in ids]
            assert not lost
            assert sum(n for _, _, n, _ in found) == len(whole) or raw is not records
        cut = list(warc.salvage(b"junk" + whole[: starts[3] + 10]))
        assert [k for k, *_ in cut] == ["gap", "record", "record", "record", "gap"] and cut[0][2] == 4
    assert list(warc.salvage(b"")) == []
