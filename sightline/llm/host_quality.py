"""Quality rules with verdicts by host, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

#: Rules by which hosts are judged: share of failing documents above which a host is bad.
RULES = ("short", "repeats", "symbols", "dup_lines")
HOST_CEILING = 0.5
#: Bounds of a prior's strength in documents.
STRENGTH = (2.0, 1000.0)
#: Most bits of the map that tells keep_documents() which rows to measure again: 2**18 words, which are broadcast.
MARK_BITS = 1 << 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows of five whose hash occurs twice or more: such windows' places in order, overlaps counted once."""
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"), (i + 5).alias("end"))
    return F.aggregate(let(by_hash, places), zero, step)["n"]


def measures(text: Column) -> Column:
    """A struct: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, all long. text must not be null.

    n_repeat_words compares windows by 64-bit hashes.
    """
    words = F.array_remove(F.split(text, common.SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        repeats = F.when(F.size(w) < 6, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h))))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeats.cast("long").alias("n_repeat_words"))

    def both(w: Column) -> Column:
        symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
        return let(lines, lambda x: F.struct(*[w[c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")], symbols.alias("n_symbols"), F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))

    return let(let(words, of_words), both)


def failures(m: Column) -> dict[str, Column]:
    return {
        "short": m["n_words"] < 10,
        "repeats": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
    }


def host_key(host: Column) -> Column:
    """A host as a non-null key: null is a host of its own."""
    return F.when(host.isNull(), "n").otherwise(F.concat(F.lit("s"), host.cast("string")))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """key, bad, suspect_symbols, suspect_dup_lines of each host of measured(key, m).

    Failures are counted by host with partial sums. For each rule a beta prior is fitted to the hosts' rates by moments (mean: all
    documents; variance: between hosts, by documents, less sampling noise), and a host's rate is (failures + a) / (documents + a + b). A host is bad if
    a shrunk rate is over one half; it is suspect for a rule if its shrunk rate is over a tenth and twice the mean.
    """
    fails = failures(F.col("m"))
    hosts = measured.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(fails[r].cast("long")).alias(r) for r in RULES])
    hosts = common.materialise(hosts, "host-failures")
    total = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(r) for r in RULES]).first()
    n, count = total["n"] or 0, total["hosts"]
    mean = {r: (total[r] or 0) / n if n else 0.0 for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(mean[r]), 2)).alias(r) for r in RULES]).first()
    rate = {}
    for r in RULES:
        p, low_high = mean[r], STRENGTH
        noise = p * (1 - p)
        between = ((spread[r] or 0.0) - max(0, count - 1) * noise) / n if n else 0.0
        strength = min(max(noise / between - 1, low_high[0]), low_high[1]) if between > 0 else low_high[1]
        rate[r] = (F.col(r) + F.lit(p * strength)) / (F.col("n") + F.lit(strength))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (rate[r] > HOST_CEILING)
    suspect = lambda r: (rate[r] > 0.1) & (rate[r] > 2 * mean[r])
    return hosts.select("key", bad.alias("bad"), suspect("symbols").alias("suspect_symbols"), suspect("dup_lines").alias("suspect_dup_lines"))


def _rejected(m: Column) -> tuple[Column, Column]:
    fails = failures(m)
    base = fails["short"] | fails["repeats"]
    host = F.col("bad") | (F.col("suspect_symbols") & fails["symbols"]) | (F.col("suspect_dup_lines") & fails["dup_lines"])
    return base, base | host


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    kept is false if base_failed, if the document's host is bad, or if it fails a rule (symbols, repeated lines) for which its host is
    suspect. A null text has no words and fails; null hosts form one host; repeated rows each count; an empty table gives no rows;
    other columns, whatever their names, are ignored. Texts are read once and not shuffled.
    """
    measured = docs.select(docs["doc_id"].alias("doc_id"), host_key(docs[host]).alias("key"), measures(common.text_of(docs)).alias("m"))
    measured = common.materialise(measured, "quality-measures")
    base, rejected = _rejected(F.col("m"))
    columns = [F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return measured.join(host_verdicts(measured), "key").select("doc_id", *columns, base.alias("base_failed"), (~rejected).alias("kept"))


def _marks(rejected: DataFrame, bits: int) -> DataFrame:
    """i, w: the words, none of them zero, of a bit map of so many bits in which the bit of every mark is set."""
    at = F.pmod("mark", F.lit(bits))
    words = rejected.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(mark, {bits}L) % 64 AS INT))").alias("w"))
    return common.materialise(words.groupBy("i").agg(F.bit_or("w").alias("w")), "quality-marks")


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs, all columns, that judge() keeps. Rows stay where they are read: only their measures are written to the shared folder. A bit map of
    the rejected ones' hashes lets all others through; those whose bit is set, some kept ones among them, are measured again. The map has 16 bits a
    rejected row and MARK_BITS at most; a full one costs time and changes no verdict. Null texts fail; null hosts are one host; repeated rows all stay or go; an empty table gives no rows."""
    text = common.text_of(docs)
    mark = F.xxhash64(text, host_key(docs[host])).alias("mark")
    measured = common.materialise(docs.select(mark, host_key(docs[host]).alias("key"), measures(text).alias("m")), "quality-measures")
    verdicts = host_verdicts(measured)
    rejected = common.materialise(measured.join(verdicts, "key").where(_rejected(F.col("m"))[1]).select("mark"), "quality-rejected")
    bits = min(max(16 * rejected.count(), 1 << 16), MARK_BITS)
    marks = _marks(rejected, bits)
    common.discard(measured, rejected)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    placed = docs.select(row, host_key(docs[host]).alias("key"), text.alias("text"), mark).join(F.broadcast(marks), F.shiftright(F.pmod("mark", F.lit(bits)), 6) == F.col("i"), "left")
    marked = F.coalesce(F.expr(f"getbit(w, cast(pmod(mark, {bits}L) % 64 AS INT)) = 1"), F.lit(False))
    again = placed.where(marked).join(verdicts, "key").where(let(measures(F.col("text")), lambda m: ~_rejected(m)[1]))
    return placed.where(~marked).select("row.*").unionByName(again.select("row.*"))
