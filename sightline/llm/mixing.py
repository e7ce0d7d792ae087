"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.host_quality import host_key

#: Weights of the sources in code point order, repeating; most copies of a document; documents of one source and size that are put in order in one task.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
GROUP = 4096
NEWTON_STEPS = 200
TOLERANCE = 1e-9


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(common.WORD)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.lit("mix"))


def targets(groups: DataFrame) -> DataFrame:
    """key, source_size, target of each source of groups(key, size, n): a share of all words by weight, capped at CAP times the
    source's words, the excess shared anew by weight. In closed form: target = least(cap, level * weight), where the level follows from running
    sums over the sources in order of cap / weight. Works on one row a source."""
    sources = groups.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("key") == "n", "key")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    earlier, rest, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    sources = sources.withColumn("level", level)
    # the first source that stays within its cap at its own level sets the level of all that follow
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sources.select("key", "source_size", "docs", F.least(F.col("cap"), F.coalesce(final, F.col("level")) * F.col("weight")).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(lam * x, F.lit(2.0))))


def balance(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """key, mean, lam: the duals. Rates least(CAP, exp(lam * size / mean)) minimise the relative entropy to one copy of each document
    under each source's word target. Each Newton step sums residual and slope over all groups of documents, by source, and
    bisects where a step leaves the bracket."""
    totals = sources.agg(F.sum("source_size").alias("s"), F.sum("docs").alias("d")).first()
    mean = float(totals["s"] or 0) / max(1, totals["d"] or 0) or 1.0
    least = groups.where("size > 0").groupBy("key").agg((F.min("size") / F.lit(mean)).alias("least"))
    state = sources.join(least, "key").where("target > 0")
    share = F.col("target") / F.col("source_size")
    state = state.select(
        "key", "target", F.lit(0.0).alias("lam"), F.least(F.lit(0.0), F.log(share) / F.col("least")).alias("lo"), F.greatest(F.lit(0.0), F.lit(1.1) * F.log(F.lit(float(CAP))) / F.col("least")).alias("hi"), F.lit(1.0).alias("off"), (share >= CAP * (1 - 1e-12)).alias("full"))
    state = common.materialise(state.withColumn("lam", F.when(F.col("full"), F.col("hi")).otherwise(F.col("lam"))), "balance")
    x = F.col("size") / F.lit(mean)
    for _ in range(NEWTON_STEPS):
        rate = _rate(F.col("lam"), x)
        sums = groups.join(state, "key").groupBy("key", "target", "lam", "lo", "hi", "full").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            F.sum(F.when(rate < CAP, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("words") - F.col("target")
        moved = sums.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        step = F.when(F.col("full") | (F.abs(gap) <= TOLERANCE * F.col("target")), F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = common.materialise(moved.select("key", "target", step.alias("lam"), "lo", "hi", F.when(F.col("full"), 0.0).otherwise(F.abs(gap) / F.col("target")).alias("off"), "full"), "balance")
        if (state.agg(F.max("off").alias("off")).first()["off"] or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the duals have not converged after {NEWTON_STEPS} steps")
    return state.select("key", "lam", F.lit(mean).alias("mean"))


def copies_by_size(groups: DataFrame, sources: DataFrame, duals: DataFrame, refinements: int = 6) -> DataFrame:
    """key, size, n, copies: how many copies all documents of one source and size get together. Running sums of rates by falling size
    are rounded; then what a source is off its target is made up with the largest sizes that fit into it."""
    rate = F.when(F.col("lam").isNull(), F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean")))
    rated = groups.join(duals, "key", "left").withColumn("want", F.col("n") * rate)
    upto = F.sum("want").over(Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    rounded = rated.withColumn("b", F.floor(upto + 0.5)).withColumn("b0", F.coalesce(F.lag("b").over(Window.partitionBy("key").orderBy(F.desc("size"))), F.lit(0)))
    plan = rounded.select("key", "size", "n", F.greatest(F.lit(0), F.least(F.col("b") - F.col("b0"), CAP * F.col("n"))).cast("long").alias("copies"))
    plan = common.materialise(plan, "mix-plan")
    for _ in range(refinements):
        off = plan.join(sources.select("key", "target"), "key").groupBy("key", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).select("key", F.round(F.col("target") - F.col("words")).cast("long").alias("off"))
        room = F.when(F.col("off") > 0, CAP * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        change = plan.where("size > 0").join(off, "key").where((F.abs("off") >= F.col("size")) & (room > 0))
        best = change.groupBy("key").agg(F.max_by(F.struct("size", (F.signum("off") * F.least(room, F.floor(F.abs("off") / F.col("size")))).cast("long").alias("by")), "size").alias("best"))
        best = common.materialise(best.select("key", F.col("best.size").alias("size"), F.col("best.by").alias("by")), "mix-change")
        if best.isEmpty():
            break
        plan = common.materialise(plan.join(best, ["key", "size"], "left").select("key", "size", "n", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")), "mix-plan")
    return plan


def mix_plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For sized(key, size, hash): a row for each source and size with the copies every document gets (each), the hash up to which they get one more
    (cutoff) and, of the documents that have this very hash, how many do (quota of ties); and the sources' targets.

    A group's hashes are cut into ranges of some GROUP documents, whose counts tell in which one the cutoff lies; only that range is put in order.
    """
    groups = common.materialise(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    sources = common.materialise(targets(groups), "mix-sources")
    plan = copies_by_size(groups, sources, balance(groups, sources))
    plan = plan.select("key", "size", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra"), F.ceil(F.col("n") / GROUP).cast("long").alias("parts"))
    plan = common.materialise(plan, "mix-copies")
    part = F.shiftrightunsigned((F.shiftright("hash", 32) + F.lit(1 << 31)) * F.col("parts"), 32)
    of = ["key", "size", "part"]
    parted = sized.join(plan.where("extra > 0"), ["key", "size"]).withColumn("part", part)
    upto = F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    edge = parted.groupBy(*of, "extra").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", upto).where("upto >= extra and upto - m < extra")
    edge = common.materialise(edge.select(*of, (F.col("extra") - F.col("upto") + F.col("m")).alias("need")), "mix-edges")
    by_hash = parted.select(*of, "hash").join(edge, of).groupBy(*of, "need", "hash").agg(F.count(F.lit(1)).alias("ties"))
    below = F.sum("ties").over(Window.partitionBy(*of).orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
    cutoffs = by_hash.withColumn("below", below).where("below < need and below + ties >= need").select("key", "size", F.col("hash").alias("cutoff"), "ties", (F.col("need") - F.col("below")).alias("quota"))
    return common.materialise(plan.join(cutoffs, ["key", "size"], "left").select("key", "size", "each", "cutoff", "ties", "quota"), "mix-cutoffs"), sources


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(key, size, hash, ...) with copies. Only where rows of one hash lie at a cutoff that not all of them pass, those rows are counted off."""
    one_more = F.when(F.col("hash") <= F.col("cutoff"), 1).otherwise(0)
    split = F.coalesce((F.col("hash") == F.col("cutoff")) & (F.col("quota") < F.col("ties")), F.lit(False))
    placed = rows.join(plan, ["key", "size"])
    if plan.where("quota < ties").isEmpty():
        return placed.withColumn("copies", F.col("each") + one_more)
    turn = F.row_number().over(Window.partitionBy("key", "size", "hash").orderBy("hash"))  # the same id and text: any of them will do
    tied = placed.where(split).withColumn("turn", turn).withColumn("copies", F.col("each") + F.when(F.col("turn") <= F.col("quota"), 1).otherwise(0)).drop("turn")
    return placed.where(~split).withColumn("copies", F.col("each") + one_more).unionByName(tied)


def mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs(doc_id, text, source).

    size counts words (null text: 0) and taken is size times the copies, of which no document gets more than CAP. Null sources are one source, the last.
    Repeated rows and null ids count as documents of their own; documents of no words take nothing; an empty table gives no rows; other columns
    are ignored. Which documents get one copy more hangs on a hash of doc_id and text, and of rows equal in both on their number alone, so reruns agree.
    """
    text = common.text_of(docs)
    sized = common.materialise(docs.select(docs["doc_id"].alias("doc_id"), host_key(docs[source]).alias("key"), size_of(text).alias("size"), _hash(docs["doc_id"], text).alias("hash")), "mix-sizes")
    plan, sources = mix_plan(sized.select("key", "size", "hash"))
    return _with_copies(sized, plan).join(sources, "key").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it; see there for nulls and repeated rows. Documents of no words stay once; an
    empty table gives no rows."""
    text = common.text_of(docs)
    keys = [host_key(docs[source]).alias("key"), size_of(text).alias("size"), _hash(docs["doc_id"], text).alias("hash")]
    plan, _ = mix_plan(common.materialise(docs.select(*keys), "mix-sizes"))
    packed = _with_copies(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keys), plan)
    return packed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")
