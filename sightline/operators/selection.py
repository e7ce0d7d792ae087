"""Which detections represent a track or person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.relations import usable_or_all


def _merits(quality_digits: int) -> list[Column]:
    width = F.col("box.right") - F.col("box.left")
    return [F.col("solo_portrait"), F.col("clean"), F.col("visible"), F.col("sharpness") >= 40, F.round("recognition_quality", quality_digits), F.round("frontality", quality_digits), F.round("sharpness", quality_digits), width]


def rank_shots(scored: DataFrame, key: list[str], quality_digits: int = 9) -> DataFrame:
    """Candidates of each key with rank from 1: those with a crop if any, of these the solo portraits if any, by solo, clean, visible, sharp enough, quality,
    frontality, sharpness, width, then id."""
    pool = usable_or_all(usable_or_all(scored, key, F.col("has_crop")), key, F.col("solo_portrait"))
    return pool.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in _merits(quality_digits)], "det_id")))


def first_shots(scored: DataFrame, owners: DataFrame, part: list[str], key: list[str], quality_digits: int = 9) -> DataFrame:
    """key, det_id of rank 1 by rank_shots() of scored with their key, which owners(part, key) gives for each part. The first of a part is found before
    parts are joined, in sums of one row a part, so no key's rows are held or sorted as a whole."""
    good = [F.coalesce(c, F.lit(False)) for c in ("has_crop", "solo_portrait")]
    merits = [*good, *_merits(quality_digits), F.col("det_id").isNull(), F.bitwise_not("det_id")]
    worth = F.struct(*[m.alias("last" if m is merits[-1] else f"m{i}") for i, m in enumerate(merits)])
    firsts = scored.groupBy(*part).agg(F.max(worth).alias("worth")).join(owners, part)
    return firsts.groupBy(*key).agg(F.max("worth").alias("worth")).select(*key, F.bitwise_not("worth.last").alias("det_id"))


def top_faces(scored: DataFrame, key: list[str], n: int, least: float = 0.0) -> DataFrame:
    """The n best detections of each key by recognition quality, of those of at least this quality if any."""
    pool = usable_or_all(scored, key, F.col("recognition_quality") >= least)
    order = W.partitionBy(*key).orderBy(F.desc(F.round("recognition_quality", 9)), "det_id")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_shot(scored: DataFrame, key: list[str]) -> DataFrame:
    """key, det_id, rep_score, sharpness of the detection of highest rep score, the smallest id on ties."""
    best = F.max_by(F.struct("det_id", "rep_score", "sharpness"), F.struct(F.round("rep_score", 9), -F.col("det_id")))
    return scored.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def refine_needed(best: DataFrame) -> DataFrame:
    """best with needs_decode (no crop, not solo, not clean or too blurred), acceptable and fallback_score."""
    needs = ~F.col("has_crop") | ~F.col("solo") | ~F.col("clean") | (F.col("sharpness") < 40)
    fallback = F.when(F.col("solo"), 1000.0).otherwise(0.0) + F.when(F.col("clean"), 500.0).otherwise(0.0) + F.least(F.col("sharpness"), F.lit(45.0))
    return best.withColumn("needs_decode", needs).withColumn("acceptable", F.col("solo") & F.col("clean") & (F.col("sharpness") >= 45)).withColumn("fallback_score", fallback)


def refine_pick(candidates: DataFrame, key: list[str], most: int = 1) -> DataFrame:
    """key, det_id, source of the shot that represents each key, from candidates(key, rank, det_id, needs_decode, and of the second look clean, solo, sharpness or null
    where it failed): the first as it is if it needs no second look ("existing"); else the first of the most best that is clean, solo and sharp enough
    ("verified"); else the one of highest fallback score, the earlier on ties ("fallback"); else the first ("unverified")."""
    seen = F.col("clean").isNotNull()
    good = seen & F.col("clean") & F.col("solo") & (F.col("sharpness") >= 45)
    score = F.when(F.col("clean"), 1000.0).otherwise(0.0) + F.when(F.col("solo"), 500.0).otherwise(0.0) + F.least(F.col("sharpness"), F.lit(45.0))
    tried = F.col("rank") <= most
    shots = candidates.groupBy(*key).agg(
        F.min_by("det_id", "rank").alias("first"), F.min_by("needs_decode", "rank").alias("needs"),
        F.min_by(F.when(good & tried, F.col("det_id")), F.when(good & tried, F.col("rank"))).alias("good"),
        F.max_by("det_id", F.when(seen & tried, F.struct(score.alias("s"), (-F.col("rank")).alias("r")))).alias("fallback"))
    keep = ~F.col("needs")
    source = F.when(keep, "existing").when(F.col("good").isNotNull(), "verified").when(F.col("fallback").isNotNull(), "fallback").otherwise("unverified")
    return shots.select(*key, F.when(keep, F.col("first")).otherwise(F.coalesce("good", "fallback", "first")).alias("det_id"), source.alias("source"))


def planned_inferences(scored: DataFrame, key: list[str], n: int, least: float = 0.0) -> DataFrame:
    """One row: tracks, and how many faces an embedder would be asked for."""
    each = top_faces(scored, key, n, least).groupBy(*key).agg(F.count(F.lit(1)).alias("faces"))
    return each.agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.sum("faces"), F.lit(0)).alias("inferences"))


def usable(detections: DataFrame, least: float) -> DataFrame:
    """Detections with an embedding and of at least this recognition quality."""
    return detections.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.col("recognition_quality") >= least))
