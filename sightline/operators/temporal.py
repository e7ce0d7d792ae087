"""Ordered analytics over frames and detections: gap segments, scene rules, carry-forward, cut suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import scores as S
from sightline.functions import vectors as V


def gap_segments(rows: DataFrame, key: list[str], start: str, end: str, gap: int, order: str) -> DataFrame:
    """rows with seg, counted from 0 by key: a new segment begins where start is more than gap after the end of the row before (in
    order of start, not the latest end so far)."""
    w = W.partitionBy(*key).orderBy(start, order)
    new = (F.col(start) - F.lag(end).over(w) > gap).cast("int")
    return rows.withColumn("seg", F.coalesce(F.sum(new).over(w), F.lit(0)).cast("long"))


def segment_bounds(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    return rows.groupBy(*key, "seg").agg(F.min(start).alias("start_us"), F.max(end).alias("end_us"), F.count(F.lit(1)).alias("n_det"))


def keep_long(segments: DataFrame, key: list[str], least: int) -> DataFrame:
    """Segments of at least this duration; a key without one keeps its longest, the first on ties. index counts what is kept from 0."""
    length = F.col("end_us") - F.col("start_us")
    ranked = segments.withColumn("length", length).withColumn("by_length", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("length"), "seg")))
    any_long = F.max(F.col("length") >= least).over(W.partitionBy(*key))
    kept = ranked.withColumn("any_long", any_long).where((F.col("length") >= least) | (~F.col("any_long") & (F.col("by_length") == 1)))
    return kept.withColumn("index", (F.row_number().over(W.partitionBy(*key).orderBy("seg")) - 1).cast("long")).drop("length", "by_length", "any_long")


def with_previous(frames: DataFrame, columns: list[str], key: list[str] | None = None, order: str = "frame_index") -> DataFrame:
    """frames with prev_<column> of the frame before."""
    w = W.partitionBy(*(key or [])).orderBy(order)
    return frames.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def frame_changes(frames: DataFrame, key: list[str] | None = None) -> DataFrame:
    """frames with chi2, overlap, ssim, edge_change and delta against the frame before; null at the first, whose delta is 1."""
    f = with_previous(frames, ["hist", "brightness", "lap_var"], key)
    h, p = F.col("hist"), F.col("prev_hist")
    some = p.isNotNull()
    return (
        f.withColumn("chi2", F.when(some, V.chi_square(p, h))).withColumn("overlap", F.when(some, V.intersection(p, h))).withColumn("ssim", F.when(some, V.ssim(p, h)))
        .withColumn("edge_change", F.when(some, V.relative_change(F.col("prev_lap_var"), F.col("lap_var"))))
        .withColumn("delta", F.when(some, F.abs(F.col("brightness") - F.col("prev_brightness"))).otherwise(1.0))
    )


def cut_rule(chi2: Column, ssim: Column, edge_change: Column, before: Column, now: Column, cut: float = 0.42, dissolve: float = 0.28) -> Column:
    """The kind of scene boundary, or null; the first rule that holds."""
    fade = ((before < 0.08) & (now > 0.18)) | ((before > 0.18) & (now < 0.08))
    return (
        F.when((chi2 > cut) & (ssim < 0.65), "HARD_CUT")
        .when(fade, F.when(now > before, "FADE_IN").otherwise("FADE_OUT"))
        .when((chi2 > dissolve) & (ssim < 0.72) & (edge_change < 0.35), "CROSS_DISSOLVE")
        .when((edge_change > 0.65) & (chi2 > dissolve) & (ssim < 0.60), "ZOOM_TRANSITION")
    )


def transition_rule(lap_var: Column, before: Column, overlap: Column, whip: float = 0.08, blur: float = 45.0) -> Column:
    """A struct of kind and severity, or null; the first rule that holds. GAUSSIAN_BLUR can't be reached: the rule before it takes its cases."""
    hf = S.high_frequency_ratio(lap_var)
    of = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.least(F.greatest(severity, F.lit(0.0)), F.lit(1.0)).alias("severity"))
    return F.when(overlap.isNotNull(), (
        F.when((hf < whip) & (overlap < 0.55), of("WHIP_PAN", 1 - hf / whip))
        .when((lap_var < blur) & (hf < 0.12), of("MOTION_BLUR", 1 - lap_var / blur))
        .when((hf < 0.06) & (overlap >= 0.70), of("GAUSSIAN_BLUR", 1 - hf / 0.06))
        .when(overlap.between(0.50, 0.72) & (F.abs(lap_var - before) > 30), of("DISSOLVE", F.lit(0.75)))
    ))


def sampling_interval(delta: Column) -> Column:
    """Milliseconds to the next frame: 1000 for a still scene, 200 for a busy one, else 333."""
    return F.when(delta < 0.04, 1000).when(delta > 0.18, 200).otherwise(333)


def carry_forward(frames: DataFrame, key: list[str] | None = None, still: float = 0.035) -> DataFrame:
    """frames(delta, boundary, n) with is_static and source_frame, the last frame that detection ran on. A still frame that is no boundary and
    not the first reuses what the frames before hold; where that is nothing, detection runs again."""
    w = W.partitionBy(*(key or [])).orderBy("frame_index")
    quiet = (F.col("delta") < still) & ~F.col("boundary") & F.lag("frame_index").over(w).isNotNull()
    f = frames.withColumn("quiet", quiet)
    runs = f.withColumn("last_n", F.last(F.when(~F.col("quiet"), F.col("n")), True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    static = F.col("quiet") & (F.col("last_n") > 0)
    return runs.withColumn("is_static", static).withColumn("source_frame", F.last(F.when(~static, F.col("frame_index")), True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("quiet", "last_n")


def epochs(frames: DataFrame, key: list[str] | None = None) -> DataFrame:
    """frames(boundary) with epoch, which grows at each boundary; tracks don't cross epochs."""
    return frames.withColumn("epoch", F.sum(F.col("boundary").cast("int")).over(W.partitionBy(*(key or [])).orderBy("frame_index")).cast("long"))


def suppress_cuts(hits: DataFrame, key: str, at: str, least: int) -> DataFrame:
    """key, at of the accepted hits: those at least so long after the last accepted one, which is at 0 at first. Order decides, so a fold over
    each key's hits, whose number is bounded by the sampled frames of one video."""
    fold = F.aggregate(
        F.sort_array(F.collect_list(at)), F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("kept")),
        lambda a, t: F.when(t - a["last"] >= least, F.struct(t.alias("last"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a))
    return hits.groupBy(key).agg(fold.alias("f")).select(key, F.explode("f.kept").alias(at))


def scenes(cuts: DataFrame, totals: DataFrame, key: str, at: str, total: str) -> DataFrame:
    """key, scene_id from 1, start, end, confidence: the time between cuts, up to the total; without cuts one scene of confidence 1."""
    bounds = totals.select(key, F.lit(0).cast("long").alias("start")).unionByName(cuts.select(key, F.col(at).alias("start"))).distinct()
    w = W.partitionBy(key).orderBy("start")
    out = bounds.join(totals, key).where((F.col("start") < F.col(total)) | (F.col("start") == 0)).select(key, total, "start", F.lead("start").over(w).alias("next"), F.row_number().over(w).alias("scene_id"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("n"))
    return out.select(key, "scene_id", "start", F.coalesce("next", total).alias("end"), F.when(F.col("n") == 1, 1.0).otherwise(0.95).alias("confidence"))


def recent(rows: DataFrame, key: list[str], order: list[str], value: str, most: int = 200) -> DataFrame:
    """rows with recent, the values of the last most rows of each key up to this one, the oldest first."""
    return rows.withColumn("recent", F.collect_list(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(1 - most, 0)))


def carried_faces(frames: DataFrame, detections: DataFrame, key: list[str]) -> DataFrame:
    """detections of all frames(key, frame_index, source_frame): a still frame has the faces of its source frame again, with its own index and carried set."""
    at = frames.select(*key, F.col("frame_index").alias("shown_at"), F.col("source_frame").alias("frame_index"))
    found = at.join(detections, [*key, "frame_index"]).withColumn("carried", F.col("shown_at") != F.col("frame_index"))
    return found.drop("frame_index").withColumnRenamed("shown_at", "frame_index")
