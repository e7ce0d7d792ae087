"""The answers: persons, appearances, timelines, captions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.operators import temporal as T


#: Colours and tapes that cards cycle through by place.
COLOURS, TAPES = 5, 6


def appearances(points: DataFrame, key: list[str], gap: int, least: int) -> DataFrame:
    """key, index from 0, start_us, end_us, n_det of each appearance of points(key, us, det_id)."""
    rows = T.gap_segments(points.withColumn("end", F.col("us")), key, "us", "end", gap, "det_id")
    return T.keep_long(T.segment_bounds(rows, key, "us", "end"), key, least)


def timeline(scored: DataFrame, key: str, gap: int, least: int) -> DataFrame:
    """Appearances with duration_us, the sharpness of the detection of highest rep score, and the frames seen."""
    rows = T.gap_segments(scored.withColumn("end", F.col("us")), [key], "us", "end", gap, "det_id")
    peak = F.max_by("sharpness", F.struct(F.round("rep_score", 9), -F.col("det_id"))).alias("peak_quality")
    bounds = rows.groupBy(key, "seg").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_det"), peak, F.count_distinct("frame_index").alias("n_frames"))
    kept = T.keep_long(bounds, [key], least)
    return kept.select(key, "index", "start_us", "end_us", F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0)).alias("duration_us"), "peak_quality", "n_frames")


def totals(found: DataFrame, key: str) -> DataFrame:
    """One row: unique_people, total_appearances, and the most seen person, the first on ties."""
    each = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("unique_people"), F.sum("n").alias("total_appearances"), F.min_by(key, F.struct(-F.col("n"), F.col(key))).alias("most_seen"))


def prominence(tracklets: DataFrame) -> DataFrame:
    """video_id, person_id, rank, detections, start_us: persons of a video by falling detections, then start."""
    persons = tracklets.groupBy("video_id", "person_id").agg(F.sum("n_det").alias("detections"), F.min("start_us").alias("start_us"))
    return persons.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("detections"), "start_us", "person_id")))


def captions(found: DataFrame, key: str, compact: int = 4) -> DataFrame:
    """key, label, caption, short_caption of each person with its number of appearances."""
    n = F.col("appearances")
    text = F.concat(n.cast("string"), F.when(n == 1, " appearance").otherwise(" appearances"))
    each = found.groupBy(key).agg(F.count(F.lit(1)).alias("appearances"))
    return each.select(key, F.concat(F.lit("Person "), F.col(key).cast("string")).alias("label"), text.alias("caption"), F.concat(F.lit("x"), n.cast("string")).alias("short_caption"), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")).alias("padded"))


def collage(persons: DataFrame, group: str, order: str) -> DataFrame:
    """group, person_id, slot, cx, cy, w, h, rotation of each person's card."""
    w = W.partitionBy(group).orderBy(order)
    placed = persons.withColumn("slot", (F.row_number().over(w) - 1)).withColumn("of", F.count(F.lit(1)).over(W.partitionBy(group)))
    tilt = F.element_at(F.array(*map(F.lit, G.TILT)), (F.col("slot") % len(G.TILT) + 1).cast("int"))
    colour, tape = F.col("slot") % COLOURS, F.col("slot") % TAPES
    return placed.withColumn("s", G.grid_slot(F.col("slot"), F.col("of"))).select(group, "person_id", "slot", "s.*", tilt.alias("rotation"), colour.alias("colour"), tape.alias("tape"))


def ordered_timeline(entries: DataFrame, group: list[str], key: str) -> DataFrame:
    """entries(key, index, start_us, ...) with position from 0 in the order they are shown in: by entry, then person, then index."""
    return entries.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy("start_us", key, "index")) - 1)


def outcomes(videos: DataFrame, detections: DataFrame) -> DataFrame:
    """video_id, detections, subjects, status of each of videos(video_id): "no_faces" where nothing is detected, else "ok"."""
    seen = detections.groupBy("video_id").agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("person_id").alias("subjects"))
    both = videos.select("video_id").distinct().join(seen, "video_id", "left").fillna({"detections": 0, "subjects": 0})
    return both.withColumn("status", F.when(F.col("detections") == 0, "no_faces").otherwise("ok"))


def run_statistics(frames: DataFrame, detections: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """Counts of a run: frames, static ones, detections, subjects, duration; and the real-time factor for a known time."""
    f = frames.agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("is_static").cast("long")).alias("static_frames"))
    d = detections.agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("person_id").alias("subjects"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s"))
    both = f.withColumn("one", F.lit(1)).join(d.withColumn("one", F.lit(1)), "one").drop("one")  # two single rows
    return both if elapsed_s is None else both.withColumn("realtime_factor", F.col("duration_s") / F.lit(elapsed_s)).withColumn("frames_per_wall_second", F.col("frames") / F.lit(elapsed_s))
