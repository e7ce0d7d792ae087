"""Detections, frames, tracklets and identities derived from the tables events and embeddings; and frame sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import scores as S

#: Micros of 2024-01-01 and of an hour, which stands for a sampled frame.
EPOCH, HOUR = 1_704_067_200_000_000, 3_600_000_000
KINDS = ("click", "error", "purchase", "signup", "view")
FRAME_WIDTH, FRAME_HEIGHT = 1080, 1920


def micros(ts: Column) -> Column:
    """Micros since 1970 of a timestamp without time zone, in any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.select("event_id", "user_id", "event_type", "value", micros(F.col("ts").cast("timestamp_ntz")).alias("us"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an hour: frame_index, n, hist (shares of the five kinds), mean_value, lap_var, brightness."""
    frame = F.floor((F.col("us") - EPOCH) / HOUR).alias("frame_index")
    share = [F.sum(F.when(F.col("event_type") == k, 1.0).otherwise(0.0)) / F.count(F.lit(1)) for k in KINDS]
    out = events(spark, sf_dir).groupBy(frame).agg(F.count(F.lit(1)).alias("n"), F.array(*share).alias("hist"), F.avg("value").alias("mean_value"), F.var_pop("value").alias("lap_var"))
    return out.withColumn("brightness", F.least(F.lit(1.0), F.col("mean_value") / 100.0))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event, in the shape of timed detections."""
    e = F.col("event_id")
    left, top = (e % 6) * 150 + (e * 37) % 80, 700 + (e * 53) % 100
    d = events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("video_id"), F.col("user_id").alias("person_id"), e.alias("det_id"), F.floor((F.col("us") - EPOCH) / HOUR).alias("frame_index"),
        F.col("us"), F.floor(F.col("us") / 1000).alias("timestamp_ms"), G.box(left, top, left + 120, top + 160).alias("box"),
        ((e * 13) % 121 - 60).alias("yaw"), ((e * 17) % 81 - 40).alias("roll"), (((e * 19) % 101) / 100.0).alias("smile"), (((e * 23) % 101) / 100.0).alias("left_eye"), (((e * 29) % 101) / 100.0).alias("right_eye"),
        (F.col("value") * 3.0).alias("sharpness"), (e % 7 != 0).alias("has_crop"), (e % 5 != 0).alias("clean"))
    return d


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event again, with boxes of many sizes of which some are small or outside the frame, and pitch, landmarks, eyes, rotation and sides of its video."""
    e = F.col("event_id")
    left, top = (e * 37) % 1300 - 150, (e * 53) % 2100 - 150
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("video_id"), F.col("user_id").alias("person_id"), e.alias("det_id"), F.floor((F.col("us") - EPOCH) / HOUR).alias("frame_index"), F.col("us"),
        G.box(left, top, left + 30 + (e * 7) % 300, top + 40 + (e * 11) % 380).alias("box"), (F.col("value") * 3.0).alias("sharpness"),
        ((e * 13) % 121 - 60).alias("yaw"), ((e * 31) % 91 - 45).alias("pitch"), ((e * 17) % 81 - 40).alias("roll"), ((e % 6) / 5.0).alias("landmarks"),
        point((e * 3) % 200, (e * 7) % 120).alias("left_eye_at"), point((e * 5) % 90, (e * 11) % 100).alias("right_eye_at"),
        (e % 4 * 90).cast("int").alias("rotation"), F.when(e % 11 != 0, 320 + e % 1700).cast("int").alias("width"), F.when(e % 13 != 0, 240 + (e * 3) % 2300).cast("int").alias("height"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of 8 x 8 pixels an embedding, its video the label: red, green and blue from three of the components."""
    at = lambda i: F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double")
    byte = lambda x: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x + 0.5)) * 255).cast("int")
    pixel = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(byte(at(i)), byte(at(i * 7 + 3)), byte(at(i * 5 + 1))))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_index"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.flatten(pixel).alias("pixels"))


def with_context(d: DataFrame) -> DataFrame:
    """Detections with solo (the only one of its video's frame) and others (boxes of the frame that differ from its own)."""
    frame = W.partitionBy("video_id", "frame_index")
    equal = W.partitionBy("video_id", "frame_index", "box")
    counted = d.withColumn("in_frame", F.count(F.lit(1)).over(frame)).withColumn("others", F.when(F.col("box").isNull(), F.lit(0)).otherwise(F.count("box").over(frame) - F.count("box").over(equal)).cast("long"))
    return counted.select(*d.columns, "in_frame", (F.col("in_frame") == 1).alias("solo"), "others")


def with_scores(d: DataFrame) -> DataFrame:
    width = G.width(F.col("box"))
    face = [F.col(c) for c in ("sharpness", "yaw", "roll")]
    return (
        d.withColumn("recognition_quality", S.recognition_quality(*face, width))
        .withColumn("frontality", S.frontality(F.col("yaw"), F.col("roll")))
        .withColumn("rep_score", S.rep_score(*face, F.col("left_eye"), F.col("right_eye"), F.col("smile"), width, F.col("solo")))
        .withColumn("visible", S.fully_visible(F.col("box"), F.lit(FRAME_WIDTH), F.lit(FRAME_HEIGHT)))
        .withColumn("solo_portrait", S.solo_portrait(F.col("box"), F.lit(FRAME_WIDTH), F.lit(FRAME_HEIGHT), F.col("solo"), F.col("others")))
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(v.alias("tracklet_id"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"), ((v * 31 % 97) / 96.0).alias("quality"), F.col("label").alias("cohort"), (v % 25).alias("co_frame"))


def sampling_grid(videos: DataFrame, target_fps: int = 3, cap: int = 28) -> DataFrame:
    """video_id, k, at_ms from videos(video_id, start_ms, end_ms): steps of the larger of 1000 / fps, 400 ms and a cap-th of the duration, at most cap."""
    duration = F.col("end_ms") - F.col("start_ms")
    step = F.greatest(F.lit(max(1000 // target_fps, 400)), F.floor(duration / cap)).cast("long")
    last = F.least(F.lit(cap - 1), F.floor((duration - 1) / step))
    return videos.where(duration > 0).select("video_id", "start_ms", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k")).select("video_id", "k", (F.col("start_ms") + F.col("k") * F.col("step")).alias("at_ms"))


def nearest_in_time(grid: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id, k, at_ms, det_id, gap_ms: for each grid time the detection nearest in time, the smaller id on ties. One pass over both
    sides in time order: the last detection at or before, and the first at or after; no join of all pairs."""
    both = frames.select("video_id", F.col("timestamp_ms").alias("t"), F.lit(0).alias("kind"), "det_id", F.lit(None).cast("long").alias("k"))
    both = both.unionByName(grid.select("video_id", F.col("at_ms").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("det_id"), "k"))
    seen = F.when(F.col("kind") == 0, F.struct("t", "det_id"))
    by_time = W.partitionBy("video_id").orderBy("t", "kind", F.desc("det_id")).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("video_id").orderBy(F.desc("t"), "kind", F.desc("det_id")).rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumn("before", F.last(seen, True).over(by_time)).withColumn("after", F.last(seen, True).over(back)).where("kind = 1")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t")).alias("gap_ms"), F.col(c)["det_id"].alias("det_id")))
    best = F.least(option("before"), option("after"))
    return placed.withColumn("best", best).select("video_id", "k", F.col("t").alias("at_ms"), F.col("best.det_id").alias("det_id"), F.col("best.gap_ms").alias("gap_ms"))


def display_size(rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height after rotation; 1080 x 1920 where unknown."""
    w, h = F.coalesce(width, F.lit(1080)), F.coalesce(height, F.lit(1920))
    turned = rotation.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def scaled_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Both sides scaled down so that the longer is at most so long, even and 16 at least."""
    factor = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    even = lambda x: F.greatest(F.lit(16), (F.floor(x * factor / 2) * 2).cast("int"))
    return even(width), even(height)
