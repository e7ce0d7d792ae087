"""The whole analysis of videos: detections to tracks, identities, persons, appearances and reports; tracks and persons are materialised where spark.checkpoint.dir is named."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import clustering as C
from sightline.operators import report as P
from sightline.operators import selection as L
from sightline.operators import temporal as T
from sightline.operators import tracking as K


def tracklet_identities(tracked: DataFrame, per_track: int = 2, floor: float = 0.1) -> DataFrame:
    """video_id, track_id, vector (unit centroid of the best faces by recognition quality), quality, n_det, start_us, end_us, frames (frame and first
    box there). tracked has track_id, embedding and the scores. Vectors are read for the chosen faces only."""
    key = ["video_id", "track_id"]
    chosen = L.top_faces(tracked.where("embedding is not null"), key, per_track)
    # a track has a few chosen faces at most, so their sum is one expression over a short list
    weight = F.greatest(F.lit(floor), F.coalesce(F.col("recognition_quality"), F.lit(1.0)))
    packed = chosen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", F.transform("embedding", lambda x: x.cast("double") * weight).alias("v")))).alias("faces"), F.avg("recognition_quality").alias("quality"))
    sums = F.aggregate("faces", F.array().cast("array<double>"), lambda total, face: F.zip_with(total, face["v"], lambda x, y: F.coalesce(x + y, x, y)))
    norm = F.greatest(F.sqrt(F.aggregate("sums", F.lit(0.0), lambda total, x: total + F.coalesce(x * x, F.lit(0.0)))), F.lit(1e-8))
    unit = F.when(F.size("sums") > 0, F.transform("sums", lambda x: x / F.col("norm")))
    packed = packed.withColumn("sums", sums).withColumn("norm", norm).select(*key, unit.alias("vector"), "quality")
    first = tracked.groupBy(*key, "frame_index").agg(F.min_by("box", "det_id").alias("box"), F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    shape = first.groupBy(*key).agg(F.sum("n").alias("n_det"), F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sort_array(F.collect_list(F.struct("frame_index", "box"))).alias("frames"))
    return shape.join(packed, key, "left")


def persons(identities: DataFrame, least: float = 0.65) -> DataFrame:
    """video_id, track_id, person_id by constrained label propagation, one call a video over its tracks."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = table.num_rows
        order = pc.sort_indices(table.select(["start_us", "track_id"]), [("start_us", "ascending"), ("track_id", "ascending")]).to_numpy()
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        start, end, count, video, track = (table[c].to_numpy()[order] for c in ("start_us", "end_us", "n_det", "video_id", "track_id"))
        # vectors and frames go to their places part by part, so no second table is held
        has = table["vector"].is_valid().to_numpy()[order]
        sizes = pc.list_value_length(table["frames"]).to_numpy()[order]
        at, offsets = np.cumsum(has) - 1, np.r_[0, np.cumsum(sizes)].astype(np.int64)
        wide = pc.max(pc.list_value_length(table["vector"])).as_py() or 0 if has.any() else 1
        vectors, frames, boxes = np.zeros((int(has.sum()), wide)), np.zeros(offsets[-1], np.int64), np.full((offsets[-1], 4), np.nan)
        seen = 0
        for batch in table.select(["vector", "frames"]).to_batches(max_chunksize=8192):
            here = place[seen : seen + batch.num_rows]
            seen += batch.num_rows
            vector, frame = batch.columns
            vectors[at[here[has[here]]]] = vector.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            index, box = frame.flatten().flatten()
            to = np.repeat(offsets[here] - np.r_[0, np.cumsum(sizes[here])[:-1]], sizes[here]) + np.arange(len(index))
            frames[to] = index.to_numpy()
            known = box.is_valid().to_numpy(zero_copy_only=False)
            for k, c in enumerate(("left", "top", "right", "bottom")):
                boxes[to[known], k] = box.field(c).cast("double").to_numpy(zero_copy_only=False)[known]
        del table, batch, vector, frame, index, box
        ids = C.propagate(start / 1000, end / 1000, count, vectors, has, offsets, frames, boxes, boxes[offsets[:-1]], boxes[offsets[1:] - 1], least, 8, 15, 1200.0)
        return pa.table([pa.array(video), pa.array(track), pa.array(ids, pa.int32())], names=["video_id", "track_id", "person_id"])

    return identities.select("video_id", "track_id", "start_us", "end_us", "n_det", "vector", "frames").groupBy("video_id").applyInArrow(run, "video_id long, track_id int, person_id int")


def kept(d: DataFrame) -> DataFrame:
    """d as a Parquet table below spark.checkpoint.dir, so that what reads it again doesn't compute it again; d as it is where no such folder is named."""
    spark = d.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return d
    path = f"{root}/video-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return spark.read.schema(d.schema).parquet(path)


def analyse(scored: DataFrame, epochs: DataFrame | None = None, gap_us: int = 1_500_000, least_us: int = 350_000, similarity: float = 0.65) -> dict[str, DataFrame]:
    """DataFrames tracks, persons, timeline, best_shots and totals of scored detections (video_id, det_id, frame_index, us, box, embedding, scores).

    epochs(video_id, frame_index, epoch) closes tracks at scene boundaries. Persons are numbered within their video by detections, then start.
    """
    faces = scored if epochs is None else scored.join(epochs, ["video_id", "frame_index"], "left").fillna({"epoch": 0})
    tracks = kept(K.tracks_in_order(faces, kept))
    tracked = scored.join(tracks, ["video_id", "det_id"])
    people = kept(persons(tracklet_identities(tracked), similarity))
    seen = tracked.join(people, ["video_id", "track_id"]).withColumn("subject", F.struct("video_id", "person_id"))
    key = ["video_id", "person_id"]
    spans = seen.groupBy(*key, "track_id").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    # whole tracks are merged by gap, not single detections: a track may pause for longer
    merged = T.gap_segments(spans, key, "start", "end", gap_us, "track_id")
    timeline = T.keep_long(merged.groupBy(*key, "seg").agg(F.min("start").alias("start_us"), F.max("end").alias("end_us"), F.count(F.lit(1)).alias("n_det")), key, least_us)
    return {
        "tracks": tracks,
        "persons": people,
        "timeline": P.ordered_timeline(timeline.select(*key, "index", "start_us", "end_us"), ["video_id"], "person_id"),
        "best_shots": L.first_shots(tracked, people, ["video_id", "track_id"], key),
        "totals": P.totals(timeline.withColumn("subject", F.struct("video_id", "person_id")), "subject"),
    }
