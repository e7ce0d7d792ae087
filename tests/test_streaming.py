"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import clustering as C
from sightline.operators import temporal as T
from sightline.operators import tracking as K
from sightline.sources import views as X
from sightline.streaming import detect

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def detections(spark, tmp_path):
    d = X.detections(spark, SF).where("video_id < 3")
    cut = d.agg(F.percentile_approx("frame_index", 0.5)).first()[0]
    for k, part in enumerate((d.where(F.col("frame_index") <= cut), d.where(F.col("frame_index") > cut))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    return d, str(tmp_path)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_tracks(spark, detections):
    d, path = detections
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{path}/in")
    got = {(r["video_id"], r["det_id"]): r["track_id"] for r in run(detect.track_stream(stream), "tracks").collect()}
    want = {(r["video_id"], r["det_id"]): r["track_id"] for r in K.by_video(d, K.track_video, "track_id").collect()}
    assert got == want


def test_gap_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 10), (1, 30), (1, 100)], "k long, s long").select("k", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = detect.gap_sessions(rows, "k", "at", "20 seconds", "1 second")
    assert sorted(r["n"] for r in got.collect()) == [1, 3]
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert sorted(r["n"] for r in run(detect.gap_sessions(stream, "k", "at", "20 seconds", "1 second"), "sessions").collect()) in ([3], [1, 3])


def source(spark, rows, path, parts=2):
    """A stream that reads rows in parts micro-batches, by frame_index or start_us."""
    at = "frame_index" if "frame_index" in rows.columns else "start_us"
    cut = rows.agg(F.percentile_approx(at, 0.5)).first()[0]
    for k, part in enumerate((rows.where(F.col(at) <= cut), rows.where(F.col(at) > cut))):
        part.coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_late_frames_can_be_counted(spark, tmp_path):
    rows = "video_id long, det_id long, frame_index long, box struct<left int, top int, right int, bottom int>, epoch long"
    first = spark.createDataFrame([(1, 1, 5, (0, 0, 9, 9), 0), (1, 2, 6, (0, 0, 9, 9), 0), (1, 3, 7, (0, 0, 9, 9), 1)], rows)
    late = spark.createDataFrame([(1, 4, 6, (0, 0, 9, 9), 0), (1, 5, 8, (0, 0, 9, 9), 1)], rows)
    first.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    late.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r["det_id"]: r["track_id"] for r in run(detect.track_stream(stream), "late").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: None, 5: 2}  # a new epoch opens a new track; the late frame has none


def test_frame_deltas(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, [b, b / 2]) for i, b in enumerate((0.5, 0.5, 0.9))], "video_id long, frame_index long, luma array<double>")
    got = run(detect.frame_deltas(source(spark, rows, str(tmp_path))), "deltas")
    assert [round(r["delta"], 6) for r in got.orderBy("frame_index").collect()] == [1.0, 0.0, 0.3]


def test_scenes_and_transitions(spark, tmp_path):
    frames = X.frames(spark, SF).select(F.lit(1).cast("long").alias("video_id"), "frame_index", (F.col("frame_index") * 250).alias("timestamp_ms"), "hist", "brightness", "lap_var")
    rule = T.cut_rule(F.col("chi2"), F.col("ssim"), F.col("edge_change"), F.col("prev_brightness"), F.col("brightness"))
    changes = T.frame_changes(frames).withColumn("cut", rule)
    hits = changes.where("cut is not null")
    accepted = {r["timestamp_ms"] for r in T.suppress_cuts(hits, "video_id", "timestamp_ms", 600).collect()}
    want = {(r["frame_index"], r["cut"], r["timestamp_ms"] in accepted) for r in hits.collect()}
    stream = source(spark, frames.withColumn("edge", F.col("lap_var")), f"{tmp_path}/s")
    got = {(r["frame_index"], r["cut"], r["accepted"]) for r in run(detect.scene_stream(stream, "hist"), "scenes").collect()}
    assert got == want and any(a for *_, a in got) and not all(a for *_, a in got)
    kind = T.transition_rule(F.col("lap_var") / 1000.0, F.col("prev_lap_var") / 1000.0, F.col("overlap"))
    want = {(r["frame_index"], r["t"]["kind"], round(r["t"]["severity"], 9)) for r in changes.select("frame_index", kind.alias("t")).where("t is not null").collect()}
    stream = source(spark, frames.withColumn("lap_var", F.col("lap_var") / 1000.0), f"{tmp_path}/t")
    got = {(r["frame_index"], r["kind"], round(r["severity"], 9)) for r in run(detect.transition_stream(stream), "transitions").collect()}
    assert got == want and got


def test_registry(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16))
    pieces = []
    for i in range(24):
        v = base[i % 4] + rng.normal(size=16) * 0.05
        pieces.append((i % 2, i, i * 1000, [float(x) for x in v / np.linalg.norm(v)], 0.8, [(i // 4, (0, 0, 10, 10) if i % 3 else None)]))
    rows = spark.createDataFrame(pieces, "video_id long, tracklet_id long, start_us long, vector array<double>, quality double, frames array<struct<frame_index: long, box: struct<left: int, top: int, right: int, bottom: int>>>")
    got = {r["tracklet_id"]: r["person_id"] for r in run(detect.register_stream(source(spark, rows, str(tmp_path))), "registry").collect()}
    want = {}
    for video in (0, 1):
        registry = C.Registry()
        for v, i, start, vector, quality, frames in pieces:
            if v == video:
                want[i] = registry.add(C.Piece(i, start / 1000, start / 1000, 1, np.array(vector), quality, {f: None if b is None else tuple(map(float, b)) for f, b in frames}))
        assert registry.all_persons() and registry.profile_of(1).members >= 1
        registry.reset()
        assert registry.all_persons() == [] and registry.profile_of(1) is None
    assert got == want
