"""The whole plan on two subjects that move apart, with a scene boundary between."""

from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.plans import video
from sightline.sources import views as X


def test_two_subjects(spark):
    rows = []
    for frame in range(12):
        for who, (left, vec) in enumerate(((100, [1.0, 0.0]), (700, [0.0, 1.0]))):
            rows.append((1, len(rows), frame, frame * 400_000, left + 5 * frame, vec))
    d = spark.createDataFrame(rows, "video_id long, det_id long, frame_index long, us long, left int, embedding array<float>")
    d = d.withColumn("box", G.box(F.col("left"), F.lit(500), F.col("left") + 120, F.lit(660)))
    for c, v in (("yaw", 0.0), ("roll", 0.0), ("smile", 0.5), ("left_eye", 0.9), ("right_eye", 0.9), ("sharpness", 300.0)):
        d = d.withColumn(c, F.lit(v))
    scored = X.with_scores(X.with_context(d.withColumn("has_crop", F.lit(True)).withColumn("clean", F.lit(True))))
    epochs = spark.range(12).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_index"), (F.col("id") >= 6).cast("long").alias("epoch"))
    out = video.analyse(scored, epochs)
    assert out["tracks"].select("track_id").distinct().count() == 4  # the boundary closes both tracks
    people = out["persons"].collect()
    assert len({r["person_id"] for r in people}) == 2
    assert out["timeline"].count() == 2  # half a second apart: one appearance each
    assert out["totals"].first()["unique_people"] == 2
    assert out["best_shots"].count() == 2
