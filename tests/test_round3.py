"""Best shots and persons of large videos: what is held, and that it gives the same."""

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import clustering as C
from sightline.operators import selection as L
from sightline.queries import QUERIES


def test_first_shots_are_those_of_rank_one_without_windows(spark):
    rng = np.random.default_rng(4)
    pick = lambda *x: x[rng.integers(len(x))]
    rows = []
    for i in range(3000):
        flags = [pick(True, False, None) for _ in range(4)]
        measures = [pick(None, float("nan"), -0.0, 0.0, 39.9999999999, 40.0, 90.0) for _ in range(3)]
        rows.append((i % 3, i % 301, i * 7 - 9000, *flags, *measures, pick(None, (0.0, 0.0, 5.0, 9.0), (0.0, 0.0, 8.0, 9.0))))
    box = "struct<left: double, top: double, right: double, bottom: double>"
    names = "has_crop boolean, solo_portrait boolean, clean boolean, visible boolean, sharpness double, recognition_quality double, frontality double"
    scored = spark.createDataFrame(rows, f"video_id long, track_id int, det_id long, {names}, box {box}").where("video_id = track_id % 3 or track_id < 60")
    owners = scored.select("video_id", "track_id").distinct().withColumn("person_id", F.col("track_id") % 50)
    key = ["video_id", "person_id"]
    got = L.first_shots(scored, owners, ["video_id", "track_id"], key)
    want = L.rank_shots(scored.join(owners, ["video_id", "track_id"]), key).where("rank = 1").select(*key, "det_id")
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in got._jdf.queryExecution().toString()


def test_best_shots_of_a_video_rank_no_rows_of_persons(spark):
    best = QUERIES["q_video_best_shots"](spark, "/root/testdata/sf0.001")
    windows = re.findall(r"windowspecdefinition\([^)]*person_id", best._jdf.queryExecution().analyzed().toString())
    assert not windows


def _crowd(n: int, each: int):
    """Tracklets in order of time, each in so many frames, of persons whose vectors are alike: start, end, count, vectors, has, offsets, frames, boxes."""
    rng = np.random.default_rng(1)
    vectors = np.eye(16)[rng.integers(0, 16, n)] + rng.standard_normal((n, 16)) * 0.1
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    start = np.sort(rng.integers(0, 700, n))
    frames = (start[:, None] + np.arange(each)).ravel()
    left = np.repeat(rng.integers(0, 5, n) * 150.0, each)
    boxes = np.stack([left, left * 0, left + 120, left * 0 + 160], 1)
    return start.astype(float), start + each - 1.0, np.full(n, each), vectors, np.ones(n, bool), np.arange(n + 1) * each, frames, boxes


def test_persons_of_many_tracklets_are_found_in_arrays(monkeypatch):
    n, each = 6000, 3
    crowd = _crowd(n, each)
    pieces = [C.Piece(t, crowd[0][t], crowd[1][t], each, crowd[3][t], 1.0, {int(crowd[6][r]): tuple(crowd[7][r]) for r in range(t * each, t * each + each)}, tuple(crowd[7][t * each]), tuple(crowd[7][t * each + each - 1])) for t in range(n)]
    want = C.propagate_labels(pieces, 0.65)
    likeliest = C._likeliest

    def searched(*a):
        found = likeliest(*a)
        tracemalloc.reset_peak()  # what the search of neighbours holds for a while is not asked here
        return found

    monkeypatch.setattr(C, "_likeliest", searched)
    tracemalloc.start()
    got = C.propagate(*crowd, crowd[7][crowd[5][:-1]], crowd[7][crowd[5][1:] - 1], 0.65, 8, 15, 1200.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [want[t] for t in range(n)] == got.tolist()
    assert peak < 1400 * n, peak / n


def test_a_tracklet_never_moved_keeps_no_rows():
    places = C._Places(np.array([0, 2, 3, 3, 4]), np.array([5, 1, 5, 9]), np.array([[0.0, 0, 10, 10], [0, 0, 10, 10], [50, 0, 60, 10], [0, 0, 10, 10]]))
    assert [[places.allowed(t, g) for g in range(4)] for t in range(4)] == [[True, False, True, True], [False, True, True, True], [True] * 4, [True] * 4]
    assert not places.groups
    places.move(3, 3, 0)
    assert places.groups == {3: {}, 0: {5: 0, 1: 1, 9: 3}}
