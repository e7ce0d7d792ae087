"""DataFrame operators on small tables."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import scores as S
from sightline.functions import vectors as V
from sightline.operators import relations as R
from sightline.operators import report as P
from sightline.operators import selection as L
from sightline.operators import temporal as T
from sightline.sources import views as X


def points(spark, times):
    return spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "person_id long, us long, det_id long")


@pytest.mark.parametrize(("times", "least", "n"), [([0, 500, 1000, 4000, 4500, 5000, 10000, 10500, 11000], 350, 3), ([0, 500, 1000, 5000, 10000, 10500, 11000], 350, 2), ([0, 400, 1200, 1600], 350, 1), ([7], 350, 1), ([0, 5000], 350, 1), ([], 350, 0)])
def test_appearances(spark, times, least, n):
    found = P.appearances(points(spark, times), ["person_id"], 1200, least).collect()
    assert len(found) == n
    assert [r["index"] for r in sorted(found, key=lambda r: r["start_us"])] == list(range(n))


def test_gap_of_exactly_the_limit_joins(spark):
    assert P.appearances(points(spark, [0, 1200, 2401, 3601]), ["person_id"], 1200, 0).count() == 2


def test_boxes(spark):
    row = spark.range(1).select(G.box(*map(F.lit, (0, 0, 10, 10))).alias("a"), G.box(*map(F.lit, (5, 0, 15, 10))).alias("b"), G.box(*map(F.lit, (50, 50, 60, 60))).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    null = F.lit(None).cast("struct<left int,top int,right int,bottom int>")
    r = row.select(G.iou(a, b), G.iou(a, c), G.over_smaller(a, b), G.iou(a, null), G.continues(a, null), G.motion_score(a, b), G.match_score(a, c, F.lit(True), F.lit(1.0)), G.match_score(a, b, F.lit(False), F.lit(0.1))).first()
    assert r[0] == pytest.approx(50 / 150) and r[1] == 0 and r[2] == pytest.approx(0.5) and r[3] is None and r[4] is False
    assert r[5] == pytest.approx(1 - 0.5 / 1.5) and r[6] == 0 and r[7] == 0


@pytest.mark.parametrize("n", range(1, 17))
def test_layout(spark, n):
    slots = [r["s"] for r in spark.range(n).select(G.grid_slot(F.col("id"), F.lit(n)).alias("s")).collect()]
    edges = [(s["cx"] - s["w"] / 2, s["cy"] - s["h"] / 2, s["cx"] + s["w"] / 2, s["cy"] + s["h"] / 2) for s in slots]
    assert all(l >= 0 and t >= 369.9 and r <= 1080 and b <= 1790.1 for l, t, r, b in edges)
    assert not any(a[0] < b[2] - 0.01 and b[0] < a[2] - 0.01 and a[1] < b[3] - 0.01 and b[1] < a[3] - 0.01 for i, a in enumerate(edges) for b in edges[i + 1 :])


def test_scores_order(spark):
    f = lambda s, y, r, smile, eye, solo: S.rep_score(F.lit(s), F.lit(y), F.lit(r), F.lit(eye), F.lit(eye), F.lit(smile), F.lit(160), F.lit(solo))
    r = spark.range(1).select(f(350.0, 0.0, 0.0, 0.95, 0.95, True), f(40.0, 45.0, 20.0, 0.1, 0.9, True), f(900.0, 0.0, 0.0, 0.5, 0.2, True), f(900.0, 0.0, 0.0, 0.5, 0.9, True)).first()
    assert r[0] > r[1] and r[3] > r[2]


def test_gaussian_blur_cannot_be_reached(spark):
    laps = spark.range(0, 2000).select((F.col("id") / 10.0).alias("lap"))
    kinds = laps.crossJoin(spark.range(0, 21).select((F.col("id") / 20.0).alias("overlap"))).select(T.transition_rule(F.col("lap"), F.lit(0.0), F.col("overlap"))["kind"].alias("k")).distinct()
    assert {r["k"] for r in kinds.collect()} == {None, "WHIP_PAN", "MOTION_BLUR", "DISSOLVE"}


def test_cut_suppression_counts_from_the_last_accepted(spark):
    hits = spark.createDataFrame([(0, t) for t in (100, 700, 1200, 1300, 1900)], "video_id int, at long")
    assert sorted(r["at"] for r in T.suppress_cuts(hits, "video_id", "at", 600).collect()) == [700, 1300, 1900]


def test_scenes(spark):
    total = spark.createDataFrame([(0, 1000), (1, 500)], "video_id int, total long")
    cuts = spark.createDataFrame([(0, 400), (0, 700)], "video_id int, at long")
    got = sorted((r["video_id"], r["scene_id"], r["start"], r["end"], r["confidence"]) for r in T.scenes(cuts, total, "video_id", "at", "total").collect())
    assert got == [(0, 1, 0, 400, 0.95), (0, 2, 400, 700, 0.95), (0, 3, 700, 1000, 0.95), (1, 1, 0, 500, 1.0)]


def test_carry_forward_skips_empty_frames(spark):
    f = spark.createDataFrame([(0, 1.0, False, 2), (1, 0.01, False, 0), (2, 0.5, False, 0), (3, 0.01, False, 5), (4, 0.01, True, 1)], "frame_index long, delta double, boundary boolean, n long")
    got = {r["frame_index"]: (r["is_static"], r["source_frame"]) for r in T.carry_forward(f).collect()}
    assert got[1] == (True, 0) and got[2] == (False, 2) and got[3][0] is False and got[4] == (False, 4)


def test_suppression_of_overlaps_is_greedy(spark):
    rows = [Row(f=0, det_id=i, box=dict(left=l, top=0, right=l + w, bottom=w)) for i, (l, w) in enumerate([(0, 100), (40, 90), (90, 80)])]
    d = spark.createDataFrame(rows, "f long, det_id long, box struct<left:int,top:int,right:int,bottom:int>")
    assert sorted(r["det_id"] for r in R.suppress_overlaps(d, ["f"]).collect()) == [0, 2]


def test_knn_and_vectors(spark):
    rows = [(i, [1.0 if j == i else 0.0 for j in range(16)]) for i in range(3)] + [(9, [0.05, 0.95] + [0.0] * 14)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    top = {r["id"]: r["neighbour"] for r in R.knn(d, "id", "v", 1).collect()}
    assert top[9] == 1
    r = spark.range(1).select(V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))), V.chi_square(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), V.normalise(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert r[0] == 0 and r[1] == 1 and r[2] == pytest.approx([0.6, 0.8])


def test_ranking_prefers_solo_clean_then_quality(spark):
    cols = "person_id long, det_id long, has_crop boolean, solo_portrait boolean, clean boolean, visible boolean, sharpness double, recognition_quality double, frontality double, box struct<left:int,right:int>"
    b = {"left": 0, "right": 100}
    d = spark.createDataFrame([(1, 1, True, False, True, True, 900.0, 0.9, 1.0, b), (1, 2, True, True, False, True, 900.0, 0.9, 1.0, b), (1, 3, True, True, True, True, 400.0, 0.7, 1.0, b), (1, 4, False, True, True, True, 900.0, 0.9, 1.0, b)], cols)
    assert [r["det_id"] for r in L.rank_shots(d, ["person_id"]).orderBy("rank").collect()] == [3, 2]


def test_nearest_in_time(spark):
    grid = spark.createDataFrame([(0, 0, 10), (0, 1, 25), (1, 0, 5)], "video_id long, k long, at_ms long")
    d = spark.createDataFrame([(0, 8, 2), (0, 12, 1), (0, 30, 3)], "video_id long, timestamp_ms long, det_id long")
    got = {(r["video_id"], r["k"]): r["det_id"] for r in X.nearest_in_time(grid, d).collect()}
    assert got == {(0, 0): 1, (0, 1): 3, (1, 0): None}


def test_percentile_rank(spark):
    from sightline.operators.clustering import percentile

    v = F.array(*[F.lit(x / 10) for x in (5, 1, 3, 2, 4)])
    assert list(spark.range(1).select(percentile(v, 0.0), percentile(v, 0.5), percentile(v, 1.0)).first()) == [0.1, 0.3, 0.5]
