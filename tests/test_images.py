"""Images, videos with a decoder plugged in, embedders, detectors and sinks."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import embedders as E
from sightline.functions import images as I
from sightline.sources import videos as V


def picture(h=16, w=24, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def plain_cells(rgb):
    """The model-free vector pixel by pixel."""
    h, w = rgb.shape[:2]
    ch, cw = h // 8, w // 8
    light = lambda p: 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]
    out = []
    for gy in range(8):
        for gx in range(8):
            sums, grad = np.zeros(4), 0.0
            for y in range(gy * ch, gy * ch + ch):
                for x in range(gx * cw, gx * cw + cw):
                    p = rgb[y, x].astype(float)
                    sums += [*p, light(p)]
                    if x > 0 and y > 0:
                        grad += abs(light(p) - float(rgb[y, x - 1, 2])) + abs(light(p) - float(rgb[y - 1, x, 2]))
            n = ch * cw * 255
            out += [*(sums / n), grad / n, (sums[0] - sums[2]) / n, (sums[1] - sums[0]) / n, sums[3] / (sums[0] + 1)]
    v = np.array(out)
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("size", [(8, 8), (16, 24), (112, 112)])
def test_cell_features(size):
    rgb = picture(*size)
    assert I.cell_features(rgb[None])[0] == pytest.approx(plain_cells(rgb))
    assert len(I.cell_features(rgb[None])[0]) == 512


def test_measures_by_hand():
    flat = np.full((1, 8, 8, 3), 100)
    assert I.laplacian_variance(I.luma(flat))[0] == pytest.approx(0, abs=1e-18) and I.edge_density(I.luma(flat) / 255)[0] == pytest.approx(0, abs=1e-12)
    assert I.luma_histogram(I.luma(flat))[0].argmax() == int(100 / 256 * 31.99)
    colours = np.array([[[[255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0], [255, 255, 255]]]])
    assert I.hsv(colours)[0, 0].tolist() == [[0, 1, 1], [120, 1, 1], [240, 1, 1], [0, 0, 0], [0, 0, 1]]
    assert I.hsv_histogram(colours)[0].sum() == pytest.approx(1)
    assert I.laplacian_variance(np.zeros((2, 2, 2))).tolist() == [0, 0] and I.sharpness(picture(3, 3)) == 0.0
    assert I.sharpness(picture(40, 40)) > I.sharpness(I.resized(I.resized(picture(40, 40), 5, 5), 40, 40))


def test_transforms():
    rgb = picture(40, 30)
    assert np.array_equal(I.resized(rgb, 30, 40), rgb)
    assert I.region(rgb, 10, 10, 100, 100, 15).shape == (15, 10, 3)
    straight = I.aligned(rgb, (5, 10, 25, 30), 20, share=1.0)
    assert straight == pytest.approx(rgb[10:30, 5:25].astype(float))
    turned = I.aligned(np.rot90(rgb, -1), (10, 5, 30, 25), 20, left_eye=(15, 25), right_eye=(15, 5), share=1.0)
    assert turned == pytest.approx(np.rot90(rgb, -1)[5:25, 10:30].astype(float))  # a turn of 90 degrees is not believed
    eye = math.radians(20)
    leaning = I.aligned(rgb, (5, 10, 25, 30), 20, left_eye=(math.cos(eye), math.sin(eye)), right_eye=(0, 0), share=1.0)
    assert not np.allclose(leaning, straight) and leaning == pytest.approx(I.aligned(rgb, (5, 10, 25, 30), 20, roll=20.0, share=1.0))
    assert I.perturbed(rgb).shape == rgb.shape and I.perturbed(rgb, 0.0, 1.0) == pytest.approx(rgb.astype(float))
    assert I.fixed_input(rgb).shape == (3, 40, 30) and abs(I.fixed_input(rgb)).max() <= 1
    white = I.prewhitened(rgb)
    assert white.mean() == pytest.approx(0, abs=1e-5) and white.std() == pytest.approx(1, abs=1e-4)
    assert np.isfinite(I.prewhitened(np.zeros((4, 4, 3)))).all()


def test_flip_average():
    rgb = picture()
    model = lambda x: x.mean((1, 2)) if x is not None else None
    left = lambda x: x[:, :, 0].mean(1)
    assert I.flip_averaged(rgb, left, I.fixed_input) == pytest.approx(I.unit(left(I.fixed_input(rgb)) + left(I.fixed_input(rgb[:, ::-1]))))
    assert I.flip_averaged(rgb, model, I.fixed_input) == pytest.approx(I.unit(model(I.fixed_input(rgb)).astype(float)))
    calls = iter([np.array([3.0, 4.0]), None])
    assert I.flip_averaged(rgb, lambda x: next(calls), I.fixed_input) == pytest.approx([0.6, 0.8])
    assert len(I.flip_averaged(rgb, lambda x: None, I.fixed_input)) == 0


def test_model_files(tmp_path):
    assert E.model_file(str(tmp_path)) is None
    for name in ("z.tflite", "a.tflite"):
        (tmp_path / name).write_bytes(b"")
    assert E.model_file(str(tmp_path)).endswith("a.tflite") and E.model_file(str(tmp_path), ("z.tflite",)).endswith("z.tflite")
    (tmp_path / "m.onnx").write_bytes(b"")
    assert E.model_file(str(tmp_path), ("z.tflite",)).endswith("m.onnx")


def test_scan_detect_embed(spark, tmp_path):
    class Holes(V.ArrayVideo):
        """Every third request fails, some by raising."""

        def frame_at(self, ms, longest):
            if ms % 1200 == 0:
                if ms:
                    raise ValueError("no frame")
                return None
            return super().frame_at(ms, longest)

    def open_arrays(content):
        return V.ArrayVideo(np.load(io.BytesIO(content)), 100)

    def open_holes(content):
        return Holes(np.load(io.BytesIO(content)), 100, rotation=90)

    def open_nothing(content):
        raise ValueError("unknown format")

    frames = np.stack([np.full((20, 12, 3), k, np.uint8) for k in range(40)])
    for name in ("a", "b"):
        with open(tmp_path / name, "wb") as out:
            np.save(out, frames)
    (tmp_path / "broken").write_bytes(b"nothing")
    found = V.scan_videos(spark, f"file://{tmp_path}", [open_nothing, open_holes]).cache()
    seen = found.where("path like '%/a'").orderBy("frame_index").collect()
    assert [r["timestamp_ms"] for r in seen] == [t for t in range(0, 4000, 400) if t % 1200] and [r["frame_index"] for r in seen] == list(range(len(seen)))
    assert {(r["display_width"], r["display_height"]) for r in seen} == {(20, 12)}
    assert {r["path"].rsplit("/", 1)[1]: (r["frames_delivered"], r["last_timestamp_ms"]) for r in V.sweeps(found).collect()} == {"a": (6, 3200), "b": (6, 3200), "broken": (0, 0)}
    whole = V.scan_videos(spark, f"file://{tmp_path}/a", [open_arrays], target_fps=100.0)
    assert whole.count() == 10 and max(len(V.grid(d)) for d in (1, 10_000, 100_000, 999_999)) <= 29

    def load():
        def detector(row):
            if row["frame_index"] == 2:
                raise RuntimeError("bad frame")
            return [{"frame_index": row["frame_index"], "left": k} for k in range(row["frame_index"] % 3)]

        return detector

    faces = E.detect_with(found.where("path like '%/a'").select("frame_index", "pixels"), load, "frame_index int, left int").collect()
    assert sorted(r["frame_index"] for r in faces if r["detector_error"] is None) == [1, 4, 5, 5]
    assert [r["detector_error"] for r in faces if r["detector_error"]] == ["RuntimeError: bad frame"]
    vectors = found.where("path like '%/a'").select("frame_index", E.cell_embedding(F.col("width"), F.col("height"), F.col("pixels")).alias("v")).collect()
    assert all(len(r["v"]) == 512 and np.linalg.norm(r["v"]) == pytest.approx(1) for r in vectors)
    embed = E.embed_with(lambda: lambda p: p[:2] * 2)
    assert spark.createDataFrame([([1.0, 2.0, 3.0],), (None,)], "p array<float>").select(embed("p").alias("v")).collect()[0]["v"] == [2.0, 4.0]


def test_sinks_and_progress(spark, tmp_path):
    rows = spark.range(5)
    paths = V.save_results({"persons": rows, "timeline": rows.where("id > 2")}, f"file://{tmp_path}/out")
    assert spark.read.parquet(paths["timeline"]).count() == 2
    with pytest.raises(Exception, match="already exists"):
        V.save_results({"persons": rows}, f"file://{tmp_path}/out")
    assert spark.read.json(V.export_json(rows, f"file://{tmp_path}/json")).count() == 5
    heard = []
    watched, report = V.observed(rows, "rows", lambda name, counts: heard.append((name, counts["rows"])))
    watched.write.format("noop").mode("overwrite").save()
    report()
    assert heard == [("rows", 5)]
