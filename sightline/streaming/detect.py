"""Structured Streaming forms of the incremental operators. State is one row a video; with idle_ms it goes after so long without a new one, which needs a
trigger that runs on (an availableNow query would wait for timeouts for ever)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.clustering import Piece, Registry
from sightline.operators.tracking import Tracker, faces_of

#: Accepted cuts are at least so many milliseconds of the frames' time apart.
CUT_GAP = 600


def gap_sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of runs without a longer pause. A pause of exactly the gap does not split. end is the last event's time."""
    s = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("end"))
    return s.select(key, "start", "end", "n")


def tumbling_counts(stream: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", by, "n")


def _by_video(rows: DataFrame, order: list[str], start: Callable[[], object], step: Callable, out: str, idle_ms: int | None) -> DataFrame:
    """step(state, rows in order) -> (state, list of rows without the video) for each video and micro-batch; the state is pickled between them."""
    columns = ["video_id", *[c.split()[0] for c in out.split(", ")]]

    def run(key, batches: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        held = pickle.loads(state.get[0]) if state.exists else start()
        held, found = step(held, pd.concat(list(batches)).sort_values(order))
        state.update((pickle.dumps(held),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *f) for f in found], columns=columns)

    return rows.groupBy("video_id").applyInPandasWithState(run, f"video_id long, {out}", "held binary", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def track_stream(detections: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """video_id, det_id, track_id over a stream of detections(video_id, det_id, frame_index, box) and, if it has them, epoch, embedding and tracking_id. State
    is each video's tracker, whose tracks keep a filter and their last vectors. A new epoch closes all tracks. Frames must arrive whole and in order by video;
    within a micro-batch rows are put in order, and rows of a frame not after the last one seen have a null track_id, so that they can be counted."""

    def step(held, pdf):
        tracker, last = held
        out = []
        for frame, here in pdf.groupby("frame_index", sort=True):
            faces = faces_of(here)
            if last is not None and frame <= last:
                out += [(f.det_id, None) for f in faces]
                continue
            for _ in range(0 if last is None else min(int(frame) - last - 1, tracker.max_age + 2)):
                tracker.step([], tracker.epoch)
            ids, _ = tracker.step(faces, faces[0].epoch)
            out += [(f.det_id, i) for f, i in zip(faces, ids, strict=True)]
            last = int(frame)
        return (tracker, last), out

    columns = [c for c in ("video_id", "det_id", "frame_index", "box", "epoch", "embedding", "tracking_id") if c in detections.columns]
    return _by_video(detections.select(*columns), ["frame_index", "det_id"], lambda: (Tracker(), None), step, "det_id long, track_id int", idle_ms)


def frame_deltas(frames: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """video_id, frame_index, delta over a stream of frames(video_id, frame_index, luma array<double>): the mean absolute change from the frame before, 1 at the first."""

    def step(last, pdf):
        out = []
        for at, luma in zip(pdf["frame_index"].tolist(), pdf["luma"], strict=True):
            now = np.asarray(luma, float)
            out.append((int(at), 1.0 if last is None else float(np.abs(now - last).mean())))
            last = now
        return last, out

    return _by_video(frames.select("video_id", "frame_index", "luma"), ["frame_index"], lambda: None, step, "frame_index long, delta double", idle_ms)


def chi_square(a: np.ndarray, b: np.ndarray) -> float:
    both = a + b
    return float(np.clip(0.5 * (np.where(both > 1e-6, (a - b) ** 2 / np.where(both > 1e-6, both, 1.0), 0.0)).sum(), 0, 1))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    m, n = a.mean(), b.mean()
    value = (2 * m * n + 1e-4) * (2 * ((a * b).mean() - m * n) + 9e-4) / ((m * m + n * n + 1e-4) * ((a * a).mean() - m * m + (b * b).mean() - n * n + 9e-4))
    return float(np.clip(value, 0, 1))


def relative_change(a: float, b: float) -> float:
    return abs(b - a) / max(0.01, a, b)


def boundary_kind(chi: float, like: float, edge: float, before: float, now: float) -> str | None:
    """temporal.cut_rule() for numbers."""
    if chi > 0.42 and like < 0.65:
        return "HARD_CUT"
    if (before < 0.08 and now > 0.18) or (before > 0.18 and now < 0.08):
        return "FADE_IN" if now > before else "FADE_OUT"
    if chi > 0.28 and like < 0.72 and edge < 0.35:
        return "CROSS_DISSOLVE"
    return "ZOOM_TRANSITION" if edge > 0.65 and chi > 0.28 and like < 0.60 else None


def transition_kind(lap: float, before: float, overlap: float) -> tuple[str, float] | None:
    """temporal.transition_rule() for numbers."""
    hf = lap / (lap + 60.0)
    if hf < 0.08 and overlap < 0.55:
        return "WHIP_PAN", 1 - hf / 0.08
    if lap < 45 and hf < 0.12:
        return "MOTION_BLUR", 1 - lap / 45.0
    if hf < 0.06 and overlap >= 0.70:
        return "GAUSSIAN_BLUR", 1 - hf / 0.06
    return ("DISSOLVE", 0.75) if 0.50 <= overlap <= 0.72 and abs(lap - before) > 30 else None


def scene_stream(frames: DataFrame, signal: str = "luma", idle_ms: int | None = None) -> DataFrame:
    """video_id, frame_index, cut, accepted of each boundary over a stream of frames(video_id, frame_index, timestamp_ms, hist, brightness, edge and a signal to
    compare by structure). State is the last frame's features and the time of the last accepted cut, 0 at first; a boundary sooner than CUT_GAP after that is not accepted."""

    def step(held, pdf):
        last, accepted = held
        out = []
        for at, ms, hist, bright, edge, values in zip(pdf["frame_index"].tolist(), pdf["timestamp_ms"].tolist(), pdf["hist"], pdf["brightness"].tolist(), pdf["edge"].tolist(), pdf[signal], strict=True):
            now = (np.asarray(hist, float), bright, edge, np.asarray(values, float))
            if last is not None:
                kind = boundary_kind(chi_square(last[0], now[0]), ssim(last[3], now[3]), relative_change(last[2], edge), last[1], bright)
                if kind:
                    good = ms - accepted >= CUT_GAP
                    accepted = ms if good else accepted
                    out.append((int(at), kind, good))
            last = now
        return (last, accepted), out

    columns = list(dict.fromkeys(["video_id", "frame_index", "timestamp_ms", "hist", "brightness", "edge", signal]))
    return _by_video(frames.select(*columns), ["frame_index"], lambda: (None, 0), step, "frame_index long, cut string, accepted boolean", idle_ms)


def transition_stream(frames: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """video_id, frame_index, kind, severity of each transition over a stream of frames(video_id, frame_index, hist, lap_var); state is the frame before."""

    def step(last, pdf):
        out = []
        for at, hist, lap in zip(pdf["frame_index"].tolist(), pdf["hist"], pdf["lap_var"].tolist(), strict=True):
            now = (np.asarray(hist, float), lap)
            found = None if last is None else transition_kind(lap, last[1], float(np.minimum(last[0], now[0]).sum()))
            if found:
                out.append((int(at), found[0], float(np.clip(found[1], 0, 1))))
            last = now
        return last, out

    return _by_video(frames.select("video_id", "frame_index", "hist", "lap_var"), ["frame_index"], lambda: None, step, "frame_index long, kind string, severity double", idle_ms)


def register_stream(tracklets: DataFrame, least: float = 0.46, idle_ms: int | None = None) -> DataFrame:
    """video_id, tracklet_id, person_id over a stream of tracklets(video_id, tracklet_id, start_us, vector, quality, frames array of frame_index and box). State is
    each video's registry: a profile a person and the places it was seen at."""

    def step(registry, pdf):
        out = []
        for i, begin, vector, quality, frames in zip(pdf["tracklet_id"].tolist(), pdf["start_us"].tolist(), pdf["vector"], pdf["quality"].tolist(), pdf["frames"], strict=True):
            seen = {int(f["frame_index"]): None if f["box"] is None else tuple(float(f["box"][c]) for c in ("left", "top", "right", "bottom")) for f in frames}
            piece = Piece(int(i), begin / 1000, begin / 1000, len(seen), None if vector is None else np.array(vector, float), float(quality), seen)
            out.append((int(i), registry.add(piece)))
        return registry, out

    return _by_video(tracklets.select("video_id", "tracklet_id", "start_us", "vector", "quality", "frames"), ["start_us", "tracklet_id"], lambda: Registry(least), step, "tracklet_id long, person_id int", idle_ms)
