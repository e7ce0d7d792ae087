"""Videos as files with a decoder plugged in, and the sinks of results."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: Defaults of what a file does not tell, least step between frames, and most frames a video and their longest side.
DURATION_MS, WIDTH, HEIGHT = 10_000, 1080, 1920
LEAST_STEP_MS, MOST_FRAMES, LONGEST_SIDE = 400, 28, 480


class Session(Protocol):
    """An open video: what it tells of itself (None where it does not), and its frame at a time, or None where that can't be decoded."""

    duration_ms: int | None
    width: int | None
    height: int | None
    rotation: int | None

    def frame_at(self, ms: int, longest: int) -> np.ndarray | None: ...


class ArrayVideo:
    """Frames (n, height, width, 3) at a fixed step: a session for tests and for video that is decoded already."""

    def __init__(self, frames: np.ndarray, step_ms: int, rotation: int | None = 0, duration_ms: int | None = None) -> None:
        self.frames, self.step_ms, self.rotation = frames, step_ms, rotation
        self.height, self.width = frames.shape[1:3]
        self.duration_ms = len(frames) * step_ms if duration_ms is None else duration_ms

    def frame_at(self, ms: int, longest: int) -> np.ndarray | None:
        from sightline.functions.images import region

        at = ms // self.step_ms
        return region(self.frames[at], 0, 0, self.width, self.height, longest) if at < len(self.frames) else None


def grid(duration_ms: int, target_fps: float = 3.0) -> range:
    """The times that frames are asked for at."""
    return range(0, duration_ms, max(int(1000 / target_fps), LEAST_STEP_MS, duration_ms // MOST_FRAMES))


def _opened(openers: list[Callable[[bytes], Session]], content: bytes) -> Session | None:
    for opener in openers:
        try:
            return opener(content)
        except Exception as e:  # noqa: BLE001  the next way to open it is tried
            log.warning("a decoder could not open the video: %s", e)
    return None


def scan_videos(spark: SparkSession, path: str, openers: list[Callable[[bytes], Session]], target_fps: float = 3.0, longest: int = LONGEST_SIDE) -> DataFrame:
    """path, frame_index, timestamp_ms, width, height, pixels, display_width, display_height, duration_ms of the sampled frames of all videos below path.

    The openers are tried in order until one opens a video; a video that none does, or of which no frame decodes, has one row with null frame_index. A
    frame that can't be decoded is passed over without using an index, and at most MOST_FRAMES are delivered. Frames leave one by one.
    """
    schema = "path string, frame_index int, timestamp_ms long, width int, height int, pixels binary, display_width int, display_height int, duration_ms long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                video, delivered = _opened(openers, content), 0
                duration, shown = None, (None, None)
                if video is not None:
                    duration = DURATION_MS if video.duration_ms is None else int(video.duration_ms)
                    shown = (video.width or WIDTH, video.height or HEIGHT)
                    if video.rotation in (90, 270):
                        shown = shown[::-1]
                    for ms in grid(duration, target_fps):
                        try:
                            rgb = video.frame_at(ms, longest)
                        except Exception as e:  # noqa: BLE001  as if it were not there
                            log.warning("no frame of %s at %d: %s", name, ms, e)
                            rgb = None
                        if rgb is None or delivered >= MOST_FRAMES:
                            continue
                        pixels = np.asarray(rgb).round().clip(0, 255).astype(np.uint8)
                        yield pd.DataFrame([(name, delivered, ms, pixels.shape[1], pixels.shape[0], pixels.tobytes(), *shown, duration)], columns=columns)
                        delivered += 1
                if not delivered:
                    yield pd.DataFrame([(name, None, None, None, None, None, *shown, duration)], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def sweeps(frames: DataFrame) -> DataFrame:
    """path, frames_delivered, duration_ms, last_timestamp_ms of each video scanned; zeros where nothing was delivered."""
    return frames.groupBy("path").agg(F.count("frame_index").alias("frames_delivered"), F.coalesce(F.max("duration_ms"), F.lit(0)).alias("duration_ms"), F.coalesce(F.max("timestamp_ms"), F.lit(0)).alias("last_timestamp_ms"))


def save_results(results: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """Each result as a Parquet table below folder, by Spark's committer: a table is there whole or not at all."""
    paths = {name: f"{folder}/{name}" for name in results}
    for name, df in results.items():
        df.write.mode(mode).parquet(paths[name])
    return paths


def export_json(result: DataFrame, path: str, files: int = 1) -> str:
    """A result for other programs, as JSON lines in so many files; for reports, whose rows are few."""
    result.coalesce(files).write.mode("overwrite").json(path)
    return path


def observed(df: DataFrame, name: str, progress: Callable[[str, dict], None]) -> tuple[DataFrame, Callable[[], None]]:
    """df with its rows counted as they pass; the function given back reports (name, counts) to progress once an action has run."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), lambda: progress(name, watch.get)
