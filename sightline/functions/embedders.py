"""Pluggable embedders and detectors, and one embedder that needs no model."""

from __future__ import annotations

import glob
import logging
import os
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import images as I

log = logging.getLogger(__name__)


def embed_with(load: Callable[[], Callable[[np.ndarray], np.ndarray]]):
    """A pandas UDF from array<float> pixels to array<float> for a model that load() gives once a worker."""

    @F.pandas_udf("array<float>", F.PandasUDFType.SCALAR_ITER)
    def embed(batches):
        import pandas as pd

        model = load()
        for pixels in batches:
            yield pd.Series([None if p is None else np.asarray(model(np.asarray(p, np.float32)), np.float32) for p in pixels])

    return embed


def model_file(folder: str, preferred: tuple[str, ...] = ()) -> str | None:
    """The model to load: the first ONNX file, else the first preferred TFLite one, else any TFLite one, else None for the embedder without a model."""
    onnx, lite = sorted(glob.glob(os.path.join(folder, "*.onnx"))), sorted(glob.glob(os.path.join(folder, "*.tflite")))
    named = [p for name in preferred for p in lite if os.path.basename(p) == name]
    return next(iter([*onnx, *named, *lite]), None)


def detect_with(frames: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of a detector: load() gives once a task a function from a frame's row to dicts of schema. A frame on which it fails has one row with
    nothing but detector_error, so failures can be counted and left out."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        detector = load()
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    out += [{**d, "detector_error": None} for d in detector(r)]
                except Exception as e:  # noqa: BLE001  a plug-in may raise anything, and a frame without faces is its outcome
                    log.warning("detector failed: %s", e)
                    out.append({"detector_error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names)

    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"{schema}, detector_error string")
    names = [f.name for f in kind]
    return frames.mapInPandas(run, kind)


def _stacks(widths, heights, pixels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one size, and their images (n, height, width, 3) from interleaved red, green and blue."""
    sizes = np.array([widths, heights], np.int64).T.reshape(-1, 2)
    for size in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == size).all(1))
        yield rows, np.stack([np.frombuffer(pixels[i], np.uint8) if isinstance(pixels[i], bytes) else np.asarray(pixels[i]) for i in rows]).reshape(len(rows), size[1], size[0], 3)


def cell_embedding(width: Column, height: Column, pixels: Column) -> Column:
    """The model-free unit vector of images: 512 numbers, each brought to 112 x 112 unless its sides are smaller multiples of 8."""

    @F.pandas_udf("array<double>")
    def embed(width, height, pixels):
        import pandas as pd

        out = [None] * len(pixels)
        for rows, rgb in _stacks(width, height, pixels.tolist()):
            if rgb.shape[1] % I.CELLS or rgb.shape[2] % I.CELLS or max(rgb.shape[1:3]) > I.EMBED_SIDE:
                rgb = np.stack([I.resized(x, I.EMBED_SIDE, I.EMBED_SIDE) for x in rgb])
            for i, v in zip(rows, I.cell_features(rgb), strict=True):
                out[i] = v
        return pd.Series(out)

    return embed(width, height, pixels)


def image_measures(frames: DataFrame, keep: list[str], side: int | None = None) -> DataFrame:
    """keep, brightness, lap_var, edge, luma, luma_hist, hsv_hist of each of frames(width, height, pixels). Images are brought to side x side first, if asked for."""
    kinds = dict(frames.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            parts = []
            for rows, rgb in _stacks(pdf["width"], pdf["height"], pdf["pixels"].tolist()):
                if side:
                    rgb = np.stack([I.resized(x, side, side) for x in rgb])
                y = I.luma(rgb)
                part = pdf.iloc[rows][keep].copy()
                part["brightness"], part["lap_var"], part["edge"] = y.reshape(len(y), -1).mean(1) / 255, I.laplacian_variance(y), I.edge_density(y / 255)
                part["luma"], part["luma_hist"], part["hsv_hist"] = list(y.reshape(len(y), -1) / 255), list(I.luma_histogram(y)), list(I.hsv_histogram(rgb))
                parts.append(part)
            if parts:
                yield pd.concat(parts)

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", brightness double, lap_var double, edge double, luma array<double>, luma_hist array<double>, hsv_hist array<double>"
    return frames.mapInPandas(run, schema)
