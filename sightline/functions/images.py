"""Measures and transforms of images, vectorised over a batch of equal size: arrays (n, height, width, 3) of 0..255."""

from __future__ import annotations

import math

import numpy as np

#: Weights of red, green and blue in luma.
LUMA = np.array([0.299, 0.587, 0.114])
HSV_BINS = (16, 4, 4)
LUMA_BINS = 32
#: Cells a side of the model-free embedding, and the side an image is brought to before.
CELLS, EMBED_SIDE = 8, 112


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.asarray(rgb, float) @ LUMA


def sample(rgb: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of one image (height, width, 3) at places; black outside."""
    rgb = np.asarray(rgb, float)
    h, w = rgb.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, rgb.shape[2]))
    for dy in (0, 1):
        for dx in (0, 1):
            at_x, at_y = x0 + dx, y0 + dy
            share = (1 - np.abs(x - at_x)) * (1 - np.abs(y - at_y)) * ((at_x >= 0) & (at_x < w) & (at_y >= 0) & (at_y < h))
            out += share[..., None] * rgb[at_y.clip(0, h - 1), at_x.clip(0, w - 1)]
    return out


def resized(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image at another size, bilinear between pixel centres, edges held."""
    h, w = np.shape(rgb)[:2]
    if (w, h) == (width, height):
        return np.asarray(rgb, float)
    x = ((np.arange(width) + 0.5) * w / width - 0.5).clip(0, w - 1)
    y = ((np.arange(height) + 0.5) * h / height - 0.5).clip(0, h - 1)
    return sample(rgb, *np.meshgrid(x, y))


def region(rgb: np.ndarray, left: int, top: int, width: int, height: int, most: int) -> np.ndarray:
    """A region cut to the image, scaled down so that its longer side is at most so long."""
    h, w = np.shape(rgb)[:2]
    width, height = max(1, min(width, w - left)), max(1, min(height, h - top))
    part = np.asarray(rgb)[top : top + height, left : left + width]
    scale = min(1.0, most / max(width, height))
    return resized(part, max(1, int(width * scale)), max(1, int(height * scale)))


def aligned(rgb: np.ndarray, box: tuple[int, int, int, int], side: int, left_eye=None, right_eye=None, roll: float = 0.0, share: float = 0.8, most_roll: float = 35.0) -> np.ndarray:
    """A square image of a face, upright: its centre in the middle, its longer side a share of the square, turned by the line between the eyes
    or, without them, the roll; a turn of more than most_roll degrees is not believed."""
    if left_eye is not None and right_eye is not None:
        roll = math.degrees(math.atan2(left_eye[1] - right_eye[1], left_eye[0] - right_eye[0]))
    angle = math.radians(roll if abs(roll) <= most_roll else 0.0)
    scale = max(1, box[2] - box[0], box[3] - box[1]) / (side * share)
    x, y = np.meshgrid(np.arange(side) + 0.5 - side / 2, np.arange(side) + 0.5 - side / 2)
    cos, sin = math.cos(angle) * scale, math.sin(angle) * scale
    return sample(rgb, cos * x - sin * y + (box[0] + box[2]) / 2 - 0.5, sin * x + cos * y + (box[1] + box[3]) / 2 - 0.5)


def perturbed(rgb: np.ndarray, shift: float = 0.03, scale: float = 0.96) -> np.ndarray:
    """An image moved by a share of its sides and then drawn in about its middle."""
    h, w = np.shape(rgb)[:2]
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    return sample(rgb, (x - w / 2) / scale + w / 2 - shift * w - 0.5, (y - h / 2) / scale + h / 2 - shift * h - 0.5)


def laplacian_variance(y: np.ndarray) -> np.ndarray:
    """Variance of the Laplacian inside each luma image (n, height, width); 0 where there is no inside."""
    if min(y.shape[1:]) < 3:
        return np.zeros(len(y))
    lap = 4 * y[:, 1:-1, 1:-1] - y[:, 1:-1, :-2] - y[:, 1:-1, 2:] - y[:, :-2, 1:-1] - y[:, 2:, 1:-1]
    return lap.reshape(len(y), -1).var(1)


def edge_density(y: np.ndarray) -> np.ndarray:
    """Mean Sobel magnitude inside each luma image of values in 0..1."""
    if min(y.shape[1:]) < 3:
        return np.zeros(len(y))
    across = y[:, :-2] + 2 * y[:, 1:-1] + y[:, 2:]
    down = y[:, :, :-2] + 2 * y[:, :, 1:-1] + y[:, :, 2:]
    return np.hypot(across[:, :, 2:] - across[:, :, :-2], down[:, 2:] - down[:, :-2]).reshape(len(y), -1).mean(1)


def _shares(bins: np.ndarray, n: int) -> np.ndarray:
    """Share of each bin among the entries of each row."""
    rows = np.repeat(np.arange(len(bins)), bins.shape[1])
    return np.bincount(rows * n + bins.reshape(-1), minlength=len(bins) * n).reshape(len(bins), n) / max(1, bins.shape[1])


def luma_histogram(y: np.ndarray) -> np.ndarray:
    at = (y.reshape(len(y), -1) / 256 * (LUMA_BINS - 0.01)).astype(int).clip(0, LUMA_BINS - 1)
    return _shares(at, LUMA_BINS)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value in 0..1."""
    c = np.asarray(rgb, float) / 255
    high, low = c.max(-1), c.min(-1)
    spread = high - low
    safe = np.where(spread > 0, spread, 1.0)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    sixth = np.select([high == r, high == g], [((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4)
    return np.stack([np.where(spread > 0, sixth * 60, 0.0), np.where(high > 0, spread / np.where(high > 0, high, 1.0), 0.0), high], -1)


def hsv_histogram(rgb: np.ndarray) -> np.ndarray:
    c = hsv(rgb).reshape(len(rgb), -1, 3) / [360, 1, 1]
    at = [(c[..., k] * (n - 0.01)).astype(int).clip(0, n - 1) for k, n in enumerate(HSV_BINS)]
    return _shares((at[0] * HSV_BINS[1] + at[1]) * HSV_BINS[2] + at[2], math.prod(HSV_BINS))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 1e-8)


def cell_features(rgb: np.ndarray) -> np.ndarray:
    """The model-free unit embedding of images of equal size: for each of 8 x 8 cells, over its pixels, the mean of red, green, blue and luma, the mean
    distance of luma from the blue of the left and upper neighbour (both, so the first row and column have none), red less blue and green less red, in
    shares of 255; and the ratio of the sums of luma and of red, that plus one."""
    rgb = np.asarray(rgb, float)
    n, height, width = rgb.shape[:3]
    y, blue = luma(rgb), rgb[..., 2]
    slope = np.zeros_like(y)
    slope[:, 1:, 1:] = np.abs(y[:, 1:, 1:] - blue[:, 1:, :-1]) + np.abs(y[:, 1:, 1:] - blue[:, :-1, 1:])
    ch, cw = height // CELLS, width // CELLS
    layers = np.stack([*np.moveaxis(rgb, -1, 0), y, slope])[:, :, : ch * CELLS, : cw * CELLS]
    r, g, b, light, grad = layers.reshape(5, n, CELLS, ch, CELLS, cw).sum((3, 5))
    whole = ch * cw * 255.0
    moments = [r / whole, g / whole, b / whole, light / whole, grad / whole, (r - b) / whole, (g - r) / whole, light / (r + 1)]
    return unit(np.stack(moments, -1).reshape(n, -1))


def sharpness(rgb: np.ndarray, box: tuple[int, int, int, int] | None = None, side: int = 128) -> float:
    """Variance of the Laplacian over a region brought to one size; 0 below four pixels a side."""
    h, w = np.shape(rgb)[:2]
    box = box or (0, 0, w, h)
    left, top = min(max(box[0], 0), max(0, w - 1)), min(max(box[1], 0), max(0, h - 1))
    width, height = min(box[2] - box[0], w - left), min(box[3] - box[1], h - top)
    if width < 4 or height < 4:
        return 0.0
    return float(laplacian_variance(luma(resized(np.asarray(rgb)[top : top + height, left : left + width], side, side))[None])[0])


def fixed_input(rgb: np.ndarray, scale: float = 127.5) -> np.ndarray:
    """Channels first, from -1 to 1: the input of an ONNX embedder (scale 127.5) or, moved to the end by the caller, of others (128)."""
    return np.moveaxis((np.asarray(rgb, float) - 127.5) / scale, -1, -3).astype(np.float32)


def prewhitened(rgb: np.ndarray) -> np.ndarray:
    """Channels last, by the image's own mean and deviation, the latter no less than one over the root of the number of values."""
    c = np.asarray(rgb, float)
    return ((c - c.mean()) / max(c.std(), 1 / math.sqrt(c.size))).astype(np.float32)


def flip_averaged(rgb: np.ndarray, model, prepare) -> np.ndarray:
    """The unit sum of a model's vectors of an image (height, width, 3) and its mirror image; that of the image alone where the mirror fails (None), and an empty one where it does."""
    direct = model(prepare(rgb))
    if direct is None or not len(direct):
        return np.zeros(0)
    mirror = model(prepare(np.asarray(rgb)[:, ::-1]))
    both = np.asarray(direct, float) if mirror is None or not len(mirror) else np.asarray(direct, float) + np.asarray(mirror, float)
    return unit(both)
