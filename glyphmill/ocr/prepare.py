"""What a detector, an angle classifier and a recogniser get to see: scaled, padded and normalised pixels, crops, turned crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest side and step of a detector's input, its mean and deviation by channel; size of a classifier's input; pixels around a crop.
LONGEST, STEP = 960, 32
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
ANGLE_HEIGHT, ANGLE_WIDTH = 48, 192
CROP_PADDING = 5


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, by pixel centres."""
    h, w = pixels.shape[:2]
    if (h, w) == (height, width):
        return pixels

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = places(h, height)
    x0, x1, fx = places(w, width)
    rows = pixels[y0] * (1 - fy)[:, None, None] + pixels[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return np.floor(out + 0.5).astype(np.uint8)


def detector_input(rgba: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, float]:
    """Channels by height by width, scaled to LONGEST at most, black up to the next STEP; and the scale."""
    h, w = rgba.shape[:2]
    ratio = min(1.0, LONGEST / max(h, w))
    small = resized(rgba, int(w * ratio + 0.5), int(h * ratio + 0.5)) if ratio < 1 else rgba
    h, w = small.shape[:2]
    padded = np.zeros((-(-h // STEP) * STEP, -(-w // STEP) * STEP, 3), np.float64)
    padded[:h, :w] = small[:, :, :3]
    return ((padded / 255 - MEAN) / DEVIATION).transpose(2, 0, 1).astype(kind), ratio


def classifier_input(crop: np.ndarray) -> np.ndarray:
    return ((resized(crop, ANGLE_WIDTH, ANGLE_HEIGHT)[:, :, :3] / 255 - 0.5) / 0.5).transpose(2, 0, 1).astype(np.float32)


def crop_box(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """struct<x, y, width, height>: a box with CROP_PADDING around it, within the page at its right and bottom."""
    left, top = F.greatest(F.lit(0.0), x - CROP_PADDING), F.greatest(F.lit(0.0), y - CROP_PADDING)
    return F.struct(left.alias("x"), top.alias("y"), F.least(page_width - left, width + 2 * CROP_PADDING).alias("width"), F.least(page_height - top, height + 2 * CROP_PADDING).alias("height"))


def upright(crop: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """A crop turned by half if the classifier does not think it upright."""
    return crop if scores[0] > scores[1] else crop[::-1, ::-1]


def detector_figures(gray: Column, side: int) -> Column:
    """struct<width, height, ratio, total> of the detector's input for square gray images given as arrays of bytes."""

    @F.pandas_udf("width int, height int, ratio double, total double")
    def figures(images: pd.Series) -> pd.DataFrame:
        out = []
        for v in images:
            rgba = np.repeat(np.asarray(v, np.uint8)[: side * side].reshape(side, side, 1), 4, 2)
            tensor, ratio = detector_input(rgba, np.float64)
            out.append((tensor.shape[2], tensor.shape[1], ratio, float(tensor.sum())))
        return pd.DataFrame(out, columns=["width", "height", "ratio", "total"])

    return figures(gray)
