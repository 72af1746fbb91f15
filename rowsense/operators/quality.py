"""Quality of scanned pages: sharpness and ink of gray images, and what follows for their rows.

Images are rows of width, height and pixels (array of numbers, row by row). Those of one shape in an Arrow batch are measured
as one array. Defined results: an image of fewer than 3 by 3 pixels has blur 0, one without pixels ink 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below these a page is blurry, or has no text.
BLUR, INK = 100.0, 0.002
#: The share of pixels up to the paper's tone, and of that tone below which a pixel is ink.
PAPER, DARK = 0.95, 0.75
#: Numbers that are measured at a time.
HELD = 1 << 20


def gray(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def gray_pixels(rgba: Column) -> Column:
    """Gray tones of an array of red, green, blue, alpha, and so on."""
    return F.transform(F.sequence(F.lit(0), (F.size(rgba) / 4).cast("int") - 1), lambda i: gray(rgba[i * 4], rgba[i * 4 + 1], rgba[i * 4 + 2]))


def _by_shape(pixels: pd.Series, *shape: pd.Series) -> Iterator[tuple[np.ndarray, tuple, np.ndarray]]:
    """Images of one shape as rows of one array, at most HELD numbers at a time: their places, shape and pixels."""
    keys = pd.DataFrame({"n": pixels.map(len), **{str(i): x.astype(int) for i, x in enumerate(shape)}})
    for key, places in keys.groupby(list(keys), sort=False).indices.items():
        key = key if isinstance(key, tuple) else (key,)
        step = max(1, HELD // max(1, int(key[0])))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, tuple(int(k) for k in key[1:]), np.array([pixels.iloc[i] for i in some], float).reshape(len(some), int(key[0]))


def _stencil_variances(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    if width < 3 or height < 3:
        return np.zeros(len(pixels))
    g = pixels.reshape(-1, height, width)
    around = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:]
    return np.var((around - 4 * g[:, 1:-1, 1:-1]).reshape(len(g), -1), axis=1)


def _inks(pixels: np.ndarray) -> np.ndarray:
    count, n = pixels.shape
    if not n:
        return np.zeros(count)
    tones = np.sort(np.clip(np.floor(pixels + 0.5), 0, 255).astype(np.uint8), axis=1)
    # The paper's tone is the first up to which that share of all pixels lies.
    paper = tones[:, int(np.searchsorted(np.arange(1, n + 1), PAPER * n))]
    return (tones < (paper * DARK)[:, None]).sum(axis=1) / n


def laplacian_variance(pixels: Column, width: Column, height: Column) -> Column:
    @F.pandas_udf("double")
    def measure(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = np.zeros(len(p))
        for at, shape, images in _by_shape(p, w, h):
            out[at] = _stencil_variances(images, *shape)
        return pd.Series(out)

    return measure(pixels, width, height)


def ink_coverage(pixels: Column) -> Column:
    @F.pandas_udf("double")
    def measure(p: pd.Series) -> pd.Series:
        out = np.zeros(len(p))
        for at, _, images in _by_shape(p):
            out[at] = _inks(images)
        return pd.Series(out)

    return measure(pixels)


def assess(images: DataFrame, pixels: str = "pixels", width: str = "width", height: str = "height", blur: float = BLUR, ink: float = INK) -> DataFrame:
    """images with blur, ink, reasons and ok."""
    measured = images.withColumn("blur", laplacian_variance(F.col(pixels), F.col(width), F.col(height))).withColumn("ink", ink_coverage(F.col(pixels)))
    reasons = F.array_compact(F.array(F.when(F.col("blur") < blur, "blurry"), F.when(F.col("ink") < ink, "no-text-found")))
    return measured.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)


def drag_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct<x, y, width, height> of a drag in any direction, in shares of the page."""
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("width"), F.abs(y1 - y0).alias("height"))


def meaningful(rect: Column, least: float = 0.01) -> Column:
    return (rect["width"] > least) & (rect["height"] > least)
