"""Scanlines, their prediction filters, the choice of a filter and the way back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = ("none", "sub", "up", "average", "paeth")
#: The filters that each strategy chooses from, by number.
STRATEGIES = {"none": (0,), "sub": (1,), "up": (2,), "average": (3,), "paeth": (4,), "minsum": (0, 1, 2, 3, 4), "adaptive": (0, 1, 2, 3, 4), "adaptive_fast": (0, 1, 2)}


def bytes_per_pixel(color_type: Column, other: int = 1) -> Column:
    return F.when(color_type == 2, 3).when(color_type == 6, 4).when(color_type.isin(0, 3), 1).otherwise(other)


def scanlines(images: DataFrame) -> DataFrame:
    """(image_id, y, row, prev, bpp) of images(image_id, width, height, color_type, pixels array<int>).

    Rows are slices of the image's own array, so nothing is shuffled; prev is the unfiltered row above, zeros for the first.
    """
    bpp = bytes_per_pixel(F.col("color_type"))
    stride = F.col("width") * F.col("bpp")
    rows = F.when(F.col("height") > 0, F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.slice("pixels", y * F.col("stride") + 1, F.col("stride"))))
    cut = images.withColumn("bpp", bpp).withColumn("stride", stride).withColumn("rows", rows)
    cut = cut.select("image_id", "bpp", "rows", F.posexplode("rows").alias("y", "row"))
    above = F.coalesce(F.get("rows", F.col("y") - 1), F.array_repeat(F.lit(0), F.size("row")))
    return cut.select("image_id", "y", "row", above.alias("prev"), "bpp")


def _at(a: Column, i: Column) -> Column:
    return F.coalesce(F.get(a, i), F.lit(0))


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """Of left, up and corner the first that is nearest to left + up - corner."""
    near_left, near_up, near_corner = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - 2 * corner)
    return F.when((near_left <= near_up) & (near_left <= near_corner), left).when(near_up <= near_corner, up).otherwise(corner)


def residuals(filter_: int, row: Column, prev: Column, bpp: Column) -> Column:
    """The row's bytes less the filter's prediction, mod 256; what lies left of or above the image is 0."""

    def of(predicted: Callable[[Column], Column]) -> Column:
        return F.transform(row, lambda v, i: F.pmod(v - predicted(i), F.lit(256)).cast("int"))

    if filter_ == 0:
        return row
    if filter_ == 1:
        return of(lambda i: _at(row, i - bpp))
    if filter_ == 2:
        return of(lambda i: _at(prev, i))
    if filter_ == 3:
        return of(lambda i: F.floor((_at(row, i - bpp) + _at(prev, i)) / 2))
    return of(lambda i: paeth(_at(row, i - bpp), _at(prev, i), _at(prev, i - bpp)))


def absolute_sum(filtered: Column) -> Column:
    """The sum of the bytes' sizes, read as signed."""
    return F.aggregate(filtered, F.lit(0).cast("long"), lambda s, v: s + F.when(v > 127, 256 - v).otherwise(v))


def filtered(lines: DataFrame, filter_: int) -> DataFrame:
    return lines.select("image_id", "y", F.lit(filter_).alias("filter_type"), residuals(filter_, F.col("row"), F.col("prev"), F.col("bpp")).alias("bytes"))


def scored(lines: DataFrame, filters: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """lines with candidates: an array of (score, filter_type, bytes)."""
    each = (F.struct(absolute_sum(b).alias("score"), F.lit(f).alias("filter_type"), b.alias("bytes")) for f in filters for b in [residuals(f, F.col("row"), F.col("prev"), F.col("bpp"))])
    return lines.withColumn("candidates", F.array(*each))


def select_filter(lines: DataFrame, strategy: str = "adaptive") -> DataFrame:
    """(image_id, y, filter_type, score, bytes): the least score, of equal ones the lowest filter."""
    best = F.array_min(F.col("candidates"))
    return scored(lines, STRATEGIES.get(strategy, STRATEGIES["adaptive"])).withColumn("best", best).select("image_id", "y", "best.filter_type", "best.score", "best.bytes")


def with_filter_byte(chosen: DataFrame) -> DataFrame:
    """(image_id, y, bytes): the filter's number, then the row."""
    return chosen.select("image_id", "y", F.concat(F.array("filter_type"), "bytes").alias("bytes"))


def scanline_length(width: Column, color_type: Column) -> Column:
    return 1 + width * bytes_per_pixel(color_type)


def expected_idat_size(width: Column, height: Column, color_type: Column) -> Column:
    half = F.floor(scanline_length(width, color_type) * height / 2).cast("long")
    return 2 + F.greatest(F.lit(10), half) + 4


def reconstruct_sub(filtered_row: Column, bpp: int) -> Column:
    """Sums along each channel, in one fold over the row."""
    step = lambda acc, v: F.concat(acc, F.array(F.pmod(v + F.when(F.size(acc) >= bpp, F.get(acc, F.size(acc) - bpp)).otherwise(0), F.lit(256)).cast("int")))
    return F.aggregate(filtered_row, F.array().cast("array<int>"), step)


def reconstruct_up(filtered_row: Column, prev: Column) -> Column:
    return F.zip_with(filtered_row, prev, lambda v, p: F.pmod(v + p, F.lit(256)).cast("int"))


def choose(pixels: np.ndarray, bpp: int, strategy: str) -> tuple[np.ndarray, np.ndarray]:
    """For whole images in Arrow batches: rows (height, stride) to filter numbers and filtered rows."""
    rows = pixels.astype(np.int16)
    height, stride = rows.shape
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp] if stride > bpp else rows[:, :0]
    up[1:] = rows[:-1]
    corner[1:] = left[:-1]
    near_left, near_up, near_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    predicted = np.where((near_left <= near_up) & (near_left <= near_corner), left, np.where(near_up <= near_corner, up, corner))
    every = {0: rows, 1: rows - left, 2: rows - up, 3: rows - (left + up) // 2, 4: rows - predicted}
    filters = STRATEGIES.get(strategy, STRATEGIES["adaptive"])
    out = np.stack([every[f] & 255 for f in filters])
    score = np.where(out > 127, 256 - out, out).astype(np.int64).sum(axis=2)
    best = score.argmin(axis=0)
    return np.array(filters, np.uint8)[best], out[best, np.arange(height)].astype(np.uint8)


def reconstruct(filters: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows (height, stride) back from their filtered form; Sub and Up are sums, Average and Paeth go pixel by pixel."""
    out = np.zeros(rows.shape, np.int64)
    above = np.zeros(rows.shape[1], np.int64)
    for y, (f, row) in enumerate(zip(filters.tolist(), rows.astype(np.int64), strict=True)):
        if f == 1:
            line = row.copy()
            for c in range(bpp):
                line[c::bpp] = np.cumsum(line[c::bpp])
        elif f == 2:
            line = row + above
        elif f in (3, 4):
            line = row.copy()
            for i in range(0, len(row), bpp):
                left, up = line[i - bpp : i] if i else np.zeros(bpp, np.int64), above[i : i + bpp]
                if f == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[i - bpp : i] if i else np.zeros(bpp, np.int64)
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[i : i + bpp] = (row[i : i + bpp] + guess) & 255
        else:
            line = row
        above = out[y] = line & 255
    return out.astype(np.uint8)
