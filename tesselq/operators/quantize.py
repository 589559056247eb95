"""Palettes by median cut, and mapping images to them with error diffusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PALETTE = "image_id long, idx int, r int, g int, b int"
INDEXED = "image_id long, indices array<int>"


def median_cut(colors: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most `most` colors for distinct colors (n, 3) in the order of falling count, ties by r, g, b.

    While there are fewer boxes than wanted, the one with the most colors (the first of equals) is sorted along its
    widest channel (r before g before b) and halved. A box's color is its mean by count, cut to whole numbers.
    """
    if len(colors) <= most:
        return colors
    boxes = [np.arange(len(colors))]
    while len(boxes) < most:
        at = int(np.argmax([len(b) for b in boxes]))
        own = boxes[at]
        if len(own) < 2:
            break
        channel = int(np.argmax(np.ptp(colors[own], axis=0)))
        own = own[np.argsort(colors[own, channel], kind="stable")]
        boxes[at] = own[: len(own) // 2]
        boxes.append(own[len(own) // 2 :])
    weight = [counts[b] if counts[b].sum() else np.ones(len(b), np.int64) for b in boxes]
    return np.array([(colors[b] * w[:, None]).sum(axis=0) // w.sum() for b, w in zip(boxes, weight, strict=True)])


def palettes(counts: DataFrame, most: int) -> DataFrame:
    """PALETTE rows for counts(image_id, r, g, b, n): an image's distinct colors are one group."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy().astype(np.int64) for c in ("r", "g", "b", "n")}
        order = np.lexsort((cols["b"], cols["g"], cols["r"], -cols["n"]))
        colors = np.stack([cols[c][order] for c in "rgb"], axis=1)
        chosen = median_cut(colors, cols["n"][order], max(1, min(most if most > 0 else 256, 256)))
        n = len(chosen)
        return pa.table({"image_id": pa.array([key[0].as_py()] * n, pa.int64()), "idx": pa.array(range(n), pa.int32()), **{c: pa.array(chosen[:, i], pa.int32()) for i, c in enumerate("rgb")}})

    return counts.select("image_id", "r", "g", "b", "n").groupBy("image_id").applyInArrow(one, PALETTE)


def _nearest(color: np.ndarray, palette: np.ndarray) -> tuple[int, np.ndarray]:
    at = int(((palette - color) ** 2).sum(axis=1).argmin())
    return at, palette[at]


def _part(error: np.ndarray, weight: int, of: int) -> np.ndarray:
    """error * weight / of, cut towards zero."""
    x = error * weight
    return np.sign(x) * (np.abs(x) // of)


#: What each line diffusion passes on: (distance, weight), all over a divisor; carry: what waits stays in 0..255.
LINES = {
    "threshold": ((), 1, False),
    "floyd_steinberg": (((1, 7), (2, 1)), 16, False),
    "jarvis": (((1, 7), (2, 5), (3, 3), (4, 1)), 48, False),
    "encoder": (((1, 7),), 16, True),
}


def diffuse_line(pixels: np.ndarray, palette: np.ndarray, method: str) -> np.ndarray:
    """Palette indices of pixels (n, 3) taken as one line: each one's error goes to those after it."""
    shares, of, carry = LINES[method]
    waiting = np.zeros((len(pixels) + 5, 3), np.int64)
    out = np.zeros(len(pixels), np.int64)
    for i, pixel in enumerate(pixels):
        color = np.clip(pixel + waiting[i], 0, 255)
        out[i], chosen = _nearest(color, palette)
        for ahead, weight in shares:
            waiting[i + ahead] += _part(color - chosen, weight, of)
        if carry:
            waiting[i + 1] = np.clip(waiting[i + 1], 0, 255)
    return out


def diffuse_rows(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Palette indices of pixels (height, width, 3): errors go to the next row alone.

    The place below gets 3/16 in place of what it had, the next 7/16 more, kept in 0..255, the one after 5/16 more.
    """
    height, width, _ = pixels.shape
    above = np.zeros((width + 2, 3), np.int64)
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        below = np.zeros((width + 2, 3), np.int64)
        for x in range(width):
            color = np.clip(pixels[y, x] + above[x], 0, 255)
            out[y, x], chosen = _nearest(color, palette)
            error = color - chosen
            below[x] = _part(error, 3, 16)
            if x + 1 < width:
                below[x + 1] += _part(error, 7, 16)
            if x + 2 < width:
                below[x + 2] += _part(error, 5, 16)
            below[x + 1] = np.clip(below[x + 1], 0, 255)
        above = below
    return out


def rgb_of(pixels: list[int], color_type: int) -> np.ndarray:
    """(n, 3): gray as r = g = b, alpha left out."""
    each = {2: 3, 6: 4}.get(color_type, 1)
    p = np.array(pixels, np.int64).reshape(-1, each)
    return np.repeat(p, 3, axis=1) if each == 1 else p[:, :3]


def dither(images: DataFrame, palette: np.ndarray, method: str) -> DataFrame:
    """INDEXED rows of images(image_id, width, height, color_type, pixels) by one palette (n, 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for r in b.to_pylist():
                rgb = rgb_of(r["pixels"], r["color_type"])
                found = diffuse_rows(rgb.reshape(r["height"], r["width"], 3), palette).ravel() if method == "floyd_steinberg_rows" else diffuse_line(rgb, palette, method)
                ids.append(r["image_id"])
                out.append(found.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["image_id", "indices"])

    return images.select("image_id", "width", "height", "color_type", "pixels").mapInArrow(run, INDEXED)


def quantize(pixels: list[int], color_type: int, most: int, dithered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Palette indices and palette (n, 3) of one image."""
    rgb = rgb_of(pixels, color_type)
    colors, back, counts = np.unique(rgb, axis=0, return_inverse=True, return_counts=True)
    order = np.lexsort((colors[:, 2], colors[:, 1], colors[:, 0], -counts))
    palette = median_cut(colors[order], counts[order], max(1, min(most if most > 0 else 256, 256)))
    if dithered:
        return diffuse_line(rgb, palette, "encoder"), palette
    found = ((colors[:, None, :] - palette[None]) ** 2).sum(axis=2).argmin(axis=1)
    return found[back.ravel()], palette


def quantized(images: DataFrame, most: int, dithered: bool = False) -> DataFrame:
    """(image_id, indices, palette): palette is an array of r, g, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["image_id"], *quantize(r["pixels"], r["color_type"], most, dithered)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, *_ in rows], pa.int64()), pa.array([x.tolist() for _, x, _ in rows], pa.list_(pa.int32())), pa.array([p.ravel().tolist() for *_, p in rows], pa.list_(pa.int32()))],
                ["image_id", "indices", "palette"],
            )

    return images.select("image_id", "color_type", "pixels").mapInArrow(run, "image_id long, indices array<int>, palette array<int>")


def mean_error(indexed: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, error): the mean squared distance of an image's gray pixels from their palette colors."""
    both = indexed.join(images.select("image_id", "pixels"), "image_id")
    far = F.zip_with("pixels", "indices", lambda p, i: F.pow(p - F.get("palette", i * 3), F.lit(2)))
    return both.select("image_id", (F.aggregate(far, F.lit(0.0), lambda s, x: s + x) / F.size("pixels")).alias("error"))
