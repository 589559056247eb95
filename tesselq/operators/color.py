"""Color analysis, reduction, histograms and mapping to palettes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scanlines import bytes_per_pixel


def has_alpha(pixels: Column, color_type: Column) -> Column:
    """Any alpha other than 255; RGBA only."""
    return (color_type == 6) & F.exists(F.transform(pixels, lambda v, i: (i % 4 == 3) & (v != 255)), lambda x: x)


def is_grayscale(pixels: Column, color_type: Column) -> Column:
    """All pixels have equal channels; alpha is not looked at. Gray images do, indexed ones don't."""
    n = F.when(color_type == 2, 3).otherwise(4)
    differs = F.transform(pixels, lambda v, i: (i % n == 0) & ((v != F.get(pixels, i + 1)) | (v != F.get(pixels, i + 2))))
    return F.when(color_type == 0, True).when(color_type.isin(2, 6), ~F.exists(differs, lambda x: x)).otherwise(False)


def length_fits(pixels: Column, width: Column, height: Column, color_type: Column) -> Column:
    return F.size(pixels) == width * height * bytes_per_pixel(color_type)


def can_reduce_to_gray(pixels: Column, width: Column, height: Column, color_type: Column) -> Column:
    return length_fits(pixels, width, height, color_type) & is_grayscale(pixels, color_type)


def can_reduce_to_rgb(pixels: Column, width: Column, height: Column) -> Column:
    """Four bytes a pixel, all opaque."""
    return (F.size(pixels) == width * height * 4) & ~has_alpha(pixels, F.lit(6))


def to_rgb(pixels: Column) -> Column:
    return F.filter(pixels, lambda v, i: i % 4 < 3)


def to_gray(pixels: Column, color_type: Column) -> Column:
    """The first channel of each pixel."""
    n = bytes_per_pixel(color_type)
    return F.filter(pixels, lambda v, i: i % n == 0)


def clear_hidden(pixels: Column) -> Column:
    """RGBA with the color of fully transparent pixels set to 0."""
    return F.transform(pixels, lambda v, i: F.when((i % 4 < 3) & (F.get(pixels, i - i % 4 + 3) == 0), 0).otherwise(v))


def count_colors(points: DataFrame) -> DataFrame:
    """(image_id, r, g, b, n) of points(image_id, r, g, b)."""
    return points.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def unique_colors(points: DataFrame) -> DataFrame:
    return points.groupBy("image_id").agg(F.count_distinct("r", "g", "b").alias("n_colors"))


def ranked_colors(counts: DataFrame) -> DataFrame:
    """counts with rank: falling count, ties by r, g, b, so that the order is total."""
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")
    return counts.withColumn("rank", F.row_number().over(order))


def weighted_mean(counts: DataFrame) -> DataFrame:
    """The mean color by count, cut to whole numbers; by the number of colors where all counts are 0."""
    total = F.sum("n")
    by = F.when(total == 0, F.count("*")).otherwise(total)
    return counts.groupBy("image_id").agg(*(F.floor(F.sum(F.col(c).cast("long") * F.col("n")) / by).cast("int").alias(c) for c in "rgb"))


def extents(counts: DataFrame) -> DataFrame:
    """Least and largest of each channel and the channel of the widest range; ties go to r, then g."""
    out = counts.groupBy("image_id").agg(*(f(c).alias(f"{name}_{c}") for c in "rgb" for name, f in (("min", F.min), ("max", F.max))))
    wide = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "rgb"}
    return out.withColumn("widest", F.when((wide["r"] >= wide["g"]) & (wide["r"] >= wide["b"]), "r").when(wide["g"] >= wide["b"], "g").otherwise("b"))


def nearest(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """(r, g, b, idx) for distinct colors(r, g, b): the palette entry of least squared distance, the first of equal ones.

    palette(idx, r, g, b) has at most 256 rows by its format, so it travels as one literal array and each color is looked
    up in its own row: no pairs are made, and nothing is shuffled but the distinct colors. Empty palette: 0.
    """
    rows = sorted(tuple(r) for r in palette.select("idx", "r", "g", "b").limit(257).collect())
    if len(rows) > 256:
        raise ValueError("a palette has at most 256 colors")
    fields = "array<struct<idx int, r int, g int, b int>>"
    entries = F.from_json(F.lit(json.dumps([dict(zip(("idx", "r", "g", "b"), r, strict=True)) for r in rows])), fields)

    def distance(e: Column) -> Column:
        parts = [(F.col(c) - e[c]).cast("long") for c in "rgb"]
        return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]

    best = F.array_min(F.transform(entries, lambda e: F.struct(distance(e).alias("d"), e["idx"].alias("idx"))))
    return colors.select("r", "g", "b").distinct().select("r", "g", "b", F.coalesce(best["idx"], F.lit(0)).alias("idx"))


def map_to_palette(points: DataFrame, palette: DataFrame) -> DataFrame:
    """points with idx: distinct colors are looked up once and joined back."""
    return points.join(nearest(points, palette), ["r", "g", "b"])


def add_color(palette: Column, entry: Column, most: int) -> tuple[Column, Column]:
    """The palette (ARRAY<STRUCT<r, g, b>>) with an entry more, and the entry's index; as it was and -1 when it is full."""
    full = F.size(palette) >= most
    return F.when(full, palette).otherwise(F.concat(palette, F.array(entry))), F.when(full, -1).otherwise(F.size(palette))


def get_color(palette: Column, idx: Column) -> Column:
    """An entry; black outside the palette."""
    black = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return F.coalesce(F.get(palette, idx), black)


def palette_has_alpha(palette: Column) -> Column:
    """A palette's entries are r, g, b: none has alpha."""
    return F.when(palette.isNotNull(), False)


def palette_alphas(palette: Column) -> Column:
    """The alphas of a palette's entries, opaque all of them."""
    return F.transform(palette, lambda _: F.lit(255))
