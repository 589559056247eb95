"""Columns for job lists: sizes, savings, kinds, statuses and setting names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of colors that can be chosen; 0 is lossless.
COLOR_CHOICES = (0, 256, 128, 64, 32, 16, 8)


def one_decimal(x: Column) -> Column:
    """Rounded half up to one decimal, without a trailing .0."""
    tenths = F.floor(x * 10 + 0.5).cast("long")
    whole = F.floor(tenths / 10).cast("string")
    return F.when(F.pmod(tenths, F.lit(10)) == 0, whole).otherwise(F.concat(whole, F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")))


def format_size(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(one_decimal(n / 1_000_000.0), F.lit(" MB")))
        .when(n >= 1000, F.concat(one_decimal(n / 1000.0), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def percent_saved(original: Column, compressed: Column) -> Column:
    """May be negative; null where the original is 0."""
    return F.when(original != 0, (original - compressed) / original.cast("double") * 100.0)


def savings(original: Column, compressed: Column) -> Column:
    """percent_saved where something was saved, else null."""
    p = percent_saved(original, compressed)
    return F.when((original > 0) & (p > 0), p)


def savings_class(percent: Column) -> Column:
    return F.when(percent >= 30, "green").when(percent >= 10, "yellow").otherwise("gray")


def file_kind(mime: Column, name: Column) -> Column:
    png = F.contains(mime, F.lit("png")) | F.endswith(name, F.lit(".png"))
    jpeg = F.contains(mime, F.lit("jpeg")) | F.contains(mime, F.lit("jpg")) | F.endswith(name, F.lit(".jpg")) | F.endswith(name, F.lit(".jpeg"))
    return F.when(png, "png").when(jpeg, "jpeg").otherwise("unknown")


def kind_text(kind: Column) -> Column:
    return F.when(kind == "png", "PNG").when(kind == "jpeg", "JPEG").otherwise("Unknown")


def status_text(status: Column, error: Column) -> Column:
    return F.when(status == "error", F.concat(F.lit("Error: "), error)).when(status.isin("decoding", "compressing"), F.concat(F.initcap(status), F.lit("..."))).otherwise(F.initcap(status))


def preset_number(name: Column) -> Column:
    return F.when(name == "smaller", 0).when(name == "balanced", 1).when(name == "faster", 2)


def preset_label(name: Column) -> Column:
    return F.when(name.isin("smaller", "balanced", "faster"), F.initcap(name))


def preset_of_number(n: Column) -> Column:
    """Unknown numbers are balanced."""
    return F.when(n == 0, "max").when(n == 2, "fast").otherwise("balanced")


def color_choice(n: Column) -> Column:
    """A number of colors that can be chosen; others are lossless."""
    return F.when(n.isin(*COLOR_CHOICES), n).otherwise(0)


def color_choice_label(n: Column) -> Column:
    return F.when(color_choice(n) == 0, "Lossless").otherwise(F.concat(n.cast("string"), F.lit(" colors")))


def is_lossless(n: Column) -> Column:
    return color_choice(n) == 0


def new_id() -> Column:
    """Seven random characters of 0-9 and a-z. Not a key for many rows: two of 300,000 are likely to be the same."""
    return F.lpad(F.lower(F.conv(F.floor(F.rand() * 36**7).cast("string"), 10, 36)), 7, "0")


def output_name(path: Column) -> Column:
    """The path with its extension, if any, replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(".png"))


def download_name(name: Column) -> Column:
    return F.concat(F.lit("compressed_"), name)
