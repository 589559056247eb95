"""PNG files: chunks, headers, whole images out and in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselq.functions.bytes import be32, byte
from tesselq.functions.dims import BIT_DEPTHS
from tesselq.plans.options import Options

from .deflate import zlib_stream
from .quantize import quantize
from .scanlines import choose, reconstruct

#: Fixed values of the format.
SIGNATURE = bytes.fromhex("89504E470D0A1A0A")
EACH = {0: 1, 2: 3, 3: 1, 6: 4}


def chunk(kind: str, data: bytes) -> bytes:
    body = kind.encode() + data
    return len(data).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")


def chunk_column(kind: Column, data: Column) -> Column:
    body = F.concat(kind.cast("binary"), data)
    return F.concat(be32(F.octet_length(data)), body, be32(F.crc32(body)))


def is_critical(kind: Column) -> Column:
    return F.ascii(kind).bitwiseAND(32) == 0


def is_required(kind: Column) -> Column:
    return kind.isin("IHDR", "IDAT", "IEND")


def has_signature(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 8) == F.lit(SIGNATURE), F.lit(False))


def ihdr_column(width: Column, height: Column, depth: Column, color_type: Column) -> Column:
    """The header's 13 bytes, numbers big-endian; methods and interlace are 0."""
    return F.concat(be32(width), be32(height), byte(depth), byte(color_type), F.unhex(F.lit("000000")))


def ihdr_error(width: Column, height: Column, depth: Column, color_type: Column, compression: Column, filter_: Column, interlace: Column) -> Column:
    """The first rule that a header breaks, or null."""
    depth_ok = F.lit(False)
    for kind, depths in BIT_DEPTHS.items():
        depth_ok = depth_ok | ((color_type == kind) & depth.isin(*depths))
    top = (1 << 31) - 1
    return (
        F.when((width == 0) | (height == 0), "zero dimension")
        .when((width > top) | (height > top), "dimension too large")
        .when(~color_type.isin(*BIT_DEPTHS), "invalid color type")
        .when(~depth_ok, "invalid bit depth")
        .when(compression != 0, "invalid compression")
        .when(filter_ != 0, "invalid filter")
        .when(interlace > 1, "invalid interlace")
    )


def hex_bytes(numbers: Column) -> Column:
    """ARRAY<INT> of bytes as BINARY."""
    return F.unhex(F.array_join(F.transform(numbers, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def plte_data(colors: Column) -> Column:
    """A palette chunk's data: three bytes for each of ARRAY<STRUCT<r, g, b>>."""
    return hex_bytes(F.flatten(F.transform(colors, lambda c: F.array(c["r"], c["g"], c["b"]))))


def trns_data(alphas: Column) -> Column:
    """A transparency chunk's data: the palette's alphas in order."""
    return hex_bytes(alphas)


def palette_error(n_colors: Column, n_alphas: Column) -> Column:
    return F.when(~n_colors.between(1, 256), "palette size").when(n_alphas > n_colors, "more alphas than colors")


def reduce_color(pixels: bytes, width: int, height: int, color_type: int) -> tuple[bytes, int, bool]:
    """Opaque RGBA as RGB, else gray content as gray; the last says whether translucency was lost with it."""
    p = np.frombuffer(pixels, np.uint8)
    if len(p) == width * height * 4 and color_type == 6 and (p[3::4] == 255).all():
        return p.reshape(-1, 4)[:, :3].tobytes(), 2, False
    if color_type in (2, 6) and len(p) == width * height * EACH[color_type]:
        q = p.reshape(-1, EACH[color_type])
        if (q[:, 0] == q[:, 1]).all() and (q[:, 0] == q[:, 2]).all():
            return q[:, 0].tobytes(), 0, color_type == 6
    return pixels, color_type, False


def clear_hidden(pixels: bytes) -> bytes:
    q = np.frombuffer(pixels, np.uint8).reshape(-1, 4).copy()
    q[q[:, 3] == 0, :3] = 0
    return q.tobytes()


def encode_image(pixels: bytes, width: int, height: int, color_type: int, options: Options) -> bytes:
    """A whole file. Fewer than 256 colors asked for: an indexed one. A wrong length raises ValueError."""
    if color_type not in EACH or width < 1 or height < 1 or len(pixels) != width * height * EACH[color_type]:
        raise ValueError("pixel data doesn't fit width, height and color type")
    extra = b""
    if 0 < options.max_colors < 256:
        indices, palette = quantize(list(pixels), color_type, options.max_colors, options.dithering)
        extra = chunk("PLTE", palette.astype(np.uint8).tobytes())
        pixels, color_type = indices.astype(np.uint8).tobytes(), 3
    else:
        if options.reduce_color:
            pixels, color_type, _ = reduce_color(pixels, width, height, color_type)
        if options.optimize_alpha and color_type == 6:
            pixels = clear_hidden(pixels)
    rows = np.frombuffer(pixels, np.uint8).reshape(height, -1)
    filters, out = choose(rows, EACH[color_type], options.strategy)
    lines = np.concatenate([filters[:, None], out], axis=1).tobytes()
    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, color_type, 0, 0, 0])
    data = zlib_stream(lines, options.level, "optimal" if options.optimal else "auto")
    return SIGNATURE + chunk("IHDR", header) + extra + chunk("IDAT", data) + chunk("IEND", b"")


def parts(data: bytes) -> list[tuple[str, bytes, bool]]:
    """A file's chunks: type, data, whether the checksum is right."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    out, at = [], 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        body = data[at + 4 : at + 8 + n]
        out.append((body[:4].decode("latin-1"), body[4:], zlib.crc32(body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")))
        at += 12 + n
    return out


#: Fixed values of the format: depths and channels by color type, and the passes of an interlaced image as first column and row, and steps.
BIT_DEPTHS_READ = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: np.ndarray, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """The samples (height, width, channels) of filtered rows."""
    rows = raw.reshape(height, -1)
    if rows[:, 0].max() > 4:
        raise ValueError("unknown filter")
    plain = reconstruct(rows[:, 0], rows[:, 1:], max(1, channels * depth // 8))
    if depth == 16:
        return (plain[:, 0::2].astype(np.int32) * 256 + plain[:, 1::2]).reshape(height, width, channels)
    if depth < 8:
        bits = np.unpackbits(plain, axis=1).reshape(height, -1, depth)
        plain = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, : width * channels]
    return plain.reshape(height, width, channels).astype(np.int32)


def decode_image(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, color type, pixels), eight bits a sample; of any depth, interlaced or not.

    Indexed images come back as RGB. Gray with alpha, and any image with a transparency chunk, comes back as RGBA.
    """
    found = parts(data)
    if data[:8] != SIGNATURE or not found or found[0][0] != "IHDR" or len(found[0][1]) != 13:
        raise ValueError("no PNG file")
    head = found[0][1]
    width, height, depth, color_type = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    if not all(whole for *_, whole in found):
        raise ValueError("wrong checksum")
    if depth not in BIT_DEPTHS_READ.get(color_type, ()) or not width or not height or head[12] > 1:
        raise ValueError("wrong header")
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d, _ in found if k == "IDAT")), np.uint8)
    channels = CHANNELS[color_type]
    full, at = np.zeros((height, width, channels), np.int32), 0
    for x, y, dx, dy in PASSES if head[12] else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            n = h * (1 + (w * channels * depth + 7) // 8)
            full[y::dy, x::dx] = _samples(raw[at : at + n], w, h, channels, depth)
            at += n
    chunk = {k: d for k, d, _ in found}
    clear = chunk.get("tRNS")
    if color_type == 3:
        palette = np.frombuffer(chunk["PLTE"], np.uint8).reshape(-1, 3)
        out = palette[full[..., 0]]
        alpha = np.append(np.frombuffer(clear, np.uint8), np.full(256, 255, np.uint8))[full[..., 0]] if clear else None
    else:
        key = np.frombuffer(clear, ">u2").astype(np.int32) if clear and color_type in (0, 2) else None
        alpha = np.where((full == key).all(axis=2), 0, 255) if key is not None else None
        out = full >> 8 if depth == 16 else full * (255 // ((1 << depth) - 1)) if depth < 8 else full
        if color_type == 4:
            out, alpha = out[..., :1], out[..., 1]
    if alpha is not None:
        out = np.dstack([out if out.shape[2] == 3 else np.repeat(out, 3, axis=2), alpha])
    kind = {1: 0, 3: 2, 4: 6}[out.shape[2]]
    return width, height, kind, out.astype(np.uint8).tobytes()


FILES = "image_id long, n_bytes long, data binary, error string"


def encode_png(images: DataFrame, options: Options, key: str = "image_id") -> DataFrame:
    """FILES rows of images(image_id, width, height, color_type, pixels binary); a bad image has an error and no data.

    key: the column, of any type, that stands in place of image_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for r in b.to_pylist():
                try:
                    out.append(encode_image(r["pixels"], r["width"], r["height"], r["color_type"], options))
                    errors.append(None)
                except (ValueError, TypeError) as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x or b"") for x in out], pa.int64()), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [key, "n_bytes", "data", "error"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "color_type", "pixels").mapInArrow(run, f"{key} {kind}, n_bytes long, data binary, error string")


IMAGES = "image_id long, width int, height int, color_type int, pixels binary"


#: What a file that can't be read raises, here or in the reader of its streams.
BROKEN = (ValueError, IndexError, KeyError, zlib.error, struct.error)


def decode_png_or_error(files: DataFrame, key: str = "image_id") -> DataFrame:
    """IMAGES rows and an error of files(image_id, data); a file that can't be read has an error and no image.

    key: the column, of any type, that stands in place of image_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d in b.column(1).to_pylist():
                try:
                    rows.append((*decode_image(d or b""), None))
                except BROKEN as e:
                    rows.append((None, None, None, None, str(e) or "broken file"))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], [key, "width", "height", "color_type", "pixels", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "data").mapInArrow(run, IMAGES.replace("image_id long", f"{key} {kind}") + ", error string")


def decode_png(files: DataFrame) -> DataFrame:
    """IMAGES rows of files(image_id, data) that can be read."""
    return decode_png_or_error(files).where("error IS NULL").drop("error")


def chunks(files: DataFrame) -> DataFrame:
    """(image_id, seq, type, n_bytes, crc_ok) of files(image_id, data); a broken file has those chunks that are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, k, len(d), ok) for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if f is not None for s, (k, d, ok) in enumerate(parts(f))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["image_id", "seq", "type", "n_bytes", "crc_ok"])

    return files.select("image_id", "data").mapInArrow(run, "image_id long, seq int, type string, n_bytes long, crc_ok boolean")


def with_level(options: Options, level: int) -> Options:
    return replace(options, level=max(1, min(9, level)))
