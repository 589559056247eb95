"""DEFLATE and zlib streams: bits, blocks, headers, the choice between codes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselq.functions.bytes import byte, le16
from tesselq.functions.dims import distance_codes, length_codes

from .huffman import canonical, code_lengths, fixed_lengths
from .matching import parse

#: Fixed value of the format: the order in which lengths of the code-length code are written.
CODE_LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
END = 256
#: Fixed values of the format: how few and how many literal, distance and length codes a header holds.
HEADER_COUNTS = ((257, 286), (1, 30), (4, 19))


def _lookup(codes: list[tuple[int, int, int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By value: code, extra bits and their number; a value in two ranges has the first code."""
    code, extra, bits = (np.zeros(most + 1, np.int64) for _ in range(3))
    for c, base, n in reversed(codes):
        at = np.arange(base, min(most, base + (1 << n) - 1) + 1)
        code[at], extra[at], bits[at] = c, at - base, n
    return code, extra, bits


LENGTHS, DISTANCES = _lookup(length_codes(), 258), _lookup(distance_codes(), 32768)


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields one after the other, lowest bit first; the last byte is filled with zeros.

    A field is shifted to its place in its first byte and added to as many bytes as it reaches; fields don't overlap.
    """
    ends = np.cumsum(widths)
    size = int(ends[-1] + 7) // 8 if len(widths) else 0
    first, shifted = np.divmod(ends - widths, 8)
    shifted = (values & ((np.int64(1) << widths) - 1)) << shifted
    out = np.zeros(size, np.uint8)
    for k in range(int(widths.max(initial=0) + 14) // 8):
        part = (shifted >> 8 * k) & 255
        own = part > 0
        out += np.bincount(first[own] + k, part[own], size).astype(np.uint8)
    return out.tobytes()


def symbols(data: bytes, level: int) -> dict[str, np.ndarray]:
    """The parse as symbols of both alphabets with extra bits; the end symbol is last."""
    pos, length, distance = parse(data, level)
    plain = length == 0
    literal = np.frombuffer(data, np.uint8)[pos].astype(np.int64)
    return {
        "symbol": np.append(np.where(plain, literal, LENGTHS[0][length]), END),
        "extra": np.append(np.where(plain, 0, LENGTHS[1][length]), 0),
        "bits": np.append(np.where(plain, 0, LENGTHS[2][length]), 0),
        "match": np.append(~plain, False),
        "d_symbol": DISTANCES[0][distance[~plain]],
        "d_extra": DISTANCES[1][distance[~plain]],
        "d_bits": DISTANCES[2][distance[~plain]],
    }


def block(s: dict[str, np.ndarray], lit: np.ndarray, dist: np.ndarray, head: list[tuple[int, int]]) -> bytes:
    """A last block: header fields, then each symbol's code, extra bits, and a match's distance likewise."""
    lit_codes, dist_codes = canonical(lit), canonical(dist)
    n = len(s["symbol"])
    values, widths = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
    values[:, 0], widths[:, 0] = lit_codes[s["symbol"]], lit[s["symbol"]]
    values[:, 1], widths[:, 1] = s["extra"], s["bits"]
    m = np.flatnonzero(s["match"])
    values[m, 2], widths[m, 2] = dist_codes[s["d_symbol"]], dist[s["d_symbol"]]
    values[m, 3], widths[m, 3] = s["d_extra"], s["d_bits"]
    h = np.array(head, np.int64).reshape(-1, 2)
    return pack_bits(np.concatenate([h[:, 0], values.ravel()]), np.concatenate([h[:, 1], widths.ravel()]))


def runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, extra, extra bits) of code lengths by the run rules."""
    out, i = [], 0
    while i < len(lengths):
        x, n = lengths[i], 1
        while i + n < len(lengths) and lengths[i + n] == x:
            n += 1
        i += n
        if x:
            out.append((x, 0, 0))
            n -= 1
        for symbol, least, most, bits in ((18, 11, 138, 7), (17, 3, 10, 3)) if x == 0 else ((16, 3, 6, 2),):
            while n >= least:
                out.append((symbol, min(n, most) - least, bits))
                n -= min(n, most)
        out += [(x, 0, 0)] * n
    return out


def header_counts_error(n_lit: Column, n_dist: Column, n_meta: Column) -> Column:
    """The first of the three numbers of codes that a header can't hold, or null."""
    ranges = zip(("literal", "distance", "length"), (n_lit, n_dist, n_meta), HEADER_COUNTS, strict=True)
    return F.coalesce(*(F.when(~n.between(least, most), f"{name} codes") for name, n, (least, most) in ranges))


def dynamic_header(lit: np.ndarray, dist: np.ndarray) -> list[tuple[int, int]]:
    """Fields of a last block's header with its own codes; the runs of both alphabets are coded apart."""
    n_lit, n_dist = max(257, int(np.flatnonzero(lit).max()) + 1), max(1, int(np.flatnonzero(dist).max()) + 1)
    coded = runs(lit[:n_lit].tolist()) + runs(dist[:n_dist].tolist())
    meta = code_lengths(np.bincount([x for x, _, _ in coded], minlength=19), 7)
    ordered = [int(meta[i]) for i in CODE_LENGTH_ORDER]
    n_meta = max(4, max(i for i, x in enumerate(ordered) if x) + 1)
    for n, (least, most) in zip((n_lit, n_dist, n_meta), HEADER_COUNTS, strict=True):
        if not least <= n <= most:
            raise ValueError(f"a header holds {least} to {most} codes, not {n}")
    codes = canonical(meta)
    fields = [(1, 1), (2, 2), (n_lit - 257, 5), (n_dist - 1, 5), (n_meta - 4, 4), *((x, 3) for x in ordered[:n_meta])]
    for x, extra, bits in coded:
        fields += [(int(codes[x]), int(meta[x])), (extra, bits)]
    return fields


def stored(data: bytes) -> bytes:
    """Blocks of at most 65535 bytes as they are."""
    parts = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    return b"".join(bytes([i == len(parts) - 1]) + len(p).to_bytes(2, "little") + (len(p) ^ 0xFFFF).to_bytes(2, "little") + p for i, p in enumerate(parts))


def own_lengths(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return code_lengths(np.bincount(s["symbol"], minlength=286)), code_lengths(np.bincount(s["d_symbol"], minlength=30))


def cost(s: dict[str, np.ndarray], lit: np.ndarray, dist: np.ndarray) -> int:
    """Bits of all symbols with their extra bits."""
    return int(lit[s["symbol"]].sum() + s["bits"].sum() + dist[s["d_symbol"]].sum() + s["d_bits"].sum())


def encode(data: bytes, level: int = 6, kind: str = "auto") -> bytes:
    """A DEFLATE stream. auto: own codes if that is fewer bytes, else the fixed ones; the parse is made once and sizes are
    counted before any bit is written. optimal: the smallest over this level and those above, or stored if that is smaller."""
    if not data:
        return stored(data)
    if kind == "optimal":
        best = min((encode(data, x) for x in range(max(1, min(9, level)), 10)), key=len)
        raw = stored(data)
        return raw if len(raw) < len(best) else best
    s = symbols(data, level)
    fixed = np.array(fixed_lengths("literal"), np.int64), np.array(fixed_lengths("distance"), np.int64)
    head = [(1, 1), (1, 2)]
    if kind != "fixed":
        own = own_lengths(s)
        own_head = dynamic_header(*own)
        bits = sum(n for _, n in own_head) + cost(s, *own)
        if kind == "dynamic" or -(-bits // 8) < -(-(3 + cost(s, *fixed)) // 8):
            return block(s, *own, own_head)
    return block(s, *fixed, head)


def zlib_header(window: int = 32768, flag_level: int = 2) -> bytes:
    info = window.bit_length() - 9
    if window & (window - 1) or not 0 <= info <= 7:
        raise ValueError("invalid window size for zlib")
    if flag_level > 3:
        raise ValueError("invalid compression level for zlib")
    first, second = 8 | info << 4, flag_level << 6
    return bytes([first, second + -(first * 256 + second) % 31])


def zlib_stream(data: bytes, level: int = 6, kind: str = "auto") -> bytes:
    return zlib_header() + encode(data, level, kind) + zlib.adler32(data).to_bytes(4, "big")


def zlib_header_column(window: Column, flag_level: Column) -> Column:
    """Two bytes; null where the window isn't a power of two of 256 to 32768 or the level is over 3."""
    first = 8 + 16 * (F.log2(window.cast("double")).cast("int") - 8)
    second = flag_level * 64
    ok = (window.bitwiseAND(window - 1) == 0) & window.between(256, 32768) & (flag_level <= 3)
    return F.when(ok, F.concat(byte(first), byte(second + F.pmod(-(first * 256 + second), F.lit(31)))))


def stored_block_column(data: Column, last: Column) -> Column:
    """One stored block; null where data is over 65535 bytes."""
    n = F.octet_length(data)
    return F.when(n <= 65535, F.concat(byte(last.cast("int")), le16(n), le16(n.bitwiseXOR(0xFFFF)), data))


def deflated(streams: DataFrame, level: int = 6, kind: str = "auto") -> DataFrame:
    """(stream_id, n_bytes, data) of streams(stream_id, data): zlib streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [d or b"" for d in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in raw], pa.int64()), pa.array([zlib_stream(d, level, kind) for d in raw], pa.binary())], ["stream_id", "n_bytes", "data"])

    return streams.select(F.col("stream_id").cast("long").alias("stream_id"), "data").mapInArrow(run, "stream_id long, n_bytes long, data binary")


def inflated(streams: DataFrame) -> DataFrame:
    """(stream_id, data) of zlib streams; a broken one has null data."""

    def whole(data: bytes | None) -> bytes | None:
        try:
            return zlib.decompress(data or b"")
        except zlib.error:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([whole(d) for d in b.column(1).to_pylist()], pa.binary())], ["stream_id", "data"])

    return streams.select("stream_id", "data").mapInArrow(run, "stream_id long, data binary")


def packed_bytes(fields: DataFrame, span: Column | None = None) -> DataFrame:
    """(stream_id, at, value): bytes of fields(stream_id, seq, bits, width), lowest bit first.

    A running sum gives each field's place, in two steps, by spans of seq and within one, so that a long stream is many
    tasks; a field lands in up to nine bytes, whose parts are or-ed together. span: a number that never falls as seq rises;
    4096 numbers of seq are one if none is given.
    """
    ranged = fields.where("width > 0").withColumn("range", F.floor(F.col("seq") / 4096) if span is None else span)
    sums = ranged.groupBy("stream_id", "range").agg(F.sum("width").alias("sum"))
    before = sums.select("stream_id", "range", (F.sum("sum").over(Window.partitionBy("stream_id").orderBy("range")) - F.col("sum")).alias("before"))
    within = F.sum("width").over(Window.partitionBy("stream_id", "range").orderBy("seq")) - F.col("width")
    placed = ranged.join(before, ["stream_id", "range"]).withColumn("place", F.col("before") + within)
    spread = placed.select("stream_id", "bits", "place", F.explode(F.sequence(F.floor(F.col("place") / 8), F.floor((F.col("place") + F.col("width") - 1) / 8))).alias("at"))
    part = F.expr("(shiftright(shiftleft(cast(bits as bigint), cast(place % 8 as int)), cast(8 * (at - place div 8) as int))) & 255")
    return spread.groupBy("stream_id", "at").agg(F.bit_or(part).cast("int").alias("value"))


def token_frequencies(streams: DataFrame, level: int) -> DataFrame:
    """(stream_id, alphabet, symbol, freq) of the parse of streams(stream_id, data), with one end symbol for each stream.

    Symbols are counted where the stream is parsed: at most 316 rows a stream, whatever its length, and no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = symbols(data or b"", level)
                lit, dist = (np.unique(s[c], return_counts=True) for c in ("symbol", "d_symbol"))
                names = ["literal"] * len(lit[0]) + ["distance"] * len(dist[0])
                columns = (np.full(len(names), stream), names, np.concatenate([lit[0], dist[0]]), np.concatenate([lit[1], dist[1]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["stream_id", "alphabet", "symbol", "freq"])

    return streams.select(F.col("stream_id").cast("long").alias("stream_id"), "data").mapInArrow(run, "stream_id long, alphabet string, symbol int, freq long")


def fixed_block_bits(tokens: DataFrame) -> DataFrame:
    """(stream_id, bits, n_bytes) of each stream as one block of fixed codes."""
    literal = F.when(F.col("literal") < 144, 8).otherwise(9)
    extra = F.lit(0)
    for _, base, n in length_codes():
        if n:
            extra = F.when(F.col("length") >= base, n).otherwise(extra)
    extra = F.when(F.col("length") == 258, 5).otherwise(extra)
    length_bits = F.when(F.col("length") < 115, 7).otherwise(8) + extra
    far = F.lit(0)
    for _, base, n in distance_codes():
        if n:
            far = F.when(F.col("distance") >= base, n).otherwise(far)
    bits = F.when(F.col("is_literal"), literal).otherwise(length_bits + 5 + far)
    out = tokens.groupBy("stream_id").agg((F.sum(bits) + 10).alias("bits"))
    return out.withColumn("n_bytes", F.ceil(F.col("bits") / 8))
