"""Columns over byte sequences: byte arrays, checksums, big- and little-endian fields, bit reversal."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest prime below 2**16, modulus of Adler-32.
ADLER = 65521


def chars_of(binary: Column) -> Column:
    """The bytes of a BINARY as one-character strings (Latin-1); empty for an empty one."""
    return F.when(F.octet_length(binary) > 0, F.split(F.decode(binary, "ISO-8859-1"), "")).otherwise(F.array().cast("array<string>"))


def bytes_of(binary: Column) -> Column:
    """The bytes of a BINARY as ARRAY<INT>."""
    return F.transform(chars_of(binary), lambda c: F.ascii(c))


def be32(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def be16(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 4, "0"))


def le16(value: Column) -> Column:
    return F.concat(byte(F.pmod(value, F.lit(256))), byte(F.floor(value / 256)))


def byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def adler_parts(numbers: Column) -> tuple[Column, Column]:
    """The two sums of Adler-32 over ARRAY<INT>, in closed form: both are sums over positions, so pieces merge.

    The lambdas don't look at the array itself, so that each sum is one pass.
    """
    n = F.size(numbers).cast("long")
    zero = F.lit(0).cast("long")
    plain = F.aggregate(numbers, zero, lambda s, b: s + b)
    by_place = F.aggregate(F.transform(numbers, lambda b, i: i.cast("long") * b), zero, lambda s, b: s + b)
    return F.pmod(plain + 1, F.lit(ADLER)), F.pmod(n + n * plain - by_place, F.lit(ADLER))


def adler32_of(binary: Column) -> Column:
    """Adler-32 of a BINARY, from its own buffer; null of null."""
    return adler32_udf()(binary)


def adler32_udf() -> Callable[[Column], Column]:
    @F.arrow_udf("long")
    def of(data: pa.Array) -> pa.Array:
        return pa.array([zlib.adler32(x.as_buffer()) if x.is_valid else None for x in data], pa.int64())

    return of


def adler32(numbers: Column) -> Column:
    s1, s2 = adler_parts(numbers)
    return s2 * 65536 + s1


def adler_joined(s1_a: Column, s2_a: Column, s1_b: Column, s2_b: Column, n_b: Column) -> tuple[Column, Column]:
    """The sums of a sequence from those of its two pieces; n_b: length of the second."""
    return F.pmod(s1_a + s1_b - 1, F.lit(ADLER)), F.pmod(s2_a + s2_b + F.pmod(n_b, F.lit(ADLER)) * (s1_a - 1), F.lit(ADLER))


def reverse_bits(value: Column, n: Column) -> Column:
    """The n lowest bits in the opposite order."""
    return F.when(n > 0, F.conv(F.reverse(F.lpad(F.bin(value.cast("long")), n.cast("int"), F.lit("0"))), 2, 10).cast("long")).otherwise(0)


def trigram_hashes_of(binary: Column) -> Column:
    """The 15-bit hashes of a BINARY's runs of three bytes, as ARRAY<INT>; all rows of a batch in one pass."""
    return trigram_hashes_udf()(binary)


def trigram_hashes_udf() -> Callable[[Column], Column]:
    @F.arrow_udf("array<int>")
    def of(data: pa.Array) -> pa.Array:
        data = data.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset)
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int32)
        hashes = ((raw[:-2] << 10) ^ (raw[1:-1] << 5) ^ raw[2:]) & 0x7FFF
        sizes = np.maximum(np.diff(ends) - 2, 0)
        offsets = np.append(0, np.cumsum(sizes))
        own = np.arange(offsets[-1]) + np.repeat(ends[:-1] - ends[0] - offsets[:-1], sizes)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[own] if len(own) else np.zeros(0, np.int32), pa.int32()))

    return of


def trigram_hash(a: Column, b: Column, c: Column) -> Column:
    """The 15-bit hash of three bytes by which matches are looked up."""
    return F.shiftleft(a, 10).bitwiseXOR(F.shiftleft(b, 5)).bitwiseXOR(c).bitwiseAND(0x7FFF)
