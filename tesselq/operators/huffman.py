"""Prefix codes: lengths from frequencies, canonical codes, runs of lengths."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselq.functions.bytes import reverse_bits

LONGEST = 15


def code_lengths(freq: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a least-cost prefix code of at most `longest` bits; 0 for symbols that don't occur.

    Two symbols at least get a code: with one, the next one (or the first) is added; with none, the first two.
    """
    freq = with_two_symbols(freq)
    lengths = np.zeros(len(freq), np.int64)
    used = np.flatnonzero(freq)
    tie = count()
    heap = [(int(freq[s]), next(tie), (int(s),)) for s in used]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], next(tie), a[2] + b[2]))
    return lengths if lengths.max() <= longest else _limited(freq, used, longest)


def _limited(freq: np.ndarray, used: np.ndarray, longest: int) -> np.ndarray:
    """By package-merge: pairs of the cheapest items of a level are items of the next; a symbol's length is how often it
    is among the first 2n - 2 items of the last."""
    single = sorted((int(freq[s]), (int(s),)) for s in used)
    items = single
    for _ in range(longest - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(items[::2], items[1::2], strict=False)]
        items = sorted(single + pairs, key=lambda x: x[0])
    lengths = np.zeros(len(freq), np.int64)
    for _, symbols in items[: 2 * len(used) - 2]:
        for s in symbols:
            lengths[s] += 1
    return lengths


def with_two_symbols(freq: np.ndarray) -> np.ndarray:
    out = np.array(freq, np.int64)
    used = np.flatnonzero(out)
    if len(used) == 0:
        out[:2] = 1
    elif len(used) == 1:
        out[(used[0] + 1) % len(out)] = 1
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol, with their bits reversed for a stream whose lowest bit comes first."""
    longest = int(lengths.max(initial=0))
    out = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    share = 1 << (longest - lengths[order])
    starts = np.cumsum(share) - share
    for s, x in zip(order.tolist(), (starts >> (longest - lengths[order])).tolist(), strict=True):
        out[s] = int(f"{x:0{int(lengths[s])}b}"[::-1], 2)
    return out


def code_table(freqs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(stream_id, alphabet, symbol, freq, length) of freqs(stream_id, alphabet, symbol, freq); an alphabet's symbols,
    some hundred at most, are one group."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        symbol, freq = (table.column(c).to_numpy() for c in ("symbol", "freq"))
        dense = np.zeros(max(2, int(symbol.max()) + 2), np.int64)
        dense[symbol] = freq
        lengths = code_lengths(dense, longest)
        used = np.flatnonzero(lengths)
        return pa.table({"stream_id": pa.array([key[0].as_py()] * len(used), pa.int64()), "alphabet": pa.array([key[1].as_py()] * len(used)), "symbol": pa.array(used, pa.int32()), "freq": pa.array(dense[used], pa.int64()), "length": pa.array(lengths[used], pa.int32())})

    schema = "stream_id long, alphabet string, symbol int, freq long, length int"
    return freqs.select("stream_id", "alphabet", F.col("symbol").cast("int").alias("symbol"), F.col("freq").cast("long").alias("freq")).groupBy("stream_id", "alphabet").applyInArrow(one, schema)


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """lengths(stream_id, alphabet, symbol, length) with code and bits: a running sum over (length, symbol) of each
    code's share of all codes of the greatest length; bits is the code reversed."""
    each = Window.partitionBy("stream_id", "alphabet")
    before = each.orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    out = lengths.where(F.col("length") > 0).withColumn("longest", F.max("length").over(each))
    out = out.withColumn("share", F.expr("shiftleft(1L, longest - length)"))
    out = out.withColumn("code", F.coalesce(F.sum("share").over(before), F.lit(0)))
    out = out.withColumn("code", F.expr("shiftright(code, longest - length)"))
    return out.withColumn("bits", reverse_bits(F.col("code"), F.col("length"))).drop("longest", "share")


def fixed_lengths(alphabet: str) -> list[int]:
    """Lengths of the fixed codes, by their ranges of symbols."""
    return [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8 if alphabet == "literal" else [5] * 30


def length_runs(lengths: DataFrame) -> DataFrame:
    """Runs of equal code lengths as (stream_id, alphabet, start, part, symbol, repeat, extra, extra_bits).

    Islands of equal neighbours come from the difference of two row numbers. A run of zeros is cut into pieces of 138
    (symbol 18), of 10 at most (17) from 3 on, and single zeros; another run is its length once, then pieces of 6
    (symbol 16) down to 3, and single lengths.
    """
    each = Window.partitionBy("stream_id", "alphabet")
    island = F.row_number().over(each.orderBy("symbol")) - F.row_number().over(Window.partitionBy("stream_id", "alphabet", "length").orderBy("symbol"))
    runs = lengths.withColumn("island", island).groupBy("stream_id", "alphabet", "length", "island").agg(F.min("symbol").alias("start"), F.count("*").cast("int").alias("n"))
    # zero runs: whole 138s, then what is left; at 11 or more 18 again, at 3 or more 17, else singles
    left = F.col("n") % 138
    zero = F.concat(
        F.array_repeat(F.struct(F.lit(18).alias("symbol"), F.lit(138).alias("repeat")), F.floor(F.col("n") / 138).cast("int")),
        F.when(left >= 11, F.array(F.struct(F.lit(18).alias("symbol"), left.alias("repeat"))))
        .when(left >= 3, F.array(F.struct(F.lit(17).alias("symbol"), left.alias("repeat"))))
        .otherwise(F.array_repeat(F.struct(F.lit(0).alias("symbol"), F.lit(1).alias("repeat")), left.cast("int"))),
    )
    rest = F.col("n") - 1
    own = F.struct(F.col("length").cast("int").alias("symbol"), F.lit(1).alias("repeat"))
    other = F.concat(
        F.array(own),
        F.array_repeat(F.struct(F.lit(16).alias("symbol"), F.lit(6).alias("repeat")), F.floor(rest / 6).cast("int")),
        F.when(rest % 6 >= 3, F.array(F.struct(F.lit(16).alias("symbol"), (rest % 6).alias("repeat")))).otherwise(F.array_repeat(own, (rest % 6).cast("int"))),
    )
    kind = "array<struct<symbol int, repeat int>>"
    out = runs.select("stream_id", "alphabet", "start", F.posexplode(F.when(F.col("length") == 0, zero.cast(kind)).otherwise(other.cast(kind))).alias("part", "p"))
    symbol, repeat = F.col("p.symbol"), F.col("p.repeat")
    return out.select(
        "stream_id", "alphabet", "start", "part", symbol.alias("symbol"), repeat.alias("repeat"),
        F.when(symbol == 18, repeat - 11).when(symbol.isin(16, 17), repeat - 3).otherwise(0).alias("extra"),
        F.when(symbol == 18, 7).when(symbol == 17, 3).when(symbol == 16, 2).otherwise(0).alias("extra_bits"),
    )


def first_code(value: Column, codes: list[tuple[int, int, int]]) -> Column:
    """The first code whose range holds the value; null if none does. Length 258 is so in the range of code 284."""
    out = F.lit(None).cast("int")
    for code, base, extra in reversed(codes):
        out = F.when((value >= base) & (value <= base + (1 << extra) - 1), code).otherwise(out)
    return out


def coded(values: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """values with code, extra and extra_bits, by a join on ranges with codes(code, base, extra, last), some thirty rows made
    from a rule, so broadcast; of two ranges that hold a value the first code's counts. Distinct values are joined and
    met again by value, so the pairs are as few as the format's lengths and distances."""
    found = values.select(column).distinct().join(F.broadcast(codes), F.col(column).between(F.col("base"), F.col("last")))
    first = found.groupBy(column).agg(F.min(F.struct("code", (F.col(column) - F.col("base")).alias("extra"), F.col("extra").alias("extra_bits"))).alias("c"))
    return values.join(first.select(column, "c.*"), column, "left")


def coarse_distance_code(distance: Column) -> Column:
    """A simpler histogram's code: one each up to 4, then one for each doubling up to 16384, then 16; -1 for 0."""
    return F.when(distance == 0, -1).when(distance <= 4, distance - 1).when(distance > 16384, 16).otherwise(F.ceil(F.log2(distance.cast("double"))).cast("int") + 1)
