"""Dictionary matching: the best earlier match at each position and the greedy parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
LEAST, MOST, FARTHEST = 3, 258, 32768
#: Lengths up to this are found by sorting.
SORTED = 8
TOKENS = "stream_id long, seq int, pos int, is_literal boolean, literal int, distance int, length int"


def chain_of(level: int) -> int:
    """Candidates looked at: levels 1 to 9 double from 4."""
    return 4 << (max(1, min(9, level)) - 1)


def best_matches(data: bytes, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the longest match (0: none) with one of the `chain` latest positions of its hash, the nearest of
    equally long ones, and its distance.

    Whether a position was inside an earlier match doesn't matter, so all positions are searched side by side. Sorting by
    the next k bytes gives each position the latest earlier one that agrees in them; if any of the candidates agrees so
    far, that one is a candidate too, as it is nearer and later in the chain. So for k up to SORTED no chain is followed:
    the longest k with a candidate is the length. Only where all SORTED bytes agree are those candidates looked at one after
    the other, and extended eight bytes at a time.
    """
    n = len(data)
    length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < LEAST + 1:
        return length, distance
    raw = np.frombuffer(data + b"\0" * (MOST + 16), np.uint8)
    eight = np.ndarray((n + MOST + 8,), "<u8", raw, strides=(1,))
    d = raw[:n].astype(np.uint16)
    hashes = ((d[:-2] << 10) ^ (d[1:-1] << 5) ^ d[2:]) & 0x7FFF
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.append(True, hashes[order[1:]] != hashes[order[:-1]]))
    turn = np.empty(n - 2, np.int64)  # a position's place in its chain
    turn[order] = np.arange(n - 2) - np.repeat(first, np.diff(np.append(first, n - 2)))
    at = np.arange(n - 2)
    before = np.full(n - 2, -1, np.int64)
    for k in range(LEAST, SORTED + 1):
        at = at[at + k <= n]
        if not len(at):
            break
        key = eight[at] & np.uint64((1 << 8 * k) - 1)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        same = np.append(False, key[1:] == key[:-1])
        late, early = at[same], at[np.append(same[1:], False)]
        fit = (late - early <= FARTHEST) & (turn[late] - turn[early] <= chain)
        length[late[fit]], distance[late[fit]] = k, (late - early)[fit]
        if k == SORTED:
            before[late] = early
        at = np.sort(at[same | np.append(same[1:], False)])
    at = np.flatnonzero(length[: n - 2] == SORTED)
    start, limit, earlier = turn[at], np.minimum(MOST, n - at), before[at]
    while len(at):
        use = (earlier >= 0) & (at - earlier <= FARTHEST) & (start - turn[earlier] <= chain) & (length[at] < limit)
        at, start, limit, earlier = at[use], start[use], limit[use], earlier[use]
        # only a candidate that agrees up to one past the best so far can be longer
        hope = np.flatnonzero(raw[at + length[at]] == raw[earlier + length[at]])
        reach = np.zeros(len(at), np.int64)
        k = 0
        while len(hope) and k < MOST:
            x = eight[at[hope] + k] ^ eight[earlier[hope] + k]
            ended = x != 0
            low = x[ended]
            reach[hope[ended]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            hope = hope[~ended]
            k += 8
        reach[hope] = MOST
        reach = np.minimum(reach, limit)
        better = reach > length[at]
        length[at[better]] = reach[better]
        distance[at[better]] = (at - earlier)[better]
        earlier = before[earlier]
    return length, distance


def match_rows(streams: DataFrame, level: int = 6) -> DataFrame:
    """(stream_id, pos, length, distance) of streams(stream_id, data): the best match of each position that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                length, distance = best_matches(data or b"", chain_of(level))
                pos = np.flatnonzero(length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), stream), pa.int64()), *(pa.array(x, pa.int32()) for x in (pos, length[pos], distance[pos]))], ["stream_id", "pos", "length", "distance"])

    return streams.select("stream_id", "data").mapInArrow(run, "stream_id long, pos int, length int, distance int")


def parse(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, lengths (0: literal) and distances of the greedy parse."""
    length, distance = best_matches(data, chain_of(level))
    steps = np.maximum(length, 1).tolist()
    path, p, n = [], 0, len(data)
    while p < n:
        path.append(p)
        p += steps[p]
    path = np.array(path, np.int64)
    return path, length[path], distance[path]


def restore(literals: list[int], lengths: list[int], distances: list[int]) -> bytes:
    """The bytes that tokens stand for."""
    out = bytearray()
    for literal, n, d in zip(literals, lengths, distances, strict=True):
        if not n:
            out.append(literal)
        elif d >= n:
            out += out[len(out) - d : len(out) - d + n]
        else:
            unit = bytes(out[len(out) - d :])
            out += (unit * (n // d + 1))[:n]
    return bytes(out)


def tokens(streams: DataFrame, level: int = 6) -> DataFrame:
    """TOKENS rows of streams(stream_id, data): one row for each literal and match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pos, length, distance = parse(data or b"", level)
                literal = np.frombuffer(data or b"", np.uint8)[pos].astype(np.int32) if len(pos) else np.zeros(0, np.int32)
                plain = length == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pos), stream), pa.int64()), pa.array(np.arange(len(pos)), pa.int32()), pa.array(pos, pa.int32()), pa.array(plain), pa.array(literal, pa.int32(), mask=~plain), pa.array(distance, pa.int32(), mask=plain), pa.array(length, pa.int32(), mask=plain)],
                    ["stream_id", "seq", "pos", "is_literal", "literal", "distance", "length"],
                )

    return streams.select("stream_id", "data").mapInArrow(run, TOKENS)


def restored(found: DataFrame) -> DataFrame:
    """(stream_id, data) back from TOKENS rows; a stream's tokens are one group."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("seq").to_numpy())
        literal, length, distance = (table.column(c).fill_null(0).to_numpy()[order].tolist() for c in ("literal", "length", "distance"))
        return pa.table({"stream_id": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([restore(literal, length, distance)], pa.binary())})

    return found.groupBy("stream_id").applyInArrow(one, "stream_id long, data binary")


def round_trip(streams: DataFrame, level: int) -> DataFrame:
    """(stream_id, n_tokens, n_matches, data): parsed and restored in place, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stream, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pos, length, distance = parse(data or b"", level)
                literal = np.frombuffer(data or b"", np.uint8)[pos].tolist() if len(pos) else []
                rows.append((stream, len(pos), int((length > 0).sum()), restore(literal, length.tolist(), distance.tolist())))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["stream_id", "n_tokens", "n_matches", "data"])

    return streams.select("stream_id", "data").mapInArrow(run, "stream_id long, n_tokens long, n_matches long, data binary")


def window_match(window: bytes, ahead: bytes) -> tuple[int, int]:
    """(distance, length) of the longest match of `ahead` that lies wholly in the window, the nearest of equals; (0, 0) if
    none has three bytes. A check on the other search: it looks at every place and never overlaps."""
    for n in range(min(MOST, len(ahead), len(window)), LEAST - 1, -1):
        at = window.rfind(ahead[:n])
        if at >= 0 and len(window) - at <= FARTHEST:
            return len(window) - at, n
    return 0, 0


def window_before(data: Column, at: Column, size: int = FARTHEST) -> Column:
    """The last `size` bytes of a stream before the place `at`: what a sliding window holds there; FARTHEST at most."""
    size = min(size, FARTHEST)
    return F.substring(data, F.greatest(at - size, F.lit(0)) + 1, F.least(at, F.lit(size)))


def slid(window: bytes, more: bytes, size: int = FARTHEST) -> bytes:
    """A window after more bytes: the latest `size`, FARTHEST at most. As state of a stream it doesn't grow."""
    size = min(size, FARTHEST)
    return (window + more)[-size:] if size > 0 else b""


def window_matches(places: DataFrame) -> DataFrame:
    """(stream_id, pos, length, distance) of places(stream_id, pos, window, ahead) where window_match finds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [window_match(w, a) for w, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for _, n in found], pa.int32()), pa.array([d for d, _ in found], pa.int32())], ["stream_id", "pos", "length", "distance"])
            yield out.filter(pa.array([n > 0 for _, n in found], pa.bool_()))

    return places.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("pos").cast("int").alias("pos"), "window", "ahead").mapInArrow(run, "stream_id long, pos int, length int, distance int")


def best_matches_sql(positions: DataFrame, chain: int) -> DataFrame:
    """The same search as relations, for streams of some hundred bytes: positions(stream_id, pos, hash, data, n).

    Positions of one hash are joined to the earlier ones, the latest `chain` of each stay, and the first difference
    gives the length. (stream_id, pos, length, distance).
    """
    from pyspark.sql import Window

    a = positions.select("stream_id", "hash", "pos", "data", "n")
    b = positions.select("stream_id", "hash", F.col("pos").alias("earlier"))
    near = a.join(b, ["stream_id", "hash"]).where((F.col("earlier") < F.col("pos")) & (F.col("pos") - F.col("earlier") <= FARTHEST))
    latest = Window.partitionBy("stream_id", "pos").orderBy(F.desc("earlier"))
    near = near.withColumn("k", F.row_number().over(latest)).where(F.col("k") <= chain)
    most = F.least(F.lit(MOST), F.col("n") - F.col("pos"))
    agree = F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.when(F.get("data", F.col("pos") + i) != F.get("data", F.col("earlier") + i), i))
    near = near.withColumn("length", F.coalesce(F.array_min(agree), most))
    best = F.max(F.struct("length", (F.col("earlier") - F.col("pos")).alias("minus_distance")))
    return near.where(F.col("length") >= LEAST).groupBy("stream_id", "pos").agg(best.alias("best")).select("stream_id", "pos", F.col("best.length").alias("length"), (-F.col("best.minus_distance")).alias("distance"))
