"""Monotone sequences in Elias-Fano form, searched many at a time, and files of arrays that are mapped into memory."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import tempfile
import uuid

import numpy as np

U = np.uint64
#: Every so many buckets (or values) the place of their bits is noted.
STEP = 8


def _trailing(x: np.ndarray) -> np.ndarray:
    """The number of zeros below the lowest set bit; 64 if there is none."""
    return np.bitwise_count((x & (~x + U(1))) - U(1)).astype(np.int64)


def build(values: np.ndarray, universe: int, access: bool = False, width: int | None = None) -> dict[str, np.ndarray]:
    """The arrays of nondecreasing 64-bit values below `universe`.

    The low bits stand packed. The high bits are in unary: each bucket's values are ones, a zero ends it. access: also
    note the places of values, to read the i-th; the width then leaves at most some 64 zeros between two ones. width: of
    the low bits, if the values are made of a bucket and what stands in it.
    """
    values = np.asarray(values, U)
    n = len(values)
    if width is None:
        width = min(56, max(0, (max(universe, 1) // n).bit_length() - 1)) if n else 0
        if access and n > 1:
            width = max(width, int(np.diff(values).max()).bit_length() - 6)
    buckets = (max(universe, 1) - 1 >> width) + 1 if n else 0
    low, high = values & U((1 << width) - 1), (values >> U(width)).astype(np.int64)
    lows = np.zeros(n * width // 64 + 2, U)
    if width:
        at = np.arange(n, dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U)
        np.bitwise_or.at(lows, word, low << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(lows, word[over] + 1, low[over] >> (U(64) - shift[over]))
    place = high + np.arange(n)
    bits = np.zeros(-(-(n + buckets) // 64) * 64 + 128, np.uint8)
    bits[place] = 1
    size = np.uint32 if n + buckets < 1 << 32 else U
    starts = np.arange(0, buckets + 1, STEP)
    out = {"lows": lows, "highs": np.packbits(bits, bitorder="little").view(U), "bucket_at": (np.searchsorted(high, starts) + starts).astype(size), "shape": np.array([n, width, buckets], np.int64)}
    if access:
        out["value_at"] = place[::STEP].astype(size)
    return out


class EliasFano:
    """Reads what build made; the arrays may be mapped files."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.buckets = (int(x) for x in arrays["shape"])
        self.lows, self.highs, self.bucket_at = arrays["lows"], arrays["highs"], arrays["bucket_at"]
        self.value_at = arrays.get("value_at")

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from `at` on."""
        word, shift = at >> 6, (at & 63).astype(U)
        return (self.highs[word] >> shift) | np.where(shift > 0, self.highs[word + 1] << (U(64) - np.maximum(shift, U(1))), U(0))

    def _past(self, at: np.ndarray, skip: np.ndarray, zeros: bool) -> np.ndarray:
        """The place after `skip` zeros (or ones) from `at` on."""
        at, skip = at.copy(), skip.copy()
        x = self._window(at)
        x = ~x if zeros else x
        have = np.bitwise_count(x).astype(np.int64)
        while (far := np.flatnonzero(have < skip)).size:
            at[far] += 64
            skip[far] -= have[far]
            x[far] = ~self._window(at[far]) if zeros else self._window(at[far])
            have[far] = np.bitwise_count(x[far])
        for t in range(1, STEP):
            more = skip > t
            if not more.any():
                break
            x = np.where(more, x & (x - U(1)), x)
        return np.where(skip > 0, at + _trailing(x) + 1, at)

    def low(self, i: np.ndarray) -> np.ndarray:
        """The i-th values' low bits."""
        if not self.width:
            return np.zeros(len(i), U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U)
        x = (self.lows[word] >> shift) | np.where(shift > 0, self.lows[word + 1] << (U(64) - np.maximum(shift, U(1))), U(0))
        return x & U((1 << self.width) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value in the sequence (of values without repeats), -1 where it isn't there."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        bucket = (values >> U(self.width)).astype(np.int64)
        use = np.flatnonzero((bucket >= 0) & (bucket < self.buckets))
        bucket, low = bucket[use], values[use] & U((1 << self.width) - 1)
        start = self._past(self.bucket_at[bucket // STEP].astype(np.int64), bucket % STEP, True)
        lo = start - bucket
        run = _trailing(~self._window(start))
        while (far := np.flatnonzero((run > 0) & (run % 64 == 0))).size:
            more = _trailing(~self._window(start[far] + run[far]))
            run[far] += more
            if not more.any():
                break
        hi = end = lo + run
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi = hi.copy() if hi is end else hi
            hi[open_] = np.where(less, hi[open_], mid)
        there = np.flatnonzero(lo < end)
        there = there[self.low(lo[there]) == low[there]]
        out[use[there]] = lo[there]
        return out

    def read(self, i: np.ndarray) -> np.ndarray:
        """The i-th values; built with access."""
        at = self._past(self.value_at[i // STEP].astype(np.int64), i % STEP, False)
        # past i % STEP ones stands the next one, after zeros perhaps
        x = self._window(at)
        while (far := np.flatnonzero(x == 0)).size:
            at[far] += 64
            x[far] = self._window(at[far])
        high = at + _trailing(x) - i
        return (high.astype(U) << U(self.width)) | self.low(i)


def spread(first: np.ndarray, n: np.ndarray, value: np.ndarray, room: np.ndarray | int, width: int) -> np.ndarray:
    """Keys for values that stand under owners: an owner with n of them has n buckets, from its `first` on.

    A value below `room` goes to the bucket at its share of the room. Values are as good as random there, so that buckets
    hold about one each under any owner, and a search looks at few, whatever the owner's size.
    """
    return ((first + value * n // np.maximum(room, 1)).astype(U) << U(width)) | value.astype(U)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file, put in its place at once when it is whole, so that a task may run again."""
    system, path = _files(uri)
    at, where = 0, {}
    for name, a in arrays.items():
        where[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 8) % 64)
    part = f"{path}.{uuid.uuid4().hex}"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).data if a.nbytes else b"")
            out.write(b"\0" * (-a.nbytes % 64))
    system.move(part, path)


#: This worker's own copies of files, by the digest of their place; they go when it ends.
_OWN: dict[str, str] = {}


def _fetched(system, path: str, uri: str) -> str:
    """A whole copy of a file in this worker's temporary folder, which others don't read."""
    if uri not in _OWN:
        if not _OWN:
            atexit.register(lambda: [os.path.exists(own) and os.remove(own) for own in _OWN.values()])
        own = os.path.join(tempfile.gettempdir(), f"mapped-{os.getpid()}-{hashlib.sha256(uri.encode()).hexdigest()}")
        with system.open_input_stream(path) as source, open(own, "wb") as out:
            while chunk := source.read(1 << 24):
                out.write(chunk)
        if os.path.getsize(own) != system.get_file_info(path).size:
            os.remove(own)
            raise OSError(f"{uri} was not read whole")
        _OWN[uri] = own
    return _OWN[uri]


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a file that isn't in a mounted folder is fetched to the worker's own first."""
    from pyarrow import fs

    system, path = _files(uri)
    if not isinstance(system, fs.LocalFileSystem):
        path = _fetched(system, path, uri)
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    head = int.from_bytes(raw[:8].tobytes(), "little")
    where = json.loads(raw[8 : 8 + head].tobytes())
    return {name: raw[8 + head + at : 8 + head + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in where.items()}


def prefixed(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def part_of(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k.removeprefix(f"{name}."): v for k, v in arrays.items() if k.startswith(f"{name}.")}
