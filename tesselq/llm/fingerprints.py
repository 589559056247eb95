"""Document fingerprints: invertible Bloom lookup sketches of paragraphs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, rows_of, text_of

#: Cells of a fingerprint's sketch, a multiple of HASHES.
CELLS = 18
HASHES = 3
#: A paragraph ends at a line's end, or after a mark that a blank follows.
ENDS = re.compile(r"\n|(?<=[.!?,;:|])\s")
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
CHECK = np.uint64(0x27D4EB2F165667C5)
#: Characters of texts that are held at once, and rows of them.
HELD_CHARS, HELD_ROWS = 2_000_000, 400


def keys_of(text: str) -> np.ndarray:
    """64-bit digests of a text's paragraphs that are not blank; the k-th of equal ones has a digest of its own."""
    found = np.array([xxhash.xxh3_64_intdigest(p) for p in ENDS.split(text) if p and not p.isspace()], np.uint64)
    found.sort()
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found.astype(np.int64)
    turn = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    return mixed(found + turn.astype(np.uint64) * SEEDS[0])


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


class Sketches:
    """Sketches of many sets side by side: in each cell the number, the sum and the sum of checks of its keys."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.sum = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        each = self.cells // HASHES
        factor = np.asarray(sign, np.int64).astype(np.uint64)
        check = mixed(keys ^ CHECK)
        for j in range(HASHES):
            at = owner * self.cells + j * each + (mixed(keys + SEEDS[j]) % np.uint64(each)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, keys * factor)
            np.add.at(self.check, at, check * factor)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, key and sign of every key that peels off, and which sketches come out empty."""
        found = []
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[one]
            factor = sign.astype(np.uint64)
            keys = self.sum[one] * factor
            pure = mixed(keys ^ CHECK) == self.check[one] * factor
            if not pure.any():
                break
            owner, keys, sign = one[pure] // self.cells, keys[pure], sign[pure]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            first = np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))
            owner, keys, sign = owner[first], keys[first], sign[first]
            self.add(keys, owner, -sign)
            found.append((owner, keys, sign))
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        empty = ~left.reshape(self.n, self.cells).any(axis=1) if self.n else np.zeros(0, bool)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), empty
        return *(np.concatenate(x) for x in zip(*found, strict=True)), empty

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.n, out.count, out.sum, out.check = self.n, self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def part(self, a: int, z: int) -> Sketches:
        out, own = Sketches(0, self.cells), slice(a * self.cells, z * self.cells)
        out.n, out.count, out.sum, out.check = z - a, self.count[own], self.sum[own], self.check[own]
        return out

    def packed(self, i: int) -> bytes:
        own = slice(i * self.cells, (i + 1) * self.cells)
        return self.count[own].astype("<u4").tobytes() + self.sum[own].astype("<u8").tobytes() + self.check[own].astype("<u8").tobytes()

    @staticmethod
    def unpacked(all_packed: list[bytes]) -> Sketches:
        """The sketches of fingerprints, all of one size."""
        out = Sketches(len(all_packed), len(all_packed[0]) // 20 if all_packed else CELLS)
        for i, raw in enumerate(all_packed):
            own, n = slice(i * out.cells, (i + 1) * out.cells), out.cells
            out.count[own], out.sum[own], out.check[own] = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u8", n, 4 * n), np.frombuffer(raw, "<u8", n, 12 * n)
        return out


def sketched(keys: list[np.ndarray], cells: int) -> Sketches:
    out = Sketches(len(keys), cells)
    out.add(*_flat(keys), 1)
    return out


def peeled(apart: Sketches) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each difference of two sketches the keys of the old alone and of the new alone; None where it doesn't peel."""
    owner, keys, sign, empty = apart.peel()
    order = np.argsort(owner, kind="stable")
    owner, keys, sign = owner[order], keys[order], sign[order]
    cuts = np.searchsorted(owner, np.arange(apart.n + 1))
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out.append((keys[a:z][sign[a:z] > 0], keys[a:z][sign[a:z] < 0]) if empty[i] else None)
    return out


def differences(old: list[np.ndarray], new: list[np.ndarray], apart: Sketches | None = None, cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of key sets the keys of the old alone and of the new alone.

    apart: the difference of the stored sketches, where there are any. The sketches are subtracted and peeled; pairs whose
    difference doesn't peel are sketched again, twice as large. A sketch of more than eight cells for each key peels but
    for one chance in many billions, unless two digests of a text are equal; then the sets are compared themselves.
    """
    out: list = [None] * len(old)
    todo = list(range(len(old)))
    while todo:
        a, z = [old[i] for i in todo], [new[i] for i in todo]
        found = peeled(apart if apart is not None else sketched(a, cells).minus(sketched(z, cells)))
        for i, keys in zip(todo, found, strict=True):
            out[i] = keys
            if keys is None and cells > 8 * (len(old[i]) + len(new[i])) + CELLS:
                out[i] = (np.setdiff1d(old[i], new[i]), np.setdiff1d(new[i], old[i]))
        todo, cells, apart = [i for i in todo if out[i] is None], 2 * cells, None
    return out


def fingerprints(texts: list[str], keys: list[np.ndarray], sketches: Sketches) -> list[str]:
    """A hash of the whole text, the number of paragraphs, and the sketch."""
    return [f"{xxhash.xxh3_128_hexdigest(t)}.{len(k)}." + base64.b64encode(sketches.packed(i)).decode() for i, (t, k) in enumerate(zip(texts, keys, strict=True))]


def compare_fingerprints(old: list[str], new: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """What peels off the differences of stored fingerprints alone: as `peeled`; equal texts differ in nothing."""
    raw = [[base64.b64decode(f.split(".")[2]) for f in side] for side in (old, new)]
    found = peeled(Sketches.unpacked(raw[0]).minus(Sketches.unpacked(raw[1])))
    none = np.zeros(0, np.uint64)
    return [(none, none) if a == b else x for a, b, x in zip(old, new, found, strict=True)]


def likeness(n_old: int, n_new: int, removed: int) -> float:
    """Twice the common paragraphs over all; 1 for two texts without any."""
    return 2 * (n_old - removed) / (n_old + n_new) if n_old + n_new else 1.0


VERSIONS = "doc_id long, fingerprint string, other_fingerprint string, likeness double, removed array<long>, added array<long>"


def _few(rows: Iterator[tuple], texts: tuple[int, ...]) -> Iterator[list[tuple]]:
    """Rows in lists that are bounded by their number and by the characters of their texts."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(row[i]) for i in texts)
        if len(held) >= HELD_ROWS or chars >= HELD_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _few((r for b in batches for r in rows_of(b)), (1, 2)):
        ids, old, new = zip(*rows, strict=True)
        a, z = [keys_of(t) for t in old], [keys_of(t) for t in new]
        one, two = sketched(a, CELLS), sketched(z, CELLS)
        gone = differences(a, z, one.minus(two))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(fingerprints(old, a, one)), pa.array(fingerprints(new, z, two)), pa.array([likeness(len(x), len(y), len(d[0])) for x, y, d in zip(a, z, gone, strict=True)], pa.float64())]
            + [pa.array([np.sort(d[k]).view(np.int64) for d in gone], pa.list_(pa.int64())) for k in (0, 1)],
            ["doc_id", "fingerprint", "other_fingerprint", "likeness", "removed", "added"],
        )


def compare_versions(versions: DataFrame) -> DataFrame:
    """For each row of versions(doc_id, text, other): VERSIONS' columns.

    removed and added: digests of the paragraphs of one text alone, recovered from the difference of the sketches.
    Null texts: empty, of no paragraphs; two such texts are alike. Null doc_id: kept. Repeated rows: one result each.
    """
    rows = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("other", F.lit("")).alias("other"))
    return rows.mapInArrow(_compare, VERSIONS)


CYCLE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cycle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, extra) in order; a row's next is the one after it, an extra row only serves as a next."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        ids = [r[0] for r in rows[:-1]]
        texts = [r[1] for r in rows]
        keys = [keys_of(t) for t in texts]
        own = texts[:-1]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, texts[1:], strict=True)]
        edited_keys = [keys_of(t) for t in edited]
        a, every, altered = keys[:-1], sketched(keys, CELLS), sketched(edited_keys, CELLS)
        first, second = every.part(0, len(own)), every.part(1, len(own) + 1)
        pairs = ((edited_keys, altered), (keys[1:], second))
        near = [[likeness(len(x), len(y), len(d[0])) for x, y, d in zip(a, other, differences(a, other, first.minus(theirs)), strict=True)] for other, theirs in pairs]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string())]
            + [pa.array(fingerprints(own, a, first), pa.string()), pa.array(fingerprints(edited, edited_keys, altered), pa.string())]
            + [pa.array(x, pa.float64()) for x in near],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held: list[tuple] = []
    chars = 0
    for row in (r for b in batches for r in rows_of(b)):
        if held and held[-1][2]:
            break
        held.append(row)
        chars += len(row[1])
        if len(held) > HELD_ROWS or chars > HELD_CHARS and len(held) > 1:
            yield result(held)
            held = held[-1:]
            chars = len(held[0][1])
    if len(held) > 1:
        yield result(held)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): CYCLE's columns, of the text, its edited text and the next document.

    Edited text: the last half (floor of n/2 code points) is replaced by the first as many of the next document's, by
    ascending doc_id, after the last the first. likeness is that of compare_versions.

    Texts are dealt once, to ranges of doc_id of about equal size, and sorted there; the first document of each range
    is dealt to the range before it too. The ranges are as many as shuffle partitions.

    Null text: empty. Null doc_id: before all others. Equal doc_id: in order of a hash of the text. One row: it is its
    own next. Empty table: no rows. Other columns are not read.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = partitions(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"), order.alias("order")).withColumn("at", F.col("order").cast("double"))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n) if n > 1 else F.lit(None)).first()[0]
    bucketizer = Bucketizer(splits=[-float("inf"), *sorted(set(cuts or [0.0])), float("inf")], inputCol="at", outputCol="range", handleInvalid="keep")
    heads = bucketizer.transform(rows.select("at", "order")).groupBy("range").agg(F.min("order").alias("order")).orderBy("range").collect()
    if not heads:
        return spark.createDataFrame([], CYCLE)
    ranged = bucketizer.transform(rows)
    # one row for each range at most
    before = F.broadcast(spark.createDataFrame([(h.order, heads[i - 1].range) for i, h in enumerate(heads)], "order long, other double"))
    both = F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("other").alias("range"), F.lit(True).alias("extra")))
    dealt = ranged.join(before, "order", "left").withColumn("to", F.explode(F.filter(both, lambda x: x["range"].isNotNull())))
    dealt = dealt.select("doc_id", "text", F.col("to.extra").alias("extra"), "order", F.col("to.range").cast("int").alias("range"))
    dealt = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("extra", "order", F.xxhash64("text"))
    return dealt.select("doc_id", "text", "extra").mapInArrow(_cycle, CYCLE)
