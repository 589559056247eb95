"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, fresh, partitions, text_of, written

PLACES = "length long, first_rank long, each long, bins long, first_sequence long, first_offset long"


#: A character that is one token of its own, between chunks that are encoded together.
MARK = "\x01"
SEPARATOR = f" {MARK} "
#: Marks that compose with letters: lower-casing before composing would give "ǰ" where composing first gives two characters.
COMBINING = re.compile("[\u0300-\u036f]")
#: The first character after the Latin letters.
BEYOND_LATIN = "\u0250"


def _plain(word: str) -> bool:
    """Whether the tokenizer sees letters alone in a word; "İ", say, it lowers to a letter and a mark that joins the next."""
    return word.isalpha() and (word.isascii() or max(word) < BEYOND_LATIN and word.lower().isalpha())


class ChunkIds(dict):
    """Token ids, as little-endian 32-bit bytes, of the pieces of text between blanks.

    The tokenizer drops blanks and lets no token cross them, so the ids of a text are those of its chunks in turn; its
    special tokens have no blank, so that they stand in one chunk too. What is new in some texts is encoded in one call.
    Two generations of at most about `most` chunks are remembered.
    """

    def __init__(self, path: str, most: int):
        import os

        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.old: dict[str, bytes] = {}
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ",.;:!?"}
        self.new: set[str] = set()

    def __missing__(self, chunk: str) -> bytes | None:
        found = self.old.get(chunk)
        if found is None and chunk[-1:] in self.marks and _plain(word := chunk[:-1]):
            # the tokenizer parts letters from marks first
            found = self.get(word) or self.old.get(word)
            found = found and found + self.marks[chunk[-1]]
        if found is None:
            self.new.add(chunk)
        else:
            self[chunk] = found
        return found

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        split = []
        for text in texts:
            # A-Z; the tokenizer lowers the rest. What may hold a special token's name, in whatever case, is left as it is
            if "<|" not in text:
                text = text.lower() if text.isascii() else text if COMBINING.search(text) else text.encode().lower().decode()
            split.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        get = self.__getitem__
        ids = [list(map(get, chunks)) for chunks in split]
        if self.new:
            self.learn(list(self.new))
            self.new.clear()
            ids = [list(map(get, chunks)) if None in found else found for chunks, found in zip(split, ids, strict=True)]
        return [b"".join(found) for found in ids]

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks with a mark after each, and cuts the ids at the mark's."""
        odd = [c for c in chunks if MARK in c]
        if odd:
            self.update((c, np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()) for c in odd)
            chunks = [c for c in chunks if MARK not in c]
        ids = np.array(self.tokenizer.encode_batch_fast([SEPARATOR.join([*chunks, ""])], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(ids == self.mark)).tolist()
        assert len(ends) == len(chunks)
        raw = ids.tobytes()
        self.update((c, raw[x + 4 : y]) for c, x, y in zip(chunks, [-4, *ends], ends, strict=False))


#: A worker's tokenizers and what they remember, kept from task to task.
_KNOWN: dict[tuple[str, int], ChunkIds] = {}
KEPT.append(_KNOWN)


def remembered(path: str, most: int) -> ChunkIds:
    """By this function, which a task refers to by name: what a task's own closure holds ends with it."""
    fresh(_KNOWN)
    key = (path, most)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = ChunkIds(path, most)
    return _KNOWN[key]


def _coded(batch: pa.RecordBatch, ids: ChunkIds, step: int = 32) -> Iterator[tuple[int, bytes]]:
    for at in range(0, batch.num_rows, step):
        yield from zip(batch.column(0).slice(at, step).to_pylist(), ids.of(batch.column(1).slice(at, step).to_pylist()), strict=True)


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = remembered(path, chunks)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            doc, piece, start, length, crc, raw = [], [], [], [], [], []
            for doc_id, coded in _coded(b, ids):
                coded += end
                for k, at in enumerate(range(0, len(coded), width)):
                    part = coded[at : at + width]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    raw.append(part if keep_ids else None)
            columns = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False, chunks: int = 500_000) -> DataFrame:
    """Each document's ids, ended by end_id, in pieces of at most `capacity`; ids: little-endian 32-bit, if kept."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_cut(tokenizer, capacity, end_id, keep_ids, chunks), schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Places for counts[length] items of each length: rows of PLACES, and the number of sequences.

    Items over a third of the capacity go at most two to a bin: the largest is matched with the largest that fits
    beside it, which pairs as many as can be. Smaller ones follow in falling size, each into the tightest gap that
    holds it. Items of one length and bins of one gap are alike, so whole classes move at once and the work
    depends on the number of lengths, not of items.
    """
    left = {n: c for n, c in counts.items() if c}
    places, gaps, bins = [], [], {}
    rank = dict.fromkeys(left, 0)
    sequences = 0

    def put(length: int, each: int, n: int, base: int, offset: int) -> None:
        places.append((length, rank[length], each, n, base, offset))
        rank[length] += each * n
        left[length] -= each * n

    def leave(gap: int, base: int, n: int) -> None:
        if gap and n:
            if gap not in bins:
                insort(gaps, gap)
            bins.setdefault(gap, []).append((base, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        i = bisect_left(large, capacity - n + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        mate = large[i] if i >= 0 else 0
        if mate == n and left[n] == 1:
            mate = large[i - 1] if i > 0 else 0
            while mate and not left[mate]:
                large.pop(i - 1)
                i -= 1
                mate = large[i - 1] if i > 0 else 0
        if not mate:
            count = left[n]
            put(n, 1, count, sequences, 0)
            leave(capacity - n, sequences, count)
        elif mate == n:
            count = left[n] // 2
            put(n, 2, count, sequences, 0)
            leave(capacity - 2 * n, sequences, count)
        else:
            count = min(left[n], left[mate])
            put(n, 1, count, sequences, 0)
            put(mate, 1, count, sequences, n)
            leave(capacity - n - mate, sequences, count)
        sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = min(capacity // n, left[n])
                gap, base, have = capacity, sequences, left[n] // each
                sequences += have
            else:
                gap = gaps[at]
                base, have = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
                each = min(gap // n, left[n])
            use = min(have, left[n] // each)
            put(n, each, use, base, capacity - gap)
            leave(gap - each * n, base, use)
            leave(gap, base + use, have - use)
    return places, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, chunks: int = 500_000) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over `capacity` are cut. The plan is made from the number of pieces of each length, at most
    `capacity` numbers, and broadcast: its size depends on the capacity alone. Each piece finds its place by its rank
    among those of its length, counted in chunks, so that a common length is not one task's.

    Null text: empty, which is the end id alone. Null doc_id: as any other. Repeated rows are packed each. Empty table:
    no rows. Other columns are not read. keep_ids adds ids. chunks: how many pieces of text a worker remembers the ids of,
    twice over; about 150 MB for 500,000.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer, capacity, end_id, keep_ids, chunks), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = F.broadcast(spark.createDataFrame(plan(counts, capacity)[0], PLACES)).withColumnRenamed("length", "place_length")
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, partitions(spark)))).cast("int"))
    by_chunk = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = by_chunk.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "chunk"]).withColumn("rank", F.col("own") + F.col("before"))
    within = F.col("rank") - F.col("first_rank")
    found = ranked.join(
        places,
        (F.col("length") == F.col("place_length")) & (within >= 0) & (within < F.col("each") * F.col("bins")),
    )
    return found.select(
        *(c for c in pieces.columns if c != "chunk"),
        (F.col("first_sequence") + F.expr("(rank - first_rank) div each")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(within, F.col("each")) * F.col("length")).alias("offset"),
    )
