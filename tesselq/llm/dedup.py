"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_of_each, partitions, row_key, text_of, written

#: Runs that one task merges in a round.
FAN_IN = 8
KEY = ("sha", "n_bytes", "second")
RUN = "home int, sha binary, n_bytes long, second long, known boolean, keep_id long, keep_row long, members long"
RUN_ARROW = pa.schema(
    [("home", pa.int32()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("second", pa.int64()), ("known", pa.bool_()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("members", pa.int64())]
)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of entries, which Spark's external sort has merged by home and key, best entry first: one entry for each key.

    Batches are read as they come; no more than one and the last entry before it is held. Entries are equal when
    home, SHA-256, byte length and second hash of the text agree.
    """
    kept: list[pa.Array] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c if kept is None else pa.concat_arrays([k, c]) for k, c in zip(kept or b.columns, b.columns, strict=True)]
        home, sha, n_bytes, second, *_, members = columns
        fixed = sha.cast(pa.binary(32))
        digest = np.frombuffer(fixed.buffers()[1], "<u8", 4 * len(fixed), 32 * fixed.offset).reshape(-1, 4)
        new = np.ones(len(sha), bool)
        new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
        for column in (home, n_bytes, second):
            values = column.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        columns[-1] = pa.array(np.add.reduceat(members.to_numpy(zero_copy_only=False), starts), pa.int64())
        first = pa.array(starts)
        columns[:-1] = [c.take(first) for c in columns[:-1]]
        kept = [c.slice(len(starts) - 1) for c in columns]
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([c.slice(0, len(starts) - 1) for c in columns], schema=RUN_ARROW)
    if kept is not None:
        yield pa.RecordBatch.from_arrays(kept, schema=RUN_ARROW)


def _merged(runs: DataFrame, sign: int) -> DataFrame:
    """One entry for each home and text of each partition's runs: the best (known, id, row) and the members of all.

    The best has the smallest id, or, where sign is -1, the largest. A null id loses to any other.
    """
    best = [F.col(c).asc() if sign > 0 else F.col(c).desc() for c in ("keep_id", "keep_row")]
    ordered = runs.select(*RUN_ARROW.names).sortWithinPartitions("home", *KEY, F.desc("known"), *best)
    return ordered.mapInArrow(_merge, RUN)


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row.

    Each partition makes a sorted run with one entry for each text. The runs lie at the corners of a grid of base
    FAN_IN; in round j, the runs that differ in digit j alone exchange entries, so that digit j of an entry's place
    becomes that of its digest, and each merges what it gets. After the last round every place holds all entries of
    its digests. A run has a text once, so that a group of copies of any size is one entry a run, on the way back too.
    Runs are merged by Spark's sort, which spills, and read as a stream: a task's memory doesn't grow with its runs.

    Null text: empty. Null doc_id: loses to any other id. Rows with equal doc_id and text: one of them stays. Empty
    table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    sign = {"smallest": 1, "largest": -1}[keep]
    rounds = 1
    while FAN_IN**rounds < partitions(spark):
        rounds += 1
    places = FAN_IN**rounds
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("second"),
        F.monotonically_increasing_id().alias("row"),
    )
    # blocks of rows go to the grid's places in turn: few places would else be used by few partitions
    rows = written(rows.withColumn("home", F.pmod(F.xxhash64(F.shiftright("row", 10)), F.lit(places)).cast("int")), "digests")
    entries = rows.select("home", *KEY, F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("members"))
    first = runs = written(_merged(entries, sign), "runs")
    for level in range(rounds):
        step = FAN_IN**level
        digit = F.pmod(F.conv(F.hex(F.substring("sha", level + 1, 1)), 16, 10).cast("int"), F.lit(FAN_IN))
        own = F.pmod(F.floor(F.col("home") / step), F.lit(FAN_IN))
        target = (F.col("home") + (digit - own) * step).cast("int")
        runs = _merged(runs.withColumn("home", target).repartitionById(places, F.col("home")), sign)
    winners = runs.select(*KEY, "known", "keep_id", "keep_row", "members")
    back = first.select("home", *KEY).distinct().join(winners, [*KEY])
    return rows.join(back, ["home", *KEY]).select(
        "doc_id",
        F.when(F.col("known"), F.col("keep_id")).alias("keep_id"),
        F.col("members").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    )


def without_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs, of equal texts one row: the one whose doc_id is kept, with all its columns.

    Null text: equal to the empty one. Null doc_id: stays only where no equal text has an id. Ties: rows of one doc_id
    and text are the same to this operator, and any one of them stays. Empty table: no rows. Other columns are kept,
    whatever their names.
    """
    stay = exact_duplicates(docs, keep).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return one_of_each(docs, row_key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)), stay)
