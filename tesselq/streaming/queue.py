"""Streams: files that arrive in a folder are encoded, and checksums that go on from batch to batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselq.functions.bytes import adler_joined, adler_parts, bytes_of
from tesselq.functions.labels import file_kind
from tesselq.operators.jobs import states_passed
from tesselq.operators.png import decode_png_or_error, encode_png
from tesselq.plans.options import Options

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def encode_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options, files_per_batch: int = 16) -> StreamingQuery:
    """Each PNG file that arrives in `folder` encoded anew as a row of the Parquet table `out`: path, status, error,
    the states it went through, sizes.

    Files of other kinds, and broken ones, end in error. A batch is a partition of `out` by its number, so that one that
    runs again replaces itself. A batch takes at most files_per_batch files; all that have arrived are taken, then
    the query ends (availableNow), and it goes on from its checkpoint when started again.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        files = df.select("path", F.col("length").alias("original_bytes"), F.col("content").alias("data"), file_kind(F.lit(""), F.col("path")).alias("kind"))
        read = decode_png_or_error(files.where("kind = 'png'").select("path", "data"), "path").withColumnRenamed("error", "unread")
        done = encode_png(read.where("unread IS NULL"), options, "path")
        joined = files.drop("data").join(read.select("path", "unread"), "path", "left").join(done, "path", "left")
        error = F.coalesce("unread", "error", F.when(F.col("kind") != "png", F.concat(F.lit("cannot read kind "), "kind")))
        states = states_passed(F.col("kind"), F.col("unread"), F.col("error"))
        joined.select("path", F.element_at(states, -1).alias("status"), error.alias("error"), states.alias("states"), "original_bytes", F.col("n_bytes").alias("compressed_bytes"), "data").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined_adler(pieces: DataFrame, binary: Column) -> DataFrame:
    """(stream_id, adler32) of pieces(stream_id, seq): a piece's sums are made where it lies and joined in order of seq,
    so only three numbers of each piece are shuffled."""
    numbers = bytes_of(binary)
    s1, s2 = adler_parts(numbers)
    parts = pieces.select("stream_id", F.struct("seq", s1.alias("s1"), s2.alias("s2"), F.size(numbers).cast("long").alias("n")).alias("p"))
    start = F.struct(F.lit(1).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))

    def step(acc: Column, p: Column) -> Column:
        a, b = adler_joined(acc["s1"], acc["s2"], p["s1"], p["s2"], p["n"])
        return F.struct(a.cast("long").alias("s1"), b.cast("long").alias("s2"))

    ordered = parts.groupBy("stream_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    total = F.aggregate("ps", start, step)
    return ordered.withColumn("t", total).select("stream_id", (F.col("t.s2") * 65536 + F.col("t.s1")).alias("adler32"))


def adler_stream(pieces: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Running checksums of a stream of pieces(stream_id, seq, data), in order of arrival: the state of each stream is its
    two sums and its length. Each batch's values are a partition of the Parquet table `out`, by the batch's number."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches, state: GroupState):
        import zlib

        value, n = state.get if state.exists else (1, 0)
        for data in sorted((r for b in batches for r in b[["seq", "data"]].itertuples(index=False)), key=lambda r: r.seq):
            value = zlib.adler32(data.data, value)
            n += len(data.data)
        state.update((value, n))
        yield pd.DataFrame({"stream_id": [key[0]], "adler32": [value], "n_bytes": [n]})

    kept = pieces.groupBy("stream_id").applyInPandasWithState(update, "stream_id long, adler32 long, n_bytes long", "value long, n long", "update", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return kept.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
