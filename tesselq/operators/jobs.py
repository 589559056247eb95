"""The compression queue as tables: latest status, selection, updates and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselq.functions import dims, labels

#: The states of a job, in order.
STATES = ("pending", "decoding", "compressing", "done", "error")


def new_jobs(files: DataFrame) -> DataFrame:
    """Pending jobs for files(id, name, mime, original_bytes); what isn't known yet is null."""
    return files.select(
        "id", "name", "mime", labels.file_kind(F.col("mime"), F.col("name")).alias("kind"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"),
        F.col("original_bytes").cast("long").alias("original_bytes"), *(F.lit(None).cast("long").alias(c) for c in ("compressed_bytes", "width", "height")),
    )


def pasted(files: DataFrame) -> DataFrame:
    """Only images are taken from a paste."""
    return files.where(F.startswith("mime", F.lit("image/")))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job: events(id, seq, status, …); one aggregation, no window."""
    rest = [c for c in events.columns if c != "id"]
    return events.groupBy("id").agg(F.max(F.struct("seq", *(c for c in rest if c != "seq"))).alias("last")).select("id", "last.*")


def updated(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs with the columns of changes(id, …) that aren't null in place of their own; unknown ids change nothing."""
    c = changes.select(F.col("id").alias("_id"), *(F.col(x).alias(f"_{x}") for x in changes.columns if x != "id"))
    return jobs.join(c, jobs.id == c._id, "left").select(*(F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in c.columns and x != "id" else x for x in jobs.columns))


def without(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("id"), "id", "left_anti")


def cleared(jobs: DataFrame) -> DataFrame:
    return jobs.limit(0)


def appended(jobs: DataFrame, more: DataFrame) -> DataFrame:
    return jobs.unionByName(more)


def states_passed(kind: Column, unread: Column, error: Column) -> Column:
    """The states a job goes through: a PNG is decoded, then compressed, and ends in error where either says so; a JPEG is
    looked at and ends in error, a file of another kind ends there at once."""
    names = lambda *states: F.array(*map(F.lit, states))
    return (
        F.when(kind == "jpeg", names("pending", "decoding", "error")).when(F.coalesce(kind != "png", F.lit(True)), names("pending", "error"))
        .when(unread.isNotNull(), names("pending", "decoding", "error")).when(error.isNotNull(), names("pending", "decoding", "compressing", "error"))
        .otherwise(names("pending", "decoding", "compressing", "done"))
    )


def transitions(jobs: DataFrame) -> DataFrame:
    """(id, seq, status) of jobs(id, kind, unread, error): a row for each state, so that latest() gives the job's end."""
    return jobs.select("id", F.posexplode(states_passed(F.col("kind"), F.col("unread"), F.col("error"))).alias("seq", "status"))


def replies(messages: DataFrame) -> DataFrame:
    """A worker's answers (session, seq, type, id, error) to messages(session, seq, type, id, failed).

    init: ready. compress: error without an id, or before the session's first init, or with `failed` where encoding has
    failed; else compressed. Other messages have no answer. One number a session is joined back.
    """
    ready = messages.where("type = 'init'").groupBy("session").agg(F.min("seq").alias("ready"))
    asked = messages.where("type IN ('init', 'compress')").join(ready, "session", "left")
    error = (
        F.when(F.col("type") == "init", None).when(F.col("id").isNull(), "invalid compress message")
        .when(F.coalesce(F.col("ready") > F.col("seq"), F.lit(True)), "not initialized").otherwise(F.col("failed"))
    )
    kind = F.when(error.isNotNull(), "error").when(F.col("type") == "init", "ready").otherwise("compressed")
    return asked.select("session", "seq", kind.alias("type"), F.when(F.col("type") == "compress", F.col("id")).alias("id"), error.alias("error"))


def with_settings(jobs: DataFrame) -> DataFrame:
    """jobs with the settings of their preset, by a join with dim_preset, which is five rows of a literal and so broadcast; an
    unknown or missing name has the balanced one's."""
    known = [row[0] for row in dims.PRESETS]
    named = jobs.withColumn("preset", F.when(F.col("preset").isin(*known), F.col("preset")).otherwise("balanced"))
    return named.join(F.broadcast(dims.dim_preset(jobs.sparkSession)), "preset")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'pending'")


def downloads(jobs: DataFrame) -> DataFrame:
    """Done jobs with a result, in order of id, a tenth of a second apart.

    The order is a list for one user to click through; its window has one partition for each session.
    """
    from pyspark.sql import Window

    done = jobs.where("status = 'done' AND compressed_bytes IS NOT NULL")
    return done.select("session", "id", labels.download_name(F.col("name")).alias("file"), (F.row_number().over(Window.partitionBy("session").orderBy("id")) * 100 - 100).alias("delay_ms"))


def summary(jobs: DataFrame) -> DataFrame:
    """Of each session: its number of jobs, whether some are pending or done, and bytes saved."""
    return jobs.groupBy("session").agg(
        F.count("*").alias("n_jobs"), F.bool_or(F.col("status") == "pending").alias("any_pending"), F.bool_or(F.col("status") == "done").alias("any_done"),
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("original_bytes") - F.col("compressed_bytes"))), F.lit(0)).alias("bytes_saved"),
    )
