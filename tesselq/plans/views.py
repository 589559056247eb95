"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, data): documents' texts as UTF-8."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def page_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("stream_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))


def _samples() -> Column:
    return F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))


def images(spark: SparkSession, sf_dir: str, color_type: int = 0) -> DataFrame:
    """embeddings' 64 numbers as samples: 8 x 8 gray (color type 0) or 4 x 4 RGBA (6)."""
    side = 8 if color_type == 0 else 4
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(side).alias("width"), F.lit(side).alias("height"), F.lit(color_type).alias("color_type"), _samples().alias("pixels"))


def opaque_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RGBA images, of which every other is made opaque and every third gray, by its id; all are there."""
    opaque, gray = F.col("image_id") % 2 == 0, F.col("image_id") % 3 == 0
    px = F.transform("pixels", lambda v, i: F.when(opaque & (i % 4 == 3), 255).when(gray & (i % 4 < 3), F.get("pixels", i - i % 4)).otherwise(v))
    return images(spark, sf_dir, 6).withColumn("pixels", px)


def binary_images(df: DataFrame) -> DataFrame:
    """pixels as BINARY, for the codec."""
    return df.withColumn("pixels", F.unhex(F.array_join(F.transform("pixels", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")))


def color_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's quantity, discount and tax as colors of 64 images; without an order of pixels."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 64).alias("image_id"), (F.col("l_quantity") * 5).cast("int").alias("r"),
        (F.round(F.col("l_discount") * 100) * 20).cast("int").alias("g"), (F.round(F.col("l_tax") * 100) * 20).cast("int").alias("b"),
    )


def palette(spark: SparkSession) -> DataFrame:
    """Sixteen colors: the corners of the cube at two brightnesses."""
    rows = [(i, (i & 1) * top, (i >> 1 & 1) * top, (i >> 2 & 1) * top) for i, top in ((i, 127 if i < 8 else 255) for i in range(16))]
    return spark.createDataFrame(rows, "idx int, r int, g int, b int")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each document: sizes from n_chars, a state from its id, its source as session."""
    state = F.element_at(F.array(*map(F.lit, ("pending", "decoding", "compressing", "done", "error"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("session"), F.concat(F.lit("file"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".png").when(F.col("doc_id") % 3 == 1, ".jpg").otherwise(".txt")).alias("name"),
        F.when(F.col("doc_id") % 7 == 0, "image/png").when(F.col("doc_id") % 7 == 1, "image/jpeg").otherwise("application/octet-stream").alias("mime"), state.alias("status"), F.when(F.col("doc_id") % 5 == 4, F.lit("bad file")).alias("error"),
        F.col("n_chars").alias("original_bytes"), F.when(F.col("doc_id") % 5 == 3, F.col("n_chars") * (F.col("doc_id") % 13) / 10).cast("long").alias("compressed_bytes"),
    )
