"""Image files in and out: a folder's PNG files as images, encoded files as a folder or as one chunk stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tesselq.functions.labels import file_kind, output_name
from tesselq.operators.png import decode_png_or_error


def image_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, kind, original_bytes, data) of a folder's files, through Spark's own reader, so of any store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), file_kind(F.lit(""), name).alias("kind"), F.col("length").alias("original_bytes"), F.col("content").alias("data"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """The image files of a folder as (path, image_id, width, height, color_type, pixels, error); image_id is a hash of
    the path, for other operators; nothing is joined by it here. A JPEG, or a PNG that can't be read, has an error and no image."""
    files = image_files(spark, folder).where("kind in ('png', 'jpeg')").withColumn("image_id", F.xxhash64("path"))
    read = decode_png_or_error(files.where("kind = 'png'").select("path", "data"), "path")
    error = F.coalesce("error", F.when(F.col("kind") != "png", F.concat(F.lit("cannot read kind "), "kind")))
    return files.select("path", "image_id", "kind").join(read, "path", "left").withColumn("error", error).drop("kind")


class FileSink(DataSource):
    """Writes each row of (name, data) as a file of the folder given as path: df.write.format("tesselq_files")."""

    @classmethod
    def name(cls) -> str:
        return "tesselq_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        """A file is written under a name of its own and then moved, so that a task may run again."""
        import uuid

        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        for row in iterator:
            part = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(row["data"]))
            system.move(part, f"{folder}/{row['name']}")
        return WriterCommitMessage()


def write_files(files: DataFrame, folder: str) -> None:
    """files(path or name, data) as files of a folder; a path's extension becomes .png."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    name = output_name(F.element_at(F.split("path", "/"), -1)) if "path" in files.columns else F.col("name")
    files.select(name.alias("name"), "data").write.format("tesselq_files").mode("append").save(folder)
