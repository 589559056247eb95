"""What the text operators share: the shared folder, written tables, word splitting, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that are not a digit, a letter or part of a non-ASCII character become a space; A-Z become a-z.
WORDS_ONLY = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where none is and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesselq-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders that this session has made in the shared one.
MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def tidy(spark: SparkSession) -> None:
    """Removes the folders that operators have made so far; DataFrames that read them end with them."""
    jvm = spark.sparkContext._jvm
    while MADE:
        path = jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts its lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: Column, mark: Column) -> Column:
    """One text for an id, null or not, and a mark that has no colon."""
    return F.concat_ws(":", mark, doc_id.cast("long").cast("string"))


def one_of_each(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """The rows of docs whose key is in stay(key), one for each key, with all their columns, whatever these are named."""
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def text_of(df: DataFrame, *keys: str) -> DataFrame:
    """The key columns and text alone, null text as the empty one; other columns can't clash."""
    return df.select(*keys, F.coalesce("text", F.lit("")).alias("text"))


class WordHashes(dict):
    """64-bit hashes of words (bytes); emptied when it holds `most` words, so its memory is bounded."""

    def __init__(self, seed: int = 0, most: int = 250_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; the whole sequence as one if there are fewer words."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return out


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """A batch's rows, a few at a time as Python values."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.slice(at, step).to_pylist() for c in batch.columns), strict=True)


#: Caches that outlive a task in its worker; other operators' tasks empty them.
KEPT: list[dict] = []


def fresh(*own: dict) -> None:
    """Gives back what earlier tasks have left in this worker, but for the caches `own`."""
    import ctypes
    import gc

    for cache in KEPT:
        if not any(cache is x for x in own):
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
