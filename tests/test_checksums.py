import zlib

import pytest
from pyspark.sql import functions as F

from tesselq.functions import bytes as B
from tesselq.streaming.queue import joined_adler

VECTORS = [(b"", 1), (b"A", 0x00420042), (b"ABC", 0x018D00C7)]


def test_known_answers(spark):
    df = spark.createDataFrame([(bytearray(d), n) for d, n in VECTORS], "data binary, want long")
    for r in df.withColumn("got", B.adler32(B.bytes_of(F.col("data")))).collect():
        assert r.got == r.want


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_against_zlib(spark, n):
    data = bytes((i * 37 + i // 251) % 256 for i in range(n))
    df = spark.createDataFrame([(1, bytearray(data))], "id long, data binary")
    r = df.select(B.adler32(B.bytes_of(F.col("data"))).alias("a"), F.crc32("data").alias("c"), B.bytes_of(F.col("data")).alias("b")).first()
    assert (r.a, r.c, bytes(r.b)) == (zlib.adler32(data), zlib.crc32(data), data)


def test_pieces_join(spark):
    data = bytes(range(256)) * 9
    rows = [(i % 2, i, bytearray(data[i * 100 : i * 100 + 100 - i])) for i in range(20)]
    got = {r.stream_id: r.adler32 for r in joined_adler(spark.createDataFrame(rows, "stream_id long, seq int, data binary").repartition(5), F.col("data")).collect()}
    for s in (0, 1):
        assert got[s] == zlib.adler32(b"".join(bytes(d) for k, _, d in rows if k == s))


def test_fields(spark):
    df = spark.range(1).select(F.hex(B.be32(F.lit(258))).alias("a"), F.hex(B.be16(F.lit(258))).alias("b"), F.hex(B.le16(F.lit(258))).alias("c"), B.reverse_bits(F.lit(6), F.lit(4)).alias("d"), B.trigram_hash(F.lit(255), F.lit(1), F.lit(2)).alias("h"))
    assert tuple(df.first()) == ("00000102", "0102", "0201", 6, ((255 << 10) ^ (1 << 5) ^ 2) & 0x7FFF)
