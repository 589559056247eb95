"""Names for SQL: functions and a table function that a session can be given."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tesselq.functions.bytes import adler32_udf, trigram_hashes_udf


@udtf(returnType="seq int, pos int, is_literal boolean, literal int, distance int, length int")
class DeflateTokens:
    """deflate_tokens(data, level): a row for each literal and match of the greedy parse; null has none."""

    def eval(self, data: bytes | None, level: int) -> Iterator[tuple]:
        from tesselq.operators.matching import parse

        raw = bytes(data or b"")
        for seq, (p, n, d) in enumerate(zip(*(x.tolist() for x in parse(raw, level)), strict=True)):
            yield (seq, p, False, None, d, n) if n else (seq, p, True, raw[p], None, None)


def register(spark: SparkSession) -> None:
    """Makes deflate_tokens, adler32 and trigram_hashes known to the session's SQL."""
    spark.udtf.register("deflate_tokens", DeflateTokens)
    spark.udf.register("adler32", adler32_udf())
    spark.udf.register("trigram_hashes", trigram_hashes_udf())
