"""Small dimension tables of the formats, made from their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def length_codes() -> list[tuple[int, int, int]]:
    """(code, base, extra bits): eight codes of one length, then four codes for each number of extra bits."""
    rows = [(257 + i, 3 + i, 0) for i in range(8)]
    base = 11
    for extra in range(1, 6):
        for _ in range(4):
            rows.append((rows[-1][0] + 1, base, extra))
            base += 1 << extra
    return [*rows, (285, 258, 0)]


def distance_codes() -> list[tuple[int, int, int]]:
    """(code, base, extra bits): two codes for each number of extra bits from the third pair on."""
    rows, base = [], 1
    for code in range(30):
        extra = max(0, code // 2 - 1)
        rows.append((code, base, extra))
        base += 1 << extra
    return rows


def level_chains() -> list[tuple[int, int]]:
    """(level, candidates looked at): doubling from 4."""
    return [(level, 2 ** (level + 1)) for level in range(1, 10)]


#: Presets with level, filter strategy, alpha cleanup, color reduction, repeated passes.
PRESETS = (
    ("fast", 2, "minsum", False, False, False),
    ("balanced", 6, "adaptive", True, True, False),
    ("max", 9, "minsum", True, True, True),
    ("lossy", 9, "minsum", True, False, True),
    ("builder_fast", 2, "adaptive_fast", False, False, False),
)
#: Bit depths that a color type may have.
BIT_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 6: (8, 16)}


def codes_table(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """(code, base, extra, last): last is the largest value that the code's extra bits reach."""
    return spark.createDataFrame([(c, b, e, b + (1 << e) - 1) for c, b, e in rows], "code int, base int, extra int, last int")


def dim_length_code(spark: SparkSession) -> DataFrame:
    return codes_table(spark, length_codes())


def dim_distance_code(spark: SparkSession) -> DataFrame:
    return codes_table(spark, distance_codes())


def dim_level(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(level_chains(), "level int, max_chain int")


def dim_preset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, level int, strategy string, optimize_alpha boolean, reduce_color boolean, optimal boolean")
