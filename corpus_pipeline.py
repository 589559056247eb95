"""From raw documents to packed training sequences: quality, exact and near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselq.llm import dedup, jaccard, mixing, packing, quality
from tesselq.llm.common import written
from tesselq.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps; the target is text labelled good.

    Null or empty text: weight 1, so it stays unless its noise is among the lowest. Null doc_id: not labelled. Repeated
    rows and rows that tie with the last one kept: stay or go together. No labels: all stay. Empty table: no rows. All
    columns are kept, whatever their names.
    """
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return quality.weighed(whole, table(spark, sf_dir, "labels"), ["row"]).where("kept").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id.

    Null text: equal to the empty one. Null doc_id: stays only where no equal text has an id. Repeated rows: one stays.
    Empty table: no rows. All columns are kept, whatever their names.
    """
    return dedup.without_duplicates(docs, "smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.75 connect, on sets of five-word shingles, the one with the smallest doc_id.

    Null or empty text: linked with nothing, so it stays. Null doc_id: stays only where its component has no id. Rows of
    one doc_id and text: one stays. Empty table: no rows. All columns are kept, whatever their names.
    """
    return jaccard.without_similar(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; sources smaller than the largest repeat, twice at most.

    Null source: a source of its own. Null or empty text: one token. Null doc_id: as any other. Repeated rows: mixed
    alike. Empty table: no rows. All columns are kept, whatever their names.
    """
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    return mixing.mix(whole, entropy=0.97, repeats=2.0).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 4096 tokens; workers have done much by now, so that
    they remember less of the tokenizer's work than they might.

    Null or empty text: the end id alone. Null doc_id: as any other. Repeated rows: packed each. Empty table: no rows.
    Other columns are not read.
    """
    return packing.pack(docs, tokenizer_path(), 4096, 1, chunks=200_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tokenizer or the fitted models; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
