"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, rows_of, text_of, written

#: Buckets of each kind of n-gram: words, pairs of words, runs of two shapes, runs of three.
EACH = 10_000
BUCKETS = 4 * EACH
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
ADDED = ("log_weight", "sample_key", "kept")
#: Shapes of tokens; a token that repeats the one before it has shape SAME.
LOWER, TITLE, UPPER, DIGITS, MIXED, SAME, MARKS = 0, 1, 2, 3, 4, 5, 6


class Tokens(dict):
    """Word bucket and shape of a token, packed in one number; bounded."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        if token.isdigit():
            shape = DIGITS
        elif token.isalpha() or token[0] >= 128:
            shape = LOWER if token.islower() else UPPER if token.isupper() and len(token) > 1 else TITLE if token[:1].isupper() else LOWER if token[0] >= 128 else MIXED
        elif token[0] < 128 and not token[:1].isalnum():
            shape = MARKS + xxhash.xxh3_64_intdigest(token) % 58
        else:
            shape = MIXED
        x = self[token] = (xxhash.xxh3_64_intdigest(token, 1) % (1 << 40)) << 8 | shape
        return x

    def grams(self, text: str) -> np.ndarray:
        """Buckets of the tokens, of pairs of tokens, and of runs of two and three shapes."""
        tokens = TOKEN.findall(text.encode())
        x = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if not len(x):
            return x
        shape = x & 255
        word = x >> 8
        shape[1:][(x[1:] == x[:-1])] = SAME
        pairs = (word[:-1] * 1_000_003 + word[1:]) % 2_147_483_647 % EACH
        two = (shape[:-1] * 64 + shape[1:] + 77_777) * 2_654_435_761 % 1_000_003 % EACH
        three = ((shape[:-2] * 64 + shape[1:-1]) * 64 + shape[2:] + 999_331) * 2_654_435_761 % 1_000_003 % EACH
        return np.concatenate([word % EACH, pairs + EACH, two + 2 * EACH, three + 3 * EACH])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh()
    tokens, raw, target = Tokens(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for wanted, text in rows_of(b):
            n = np.bincount(tokens.grams(text), minlength=BUCKETS)
            raw += n
            if wanted:
                target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], ["bucket", "raw", "target"])


def models(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> tuple[np.ndarray, float]:
    """log(p_target / p_raw) of each bucket, and the share of good documents among the labelled.

    The raw model counts all documents; the target model those of at most most_labelled documents labelled good
    (the least hashes), whose ids are broadcast.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).distinct()
    picked = F.broadcast(good.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(most_labelled).withColumn("wanted", F.lit(True)))
    share = labels.where(F.col("quality").isNotNull()).agg(F.avg(F.col("quality").cast("double")).alias("s")).first().s
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(picked, "id", "left")
    counted = text_of(rows, F.coalesce("wanted", F.lit(False)).alias("wanted")).mapInArrow(_count, "bucket int, raw long, target long")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == BUCKETS:  # no labelled document: nothing to tell them apart by
        target = raw
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), 1.0 if share is None else share


def log_weight(ratios: np.ndarray, text: Column) -> Column:
    """A column of a text's log importance weight, the sum of its n-grams' log ratios."""
    packed = ratios.astype("<f8").tobytes()

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fresh()
        w, tokens = np.frombuffer(packed, "<f8"), Tokens()
        for texts in batches:
            yield pa.array([float(w[tokens.grams(t or "")].sum()) for t in texts.to_pylist()], pa.float64())

    return of(text)


def gumbel(doc_id: Column, text: Column, seed: int) -> Column:
    """Gumbel noise fixed by seed, id and text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of keys(key double, no nulls): each round counts 4096 ranges of what is left, all distributed.

    Where a range is too narrow for that, it has some thousands of different doubles at most, which are counted each.
    """
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k <= 0 or n == 0:
        return None
    if k >= n:
        return lo
    while lo < hi:
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        # halves, as the difference of two doubles can be too large for one
        width = hi / 4096 - lo / 4096
        fine = width <= 4 * math.ulp(max(abs(lo), abs(hi)))
        at = F.col("key") if fine else F.least(F.lit(4095), F.floor((F.col("key") / 2 - lo / 2) / (width / 2))).cast("int")
        for _, count, least, most in inside.groupBy(at.alias("at")).agg(F.count("*"), F.min("key"), F.max("key")).orderBy(F.desc("at")).collect():
            if count >= k:
                lo, hi = least, most
                break
            k -= count
    return lo


def weighed(docs: DataFrame, labels: DataFrame, keep: list[str], share: float | None = None, margin: float = 0.01, seed: int = 11) -> DataFrame:
    """As resample, but with the columns `keep` of docs alone; its texts are read twice, for the models and for the weights."""
    ratios, good = models(docs, labels)
    text = F.coalesce("text", F.lit(""))
    noise = gumbel(F.col("doc_id").cast("long"), text, seed)
    keep = [c for c in keep if c.lower() not in ADDED]
    rows = docs.select(*keep, log_weight(ratios, text).alias("log_weight"), noise.alias("sample_key"))
    rows = written(rows.withColumn("sample_key", F.col("log_weight") + F.col("sample_key")), "weighed")
    limit = kth_largest(rows.select(F.col("sample_key").alias("key")), round(rows.count() * min(1.0, good + margin if share is None else share)))
    return rows.withColumn("kept", F.col("sample_key") >= F.lit(limit) if limit is not None else F.lit(False))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, margin: float = 0.01, seed: int = 11) -> DataFrame:
    """docs with the columns log_weight, sample_key and kept added (replacing such columns, in any case).

    A document's weight is the ratio of its probability under a hashed n-gram model of the target text (labelled good)
    to that under one of all text. Sampling without replacement by these weights is the top k of log weight + Gumbel
    noise, k being `share` of the documents, by default the share of good ones among the labelled and `margin` more, since
    very short texts weigh little either way. Documents that tie with the k-th stay. n-grams are the tokens, pairs of
    tokens, and runs of two and three token shapes (case, digits, marks, repeats).

    Null text: empty, weight 1. Null doc_id or label: not labelled. Repeated rows: the same key, so they stay or go
    together. Empty table: no rows. Labels without a good document: all weights are 1. Other columns stay.
    """
    return weighed(docs, labels, docs.columns, share, margin, seed)
