import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesselq.llm.quality import BUCKETS, Tokens, gumbel, kth_largest, models, resample, weighed

DOCS = "doc_id long, text string, kept int, wanted string, log_weight double"


@pytest.fixture(scope="module")
def data(spark):
    good = ["the cat sat on the mat and slept well", "a dog ran over the green hill today", "we went home when it was late"]
    bad = ["spam### buy%%% now&&& it*** is$$$ cheap###", "WIN!! WIN!! WIN!! NOW!! NOW!! FREE!!"]
    rows = [(i, good[i % 3] + f" {i}", 1, "w", 0.0) if i % 5 else (i, bad[i % 2] + f" {i}", 1, "w", 0.0) for i in range(200)]
    rows += [(None, "the cat sat", 1, "w", 0.0), (900, None, 1, "w", 0.0), (901, "", 1, "w", 0.0), (1, good[1] + " 1", 1, "w", 0.0), (902, "long text here " * 20_000, 1, "w", 0.0)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (7, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def shape_of(token):
    raw = token.encode()
    if re.fullmatch("[0-9]+", token):
        return 3
    if re.fullmatch("[A-Za-z]+", token):
        return 0 if token == token.lower() else 2 if token == token.upper() and len(token) > 1 else 1 if token[0].isupper() else 4
    if raw[0] >= 128:
        letters = [c for c in token if c.isascii() and c.isalpha()]
        if letters and all(c.islower() for c in letters):
            return 0
        return 2 if letters and all(c.isupper() for c in letters) else 0
    return 4 if token[0].isalnum() else 6 + xxhash.xxh3_64_intdigest(raw) % 58


def by_hand(text):
    """Buckets of words, pairs of words, and runs of two and three shapes, one n-gram at a time."""
    tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", text, re.ASCII)
    word = [xxhash.xxh3_64_intdigest(t.encode(), 1) % 2**40 for t in tokens]
    shape = [5 if i and tokens[i] == tokens[i - 1] else shape_of(t) for i, t in enumerate(tokens)]
    out = [w % 10_000 for w in word]
    out += [10_000 + (a * 1_000_003 + b) % (2**31 - 1) % 10_000 for a, b in zip(word, word[1:], strict=False)]
    out += [20_000 + (a * 64 + b + 77_777) * 2_654_435_761 % 1_000_003 % 10_000 for a, b in zip(shape, shape[1:], strict=False)]
    out += [30_000 + (a * 4096 + b * 64 + c + 999_331) * 2_654_435_761 % 1_000_003 % 10_000 for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)]
    return out


@pytest.mark.parametrize("text", ["", "one", "Two WORDS two words words 12 12 a1b!!", "I é éA ÉA naïve 日本 - - ... x_y", "a  b\tc\n"])
def test_grams_by_hand(text):
    assert sorted(Tokens().grams(text).tolist()) == sorted(by_hand(text))


def test_weights_against_brute_force(spark, data):
    docs, labels, rows = data
    got = resample(docs, labels)
    assert sorted(got.columns) == sorted(["doc_id", "text", "kept", "wanted", "log_weight", "sample_key"])
    got = got.collect()
    grams = by_hand
    wanted = {r.doc_id for r in labels.where("quality = 1 AND doc_id IS NOT NULL").collect()}
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for i, t, *_ in rows:
        n = np.bincount(grams(t or ""), minlength=BUCKETS)
        raw += n
        target += n if i in wanted else 0
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in got:
        assert r.log_weight == pytest.approx(w[grams(r.text or "")].sum(), abs=1e-6)
    share = labels.agg(F.avg("quality")).first()[0]
    k = round(len(rows) * min(1, share + 0.01))
    keys = sorted((r.sample_key for r in got), reverse=True)
    assert {r.kept for r in got} == {True, False}
    assert all(r.kept == (r.sample_key >= keys[k - 1]) for r in got)
    marked = {True: [], False: []}
    for r in got:
        if r.doc_id is not None and r.doc_id < 200:
            marked[r.doc_id % 5 != 0].append(r.kept)
    assert sum(marked[True]) >= 0.95 * len(marked[True]) and sum(marked[False]) <= k - sum(marked[True])


def test_noise_is_gumbel(spark):
    x = np.array([r.g for r in spark.range(20_000).select(gumbel(F.col("id"), F.lit("t"), 3).alias("g")).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - np.pi**2 / 6) < 0.1


@pytest.mark.parametrize("values", [[1.0 + i * 2.0**-52 for i in range(40)] * 2, [float(i) * 5e-324 for i in range(30)], [1.0], [3.0] * 50, list(np.random.default_rng(1).normal(0, 1e6, 500)) + [1e-9, 2e-9, 3e-9] * 5, [-1e300, 0.0, 1e300]])
def test_kth_largest(spark, values):
    keys = spark.createDataFrame([(float(v),) for v in values], "key double")
    ordered = sorted(map(float, values), reverse=True)
    for k in sorted({1, 2, len(values) // 2, len(values)} - {0}):
        if k <= len(values):
            assert kth_largest(keys, k) == ordered[k - 1]
    assert kth_largest(keys, 0) is None


def test_no_labels_and_empty_table(spark, data):
    docs, labels, rows = data
    none = spark.createDataFrame([], labels.schema)
    assert resample(docs, none).where("kept AND log_weight = 0").count() == len(rows)
    assert resample(spark.createDataFrame([], DOCS), labels).count() == 0
    assert models(docs, none)[1] == 1.0


def test_columns_of_added_names_are_replaced(spark, data):
    docs, labels, rows = data
    odd = docs.withColumnRenamed("kept", "KEPT").withColumnRenamed("wanted", "key")
    got = resample(odd, labels)
    assert got.columns == ["doc_id", "text", "key", "log_weight", "sample_key", "kept"] and {r.key for r in got.collect()} == {"w"}
    assert weighed(docs, labels, ["doc_id"]).columns == ["doc_id", "log_weight", "sample_key", "kept"]
