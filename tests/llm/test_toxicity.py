import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesselq.llm.toxicity import BUCKETS, fit, learn, score, size_bucket, toxicity, word_buckets

DOCS = "doc_id long, text string, score string, positive int, toxic int"


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = list(r.choice(vocabulary, 40))
        toxic = i % 8 == 0
        if toxic:
            w[3:3] = list(r.choice(["nasty", "vile", "rotten"], 3))
        rows.append((i, " ".join(w), "s", 1, 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    rows += [(None, "nasty vile", "s", 1, 1), (9000, None, "s", 1, 1), (9001, "", "s", 1, 1), (9002, "w1 " * 50_000, "s", 1, 1), (1, rows[1][1], "s", 1, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(data):
    docs, labels, rows = data
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held)
    assert right >= 0.97 * len(held)


def test_no_positive_labels_and_empty_table(spark, data):
    docs, labels, _ = data
    assert toxicity(docs, labels.where("toxic = 0")).where("score > 0.01").count() == 0
    assert toxicity(spark.createDataFrame([], DOCS), labels).count() == 0
    assert toxicity(docs, spark.createDataFrame([], labels.schema)).where("predicted = 1").count() == 0


def test_risk_is_fitted_and_unused_features_are_zero():
    r = np.random.default_rng(0)
    mark = word_buckets(b"bad")[0]
    make = lambda toxic: np.array([*r.integers(0, 500, 20), *([mark] if toxic else []), size_bucket({b"a"})])
    w = fit([make(True) for _ in range(200)], [make(i % 10 == 0) for i in range(800)], 0.1)
    assert len(w) == BUCKETS + 1 and w[mark] > 1 and np.count_nonzero(w[:-1]) < 50


def slow_fit(positive, unlabelled, prior, rounds, rate, decay, least_z):
    """The estimator as its papers state it, on dense rows of counts, one text at a time."""
    names = sorted({f for r in positive + unlabelled for f in r})
    share = lambda f, rows: sum(f in r for r in rows) / len(rows)
    used = []
    for f in names:
        p, u = share(f, positive), share(f, unlabelled)
        pool = (p * len(positive) + u * len(unlabelled)) / (len(positive) + len(unlabelled))
        error = max(pool * (1 - pool), 1e-9) * (1 / len(positive) + 1 / len(unlabelled))
        if abs(p - u) / error**0.5 >= least_z and p * len(positive) + u * len(unlabelled) >= 5 - 1e-9:
            used.append(f)
    dense = lambda rows: [[sum(x == f for x in r) for f in used] + [1] for r in rows]
    xp, xu = dense(positive), dense(unlabelled)
    w = [0.0] * len(used) + [math.log(prior / (1 - prior))]
    m, v = [0.0] * len(w), [0.0] * len(w)

    def odds(x):
        return 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(w, x, strict=True))))))

    for step in range(1, rounds + 1):
        sp, su = [odds(x) for x in xp], [odds(x) for x in xu]
        negative = sum(-math.log(1 - s) for s in su) / len(su) - prior * sum(-math.log(1 - s) for s in sp) / len(sp)
        for k in range(len(w)):
            plus = -prior * sum((1 - s) * x[k] for s, x in zip(sp, xp, strict=True)) / len(sp)
            minus = sum(s * x[k] for s, x in zip(su, xu, strict=True)) / len(su) - prior * sum(s * x[k] for s, x in zip(sp, xp, strict=True)) / len(sp)
            g = (plus + minus if negative >= 0 else -minus) + (decay * w[k] if k < len(used) else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
        w = [a - rate * (b / (1 - 0.9**step)) / (math.sqrt(c / (1 - 0.999**step)) + 1e-8) for a, b, c in zip(w, m, v, strict=True)]
    return dict(zip([*used, BUCKETS], w, strict=True))


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_fit_against_brute_force(prior):
    r = np.random.default_rng(7)
    make = lambda toxic: np.array([*r.integers(0, 30, 6), *([70, 70, 71] if toxic and r.random() < 0.8 else []), *([72] if not toxic and r.random() < 0.6 else [])])
    positive, unlabelled = [make(True) for _ in range(40)], [make(i % 5 == 0) for i in range(90)]
    want = slow_fit([x.tolist() for x in positive], [x.tolist() for x in unlabelled], prior, 60, 0.05, 1e-3, 3.0)
    got = fit(positive, unlabelled, prior, rounds=60, least_z=3.0)
    assert {int(i) for i in np.flatnonzero(got)} <= set(want) and {70, 72, BUCKETS} <= set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-6)


def test_scores_against_brute_force(spark):
    texts = ["Bad WORDS here, bad", "", None, "a-b_c é日本 badly", "bad " * 30_000]
    weights = np.random.default_rng(1).normal(0, 0.2, BUCKETS + 1)
    got = {r.doc_id: r.score for r in score(spark.createDataFrame([(i, t, "s", 1, 1) for i, t in enumerate(texts)], DOCS), weights).collect()}
    for i, t in enumerate(texts):
        words = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        z = weights[BUCKETS] + weights[size_bucket({w.encode() for w in words})]
        for w in words:
            z += sum(weights[xxhash.xxh3_64_intdigest(p) % (BUCKETS - 64)] for p in {b"w" + w.encode(), *(b"p" + w[:k].encode() for k in range(3, 8) if len(w) > k)})
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_sample_is_bounded_in_features(data):
    docs, labels, _ = data
    assert np.count_nonzero(learn(docs, labels, F.col("doc_id") % 5 != 0, most_features=0)[:-1]) == 0
    some, every = (learn(docs, labels, F.col("doc_id") % 5 != 0, most_features=n) for n in (20_000, 8_000_000))
    assert np.count_nonzero(some) and not np.array_equal(some, every)


def test_one_toxic_word_alone_is_found(spark):
    r = np.random.default_rng(5)
    insults, vocabulary = [f"{c}{c}insult" for c in "abcdefgh"], [f"v{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(4800):
        toxic = i % 20 == 0
        rows.append((i, " ".join([*r.choice(vocabulary, 40), *(r.choice(insults, r.integers(1, 5)) if toxic else [])]), "s", 1, 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    rows += [(10_000 + k, w, "s", 1, 1) for k, w in enumerate(insults)]
    got = toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert [x.doc_id for x in got if x.doc_id >= 10_000 and not x.predicted] == []
    clean = [x.predicted for x in got if x.doc_id < 10_000 and x.doc_id % 20]
    assert sum(clean) <= 0.01 * len(clean)
