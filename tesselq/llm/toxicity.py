"""Toxic text by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS_ONLY, rows_of, text_of, written

#: Buckets of words and of their beginnings; the last 64 are those of a text's size.
BUCKETS = 1 << 18
SIZES = 64
BEGINNINGS = (3, 4, 5, 6, 7)
#: Penalties of the weights to choose from, and the rounds that the least of them needs to settle.
DECAYS = (1e-3, 1e-4, 1e-5)
ROUNDS = 1500
INNER_FOLDS = 4


def word_buckets(word: bytes) -> list[int]:
    """Of the word and of its first 3 to 7 characters, where it has more."""
    text = word.decode("utf-8", "replace")
    parts = {b"w" + word, *(b"p" + text[:k].encode() for k in BEGINNINGS if len(text) > k)}
    return [xxhash.xxh3_64_intdigest(p) % (BUCKETS - SIZES) for p in parts]


def distinct_words(text: str) -> set[bytes]:
    return set(text.encode().translate(WORDS_ONLY).split())


def size_bucket(words: Collection[bytes]) -> int:
    return BUCKETS - SIZES + len(words).bit_length()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets, one for each distinct word and beginning, as 32-bit numbers, and how many each word has."""
    for b in batches:
        found, sizes = [], []
        for *_, text in rows_of(b):
            words = sorted(distinct_words(text))
            each = [word_buckets(w) for w in words]
            found.append(np.array([x for w in each for x in w] + [size_bucket(words)], "<u4").tobytes())
            sizes.append(bytes(map(len, each)))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary()), pa.array(sizes, pa.binary())], ["kind", "inner", "chance", "features", "sizes"])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3, least_z: float = 7.0) -> np.ndarray:
    """Weights of a linear classifier, the bias last, by the non-negative risk with logistic loss.

    Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the second part is negative, the step goes up it.
    Features whose shares among positive and unlabelled texts differ by less than least_z standard errors have weight 0.
    """
    if not positive or not unlabelled:
        return np.append(np.zeros(BUCKETS), 9.0 if positive else -9.0)
    n_p, n_u = len(positive), len(unlabelled)

    def texts_with(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for r in rows:
            out[np.unique(r)] += 1
        return out

    in_p, in_u = texts_with(positive), texts_with(unlabelled)
    pool = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(pool * (1 - pool), 1e-9) * (1 / n_p + 1 / n_u))
    used = np.flatnonzero((np.abs(z) >= least_z) & (in_p + in_u >= 5))
    k = len(used)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(k)
    rows = positive + unlabelled
    column, owner = place[np.concatenate(rows)], np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cells, value = np.unique(owner[column >= 0] * max(k, 1) + column[column >= 0], return_counts=True)
    owner, column = np.divmod(cells, max(k, 1))
    is_p = np.arange(len(rows)) < n_p
    w, b, m, v = np.zeros(k), np.log(prior / (1 - prior)), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column] * value, len(rows)) + b, -30, 30)))
        minus = -np.log1p(-np.minimum(s, 1 - 1e-12))
        rest = minus[~is_p].mean() - prior * minus[is_p].mean()
        g = np.where(is_p, -prior * s / n_p, s / n_u)  # of the second part
        g = g + np.where(is_p, -prior * (1 - s) / n_p, 0) if rest >= 0 else -g
        grad = np.append(np.bincount(column, g[owner] * value, k) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = w, b
    return out


def by_one_word(weights: np.ndarray, features: np.ndarray, sizes: bytes) -> float:
    """The log odds of a text that is this one's most toxic word alone."""
    if not sizes:
        return float(weights[-1])
    starts = np.cumsum([0, *sizes[:-1]])
    return float(np.add.reduceat(weights[features[:-1]], starts).max() + weights[size_bucket([b""])] + weights[-1])


def fit_chosen(toxic: list[tuple], plain: list[tuple], clean: list[tuple], prior: float) -> np.ndarray:
    """fit with the decay of DECAYS that does best on the inner fold, the largest of equals; rows are inner, features, sizes.

    What counts is the share of toxic texts whose most toxic word alone is found, less the share of texts labelled clean
    that are taken for toxic. Without either, the largest decay is used.
    """
    inner = [r for r in toxic if r[0]]
    outer = [[f for i, f, _ in rows if not i] for rows in (toxic, plain)]

    def merit(decay: float) -> float:
        w = fit(*outer, prior, ROUNDS, decay=decay)
        found = np.mean([by_one_word(w, f, sizes) >= 0 for _, f, sizes in inner])
        return found - np.mean([w[f].sum() + w[-1] >= 0 for _, f, _ in clean])

    decay = max(DECAYS, key=merit) if inner and clean and all(outer) else DECAYS[0]
    return fit([f for _, f, _ in toxic], [f for _, f, _ in plain], prior, ROUNDS, decay=decay)


def learn(docs: DataFrame, labels: DataFrame, training: Column, most_positive: int = 3000, most_unlabelled: int = 9000, most_clean: int = 1000, most_features: int = 8_000_000) -> np.ndarray:
    """Weights from at most so many confirmed toxic documents and so many unlabelled ones, those of the least hashes.
    The decay is chosen on an inner fold, with at most most_clean of its documents labelled clean. Each of the three
    kinds has at most most_features features in all, so that what the driver gathers is bounded whatever the texts' length:
    the documents of a kind are taken in the order of their hashes as long as their features fit.

    The class prior is the share of toxic ones among the training labels. training: a condition on doc_id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(training & F.col("toxic").isNotNull())
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("s")).first().s
    prior = min(0.9, max(0.001, share or 0.001))
    chance = F.xxhash64(F.lit(9), "doc_id")
    toxic = known.where(F.col("toxic") == 1).select("doc_id").distinct().orderBy(chance, "doc_id").limit(most_positive)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(training)
    plain = rows.select("doc_id").distinct().orderBy(chance, "doc_id").limit(most_unlabelled)
    inner = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(INNER_FOLDS)) == 0
    clean = known.where((F.col("toxic") == 0) & inner).select("doc_id").distinct().orderBy(chance, "doc_id").limit(most_clean)
    # at most most_positive + most_unlabelled + most_clean ids
    picked = F.broadcast(toxic.select("doc_id", F.lit(1).alias("kind")).union(plain.select("doc_id", F.lit(0))).union(clean.select("doc_id", F.lit(2))))
    sampled = text_of(rows.join(picked, "doc_id"), "kind", inner.alias("inner"), chance.alias("chance"))
    sampled = written(sampled.mapInArrow(_features, "kind int, inner boolean, chance long, features binary, sizes binary"), "sample")
    # three numbers for each sampled document
    fits = F.lit(False)
    sizes = sorted(map(tuple, sampled.select("kind", "chance", (F.octet_length("features") / 4).cast("long").alias("n")).collect()))
    for kind in range(3):
        own = np.array([x[1:] for x in sizes if x[0] == kind], np.int64).reshape(-1, 2)
        if n := int(np.searchsorted(np.cumsum(own[:, 1]), most_features, side="right")):
            fits = fits | ((F.col("kind") == kind) & (F.col("chance") <= int(own[n - 1, 0])))
    found = sampled.where(fits).collect()
    parts: list[list[tuple]] = [[], [], []]
    for r in sorted(found, key=lambda r: (r.kind, r.features)):
        parts[r.kind].append((r.inner, np.frombuffer(r.features, "<u4").astype(np.int64), bytes(r.sizes)))
    plain_rows, toxic_rows, clean_rows = parts
    return fit_chosen(toxic_rows, plain_rows, clean_rows, prior)


class WordScores(dict):
    """Sums of the weights of words' buckets; bounded."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 400_000:
            self.clear()
        x = self[word] = sum(self.weights.get(b, 0.0) for b in word_buckets(word))
        return x


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of docs(doc_id, text) by the weights."""
    used = np.flatnonzero(weights[:-1])
    packed, bias = {int(i): float(weights[i]) for i in used}, float(weights[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(packed)
        for batch in batches:
            z = []
            for _, text in rows_of(batch):
                words = distinct_words(text)
                z.append(math.fsum(map(known.__getitem__, words)) + packed.get(size_bucket(words), 0.0) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, score, predicted.

    Learns from documents whose fold is not 0 alone; its features are the words of a text, their beginnings and their number. The fit is on a bounded
    sample (see learn); everything is scored.

    Null text: empty, scored by the bias alone. Null doc_id: held out. Repeated rows: one score each. No toxic labels:
    all scores near 0. Empty table: no rows. Other columns are not read.
    """
    weights = learn(docs, labels, fold(F.col("doc_id"), folds) != 0)
    return score(docs, weights).select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
