import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tesselq.llm import lm
from tesselq.llm.lm import CODEBOOK, DISCOUNT, code, score_held_out
from tesselq.llm.queries import op8_lm_scoring

DOCS = "doc_id long, text string, n_tokens int, score string, target int"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def quantised(x):
    return float(CODEBOOK[code(x)])


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["\n", *re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def brute(rows):
    one, two, three = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = words(t)
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    two_kept, three_kept = two, three
    total, types = one.total(), len(one)
    rest2, rest3 = Counter(), Counter()
    for (u, _), c in two_kept.items():
        rest2[u] += (c - DISCOUNT) / one[u]
    for (u, v, _), c in three_kept.items():
        rest3[u, v] += (c - DISCOUNT) / two[u, v]
    out = []
    for i, t in rows:
        w = words(t)
        base = score = 0.0
        for k in range(1, len(w)):
            p = (one[w[k]] + 1) / (total + types + 1)
            base += math.log10(p)
            u = w[k - 1]
            if u in one:
                d = quantised((two_kept[u, w[k]] - DISCOUNT) / one[u]) if (u, w[k]) in two_kept else 0
                p = d + quantised(1 - rest2[u]) * p
                if k > 1 and (w[k - 2], u) in two_kept and (w[k - 2], u) in rest3:
                    c = (w[k - 2], u)
                    d = quantised((three_kept[*c, w[k]] - DISCOUNT) / two[c]) if (*c, w[k]) in three_kept else 0
                    p = d + quantised(1 - rest3[c]) * p
            score += math.log10(min(p, 1))
        out.append((i, held(i), len(w) - 1, sum(x in one for x in w[1:]), total, base, score))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = ["the cat sat on the mat", "The cat sat on\tthe mat again", "", None, "ünï cat the the the the", "a b c d " * 200, "never seen words here", "the dog sat on the cat"]
    data = [(i, texts[i % len(texts)]) for i in range(60)]
    return [*data, (None, "the cat"), (3, "hot " * 5000), (61, "zzz unseen the cat sat"), (62, "only once here")]


def test_against_brute_force(spark, rows):
    got = score_held_out(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS).repartition(5)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows), key=order)
    got = sorted(map(tuple, got), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-6)


def test_empty_and_nothing_to_learn(spark):
    assert score_held_out(spark.createDataFrame([], DOCS)).count() == 0
    only = next(i for i in range(100) if held(i))
    (r,) = score_held_out(spark.createDataFrame([(only, "a b", 1, "s", 2)], DOCS)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0 == r.score


def brute_whole(rows):
    """Scores by all n-grams of the training texts, without quantised numbers."""
    grams = [Counter() for _ in range(3)]
    for i, t in rows:
        if not held(i):
            w = words(t)
            for n, seen in enumerate(grams):
                seen.update(zip(*((w[1:] if n == 0 else w)[k:] for k in range(n + 1)), strict=False))
    one, two, three = grams
    after = {n: Counter(k[:-1] for k in seen) for n, seen in ((2, two), (3, three))}
    out = []
    for i, t in rows:
        w, score = words(t), 0.0
        for k in range(1, len(w)):
            p = (one[w[k],] + 1) / (one.total() + len(one) + 1)
            for n, seen, contexts in ((2, two, one), (3, three, two)):
                context = tuple(w[max(0, k - n + 1) : k])
                if len(context) == n - 1 and after[n][context]:
                    p = max(seen[*context, w[k]] - DISCOUNT, 0) / contexts[context] + DISCOUNT * after[n][context] / contexts[context] * p
            score += math.log10(min(p, 1))
        out.append((i, held(i), len(w) - 1, score))
    return out


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    train = [i for i in range(60) if not held(i)]
    test = next(i for i in range(60) if held(i))
    rows = [(i, f"w{i} x{i} y{i} common word w{i * 7 % 60}") for i in train] + [(test, f"w{train[0]} x{train[0]} y{train[0]} common word"), (None, "x y")]
    spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, is_held, n, score in brute_whole(rows):
        assert (got[i].held_out, got[i].n_tokens) == (is_held, n)
        assert got[i].score == pytest.approx(score, abs=0.02 * n)


def test_dealt_counts_are_summed_on_the_way(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 3)
    keys = [np.unique(np.random.default_rng(i).integers(0, 40, 9)).astype(np.uint64) for i in range(20)]
    batches = [lm.dealt(k, np.full(len(k), 200), (k % 2).astype(np.int64), 2) for k in keys]
    got = {int(x): int(n) for k, c in lm.gathered(iter(batches)).values() for x, n in zip(k, c, strict=True)}
    assert got == Counter({x: n * 200 for x, n in Counter(int(x) for k in keys for x in k).items()})


def test_context_seen_over_1e9_times(tmp_path):
    def given(keys, counts):
        return iter([lm.dealt(np.array(keys, np.uint64), np.array(counts), np.zeros(len(keys), np.int64), 1)])

    n, folder = 3_000_000_000, f"file://{tmp_path}"
    list(lm._save_words(folder)(given([5, 6, 7], [n, 3, 1])))
    model = lm.Model(folder, 1, (0, 3), n + 4)
    (made,) = lm._save_pairs(model)(given([0, 1, 2], [n - 4, 3, 1]))
    model = lm.Model(folder, 1, (0, 3), n + 4, (0, 3), made.column("widest")[0].as_py())
    list(lm._save_triples(model)(given([0, 1, 2], [n - 8, 3, 1])))
    at = np.arange(3)
    place, rank, room, direct, weight = lm.pair_lookup(model, np.zeros(3, np.int64), at, True)
    assert direct == pytest.approx((np.array([n - 4, 3, 1]) - DISCOUNT) / n, rel=1e-3)
    assert weight == pytest.approx(3 * DISCOUNT / n, rel=1e-3)
    direct, weight = lm.triple_lookup(model, np.zeros(3, np.int64), at, np.full(3, 3))
    assert direct == pytest.approx((np.array([n - 8, 3, 1]) - DISCOUNT) / (n - 4), rel=1e-3)
    assert weight == pytest.approx(3 * DISCOUNT / (n - 4), rel=1e-3)


def test_no_count_is_clipped():
    for n in (1, 10**9, 10**13, 2**63 - 1):
        assert quantised(0.25 / n) == pytest.approx(0.25 / n, rel=1e-3)
    seen = np.array([2**62, 7])
    assert lm.left_over(seen, np.array([0, 0]), np.array([2**62 - 1, 1])) == pytest.approx([2 * DISCOUNT / 2**62, 1], rel=1e-12)
