import math
from collections import Counter, defaultdict

import pytest

from tesselq.llm.mixing import find_exponent, mix, totals

DOCS = "doc_id long, text string, source string, block int, weight string"


def made():
    rows = []
    for s, n in (("big", 300), ("mid", 60), ("small", 12), (None, 5)):
        rows += [(len(rows) + i, " ".join(["w"] * (1 + (i * 7) % 23)), s, 1, "w") for i in range(n)]
    return [*rows, (None, "null id", "mid", 1, "w"), (5000, None, "small", 1, "w"), (5001, "", "big", 1, "w"), (0, "w", "big", 1, "w"), (0, "w", "big", 1, "w")]


def tokens(t):
    return max(1, len((t or "").split()))


@pytest.mark.parametrize("entropy,repeats,budget", [(0.97, 2.0, None), (0.6, 50.0, None), (0.9, 8.0, 3000), (0.9, 8.0, 400)])
def test_against_brute_force(spark, entropy, repeats, budget):
    rows = made()
    got = mix(spark.createDataFrame(rows, DOCS).repartition(5), entropy, repeats, budget).collect()
    total = Counter()
    for _, t, s, *_ in rows:
        total[s] += tokens(t)
    all_tokens = sum(total.values())
    floor = max(0.0, 1 - math.log(repeats) / math.log(max(total.values()) / min(total.values())))

    def weights(a):
        z = sum((n / all_tokens) ** a for n in total.values())
        return {s: (n / all_tokens) ** a / z for s, n in total.items()}

    def h(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    lo, hi = floor, 1.0
    if h(floor) < entropy * math.log(len(total)):
        a = floor
    elif h(1.0) >= entropy * math.log(len(total)):
        a = 1.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(total)) else (lo, mid)
        a = lo
    want = weights(a)
    big = max(total, key=total.get)
    size = budget if budget is not None else total[big] / want[big]
    by_source = defaultdict(list)
    for r in got:
        assert r.weight == pytest.approx(want[r.source], rel=1e-5)
        by_source[r.source].append(r)
    for s, n in total.items():
        epochs = want[s] * size / n
        own = by_source[s]
        whole = math.floor(epochs + 1e-6)
        documents = sum(1 for r in rows if r[2] == s)
        blocks = Counter(r.block for r in own)
        assert all(blocks[b] == documents for b in range(whole))
        rest = (epochs - whole) * n
        spent = sum(tokens(r.text) for r in own if r.block == whole)
        longest = 2 * 23 + 2
        assert set(blocks) <= set(range(whole + 1)) and (spent == 0 if rest < 0.5 else rest - 2 <= spent <= rest + longest)
        if budget is None:
            assert whole >= 1 and epochs <= repeats + 1e-6
        for b in blocks:  # the order of a block is a permutation of its own
            assert len({(r.perm_key, r.doc_id, r.text) for r in own if r.block == b}) <= blocks[b]
    if budget is None:
        assert {(r.doc_id, r.text) for r in got} == {(i, t) for i, t, *_ in rows}


@pytest.mark.parametrize("most", [3, 20])
def test_many_sources_meet_by_shuffling(spark, most):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 40 if i % 3 else 0}", 1, "w") for i in range(600)] + [(i, "v", None, 1, "w") for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "text", "source", "block", "perm_key").collect()), key=str)
    assert key(mix(docs, 0.9, 8.0, most_sources=most)) == key(mix(docs, 0.9, 8.0))


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "w " * (30_000 if i == 3 else i % 7), "a" if i % 4 else "b", 10 + i, "x", i, i, i, i, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _source int, BLOCK string, _of int, _at int, row int, whole int, at int")
    got = mix(docs, 0.9, 8.0)
    assert got.columns == ["doc_id", "text", "source", "_source", "_of", "_at", "row", "whole", "at", "block", "perm_key", "weight", "epochs"]
    assert {(r.doc_id, r._source, r._of, r._at, r.row, r.whole, r["at"]) for r in got.collect()} == {(i, 10 + i, i, i, i, i, i) for i in range(60)}


def test_last_block_is_the_first_of_its_permutation(spark):
    rows = [(i, "w w w", "a" if i < 400 else "b", 1, "w") for i in range(420)]
    got = mix(spark.createDataFrame(rows, DOCS), 0.99, 3.0, 2000).collect()
    assert got and all(r.epochs >= 0 for r in got)


def test_one_source_and_empty_table(spark):
    rows = [(i, "x y", "only", 1, "w") for i in range(9)]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == list(range(9)) and {r.weight for r in got} == {1.0}
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert find_exponent(totals(spark.createDataFrame([], "source string, tokens long")), 0.9, 2.0) == (1.0, 0.0, 0.0)
