import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselq.llm.components import connected_components
from tesselq.llm.jaccard import SIGNED, _may_link, _sided, _signed, similar_documents, without_similar

DOCS = "doc_id long, text string, n long, row string, shared int"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def made(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 8, 30, 80]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            w += passage
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = [*made(seed), (None, rows_text := "one two three four five six"), (9001, rows_text), (9002, None), (9003, ""), (9004, "One TWO\tthree\n four five six"), (9005, "solo"), (9006, "solo"), (9008, "solo"), (9007, "long " + "x y z " * 8000)]
    got = similar_documents(spark.createDataFrame([(*r, 1, "r", 2) for r in rows], DOCS).repartition(4))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)
    leads = [r.component_id for r in got.where("leads").collect()]
    assert len(leads) == len(set(leads)) or None in leads
    assert {r.component_id for r in got.collect()} == set(leads)


def test_chain_of_links(spark):
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base)))
        base[i * 2 % 100] = f"new{i}"
    got = similar_documents(spark.createDataFrame([(*r, 1, "r", 2) for r in rows], DOCS))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


@pytest.mark.parametrize("tail", [0, 30])
def test_near_misses_around_one_passage(spark, tail):
    r = random.Random(tail)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = [f"t{i}-{k}" for k in range(r.randrange(tail + 1))] + base
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"e{r.randrange(90)}"
        rows.append((i, " ".join(w)))
    got = similar_documents(spark.createDataFrame([(*x, 1, "r", 2) for x in rows], DOCS).repartition(3))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_signatures_keep_every_link(spark):
    r = random.Random(4)
    sets = []
    for i in range(60):
        some = r.sample(range(300), r.choice([5, 40, 200]))
        sets.append((i, [(x * 0x9E3779B97F4A7C15 + 5) % (1 << 64) - (1 << 63) for x in some]))
    rows = spark.createDataFrame([(i, len(s), s) for i, s in sets], "node long, n long, shared array<long>")
    signed = rows.mapInArrow(_signed, SIGNED)
    kept = {tuple(x) for x in _sided(signed, "a").join(_sided(signed, "b"), _may_link(75, 100)).select("node_a", "node_b").collect()}
    for i, a in sets:
        for j, b in sets:
            common = len({*a} & {*b})
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert (i, j) in kept
    assert len(kept) < 1200


def test_one_document_of_each_component_stays(spark):
    rows = [*made(5, 80), (7000, None), (7001, ""), (None, "a lonely text"), (7002, "again"), (7002, "again"), (7002, "other")]
    rows = [(*x, 1, "r", 2) for x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long, OWN string, component_id int")
    got = without_similar(docs)
    assert got.columns == docs.columns
    least = {x for *_, x in brute([x[:2] for x in rows])}
    assert {x.doc_id for x in got.collect()} == least
    assert {(x.mark, x.OWN, x.component_id) for x in got.collect()} == {(1, "r", 2)}
    assert sum(x.doc_id == 7002 for x in got.collect()) == 2
    assert without_similar(docs.limit(0)).collect() == []


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components(spark, pairs):
    nodes = spark.createDataFrame([(i,) for i in range(41)], "node long")
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = list(range(41))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert {r.node: r.root for r in connected_components(nodes, edges).collect()} == dict(enumerate(root))
