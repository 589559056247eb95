import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselq.llm.fingerprints import CELLS, HELD_CHARS, compare_fingerprints, compare_versions, differences, fingerprint_edits, fingerprints, keys_of, sketched

DOCS = "doc_id long, text string, range double, extra int, order string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 2**63)), st.sets(st.integers(1, 2**63)), st.sets(st.integers(1, 2**63))), max_size=8))
def test_differences_are_recovered(cases):
    old = [np.array(sorted(c | a), np.uint64) for a, b, c in cases]
    new = [np.array(sorted(c | b), np.uint64) for a, b, c in cases]
    for (x, y), o, n in zip(differences(old, new), old, new, strict=True):
        assert sorted(x.tolist()) == sorted(set(o.tolist()) - set(n.tolist()))
        assert sorted(y.tolist()) == sorted(set(n.tolist()) - set(o.tolist()))


def test_large_differences_retry():
    a, b = np.arange(1, 3000, dtype=np.uint64), np.arange(2500, 9000, dtype=np.uint64)
    ((x, y),) = differences([a], [b])
    assert len(x) == 2499 and len(y) == 6000


def test_equal_digests_end_too():
    twice = np.array([5, 5, 9], np.uint64)
    ((x, y),) = differences([twice], [np.array([9], np.uint64)])
    assert x.tolist() == [5] and y.tolist() == []


def test_stored_fingerprints_tell_what_differs():
    old = ["a. b. c. d. e.", "same", "", " ".join(f"p{i}." for i in range(500))]
    new = ["a. x. c. d. e.", "same", "new", " ".join(f"q{i}." for i in range(500))]
    stored = [fingerprints(t, k, sketched(k, CELLS)) for t in (old, new) for k in [[keys_of(x) for x in t]]]
    found = compare_fingerprints(*stored)
    for i in range(3):
        a, b = set(keys_of(old[i]).tolist()), set(keys_of(new[i]).tolist())
        assert (set(found[i][0].tolist()), set(found[i][1].tolist())) == (a - b, b - a)
    assert found[3] is None


def paragraphs(text):
    out, start = [], 0
    for i, c in enumerate(text):
        if c == "\n" or c.isspace() and i and text[i - 1] in ".!?,;:|":
            out.append(text[start:i])
            start = i + 1
    return [p for p in [*out, text[start:]] if p.strip()]


def test_long_texts_and_many_rows_of_one_id(spark):
    rows = [(1, "row. " * (1 + i % 5), 1.0, 1, "o") for i in range(900)] + [(2, "y. " * (HELD_CHARS // 3 + 1), 1.0, 1, "o")]
    assert fingerprint_edits(spark.createDataFrame(rows, DOCS)).count() == 901


def test_edits_against_brute_force(spark):
    texts = ["One. Two. Three.\nFour.", "", None, "é" * 7, "same line\n" * 5, "same line\n" * 5, "a,b. c", "x" * 70_001]
    rows = [(10 * i + 3, t, 1.0, 1, "o") for i, t in enumerate(texts)] + [(None, "null id. yes", 1.0, 1, "o")]
    got = fingerprint_edits(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, (doc_id, t, *_) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        r = by_id[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (nxt, r.near_next)):
            a, b = Counter(paragraphs(t)), Counter(paragraphs(other))
            assert near == (2 * (a & b).total() / (a.total() + b.total()) if a or b else 1.0)
    assert by_id[43].fingerprint == by_id[53].fingerprint and by_id[43].near_next == 1
    assert len({r.fingerprint for r in got}) == len({t or "" for _, t, *_ in rows})


def test_one_row_and_none(spark):
    (r,) = fingerprint_edits(spark.createDataFrame([(5, "ab. cd", 1.0, 1, "o")], DOCS)).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"ab.ab.").hexdigest()
    assert fingerprint_edits(spark.createDataFrame([], DOCS)).count() == 0


def test_versions_name_what_differs(spark):
    rows = [(1, "a. b. c.", "a. c. d."), (2, None, None)]
    one, two = sorted(compare_versions(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect())
    assert one.removed == keys_of("b.").view(np.int64).tolist() and one.added == keys_of("d.").view(np.int64).tolist()
    assert one.likeness == 4 / 6 and two.likeness == 1 and two.removed == []
