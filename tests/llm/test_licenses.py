import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselq.llm.licenses import BASE, NOTICES, Finder, find_notices, pieces

DOCS = "doc_id long, text string, n_words int, spans string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_places(words):
    return sorted((i, label) for phrase, label in BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)


def test_against_brute_force(spark):
    texts = ["", None, "Released under the MIT License.", "CC  BY, cc-by CC.BY cc by cc by", "All  rights\nRESERVED é all rights reserved", "allrights reserved", "x" * 100_000 + " CC BY", "GNU General Public License general public license"]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(None, "cc by", 1, "s"), (2, texts[2], 1, "s")]
    got = find_notices(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, t, *_) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        w = words_of(t)
        at = base_places(w)
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(w), len(at))
        assert (r.first_word, r.last_word) == (min((a for a, _ in at), default=None), max((a for a, _ in at), default=None))
        base = {x for _, x in at}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert find_notices(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("text,label", [("relaesed under the mit license", "mit"), ("Licensd under the Apache Licence, Version 2.0", "apache-2.0"), ("mozila public license version 2 0", "mpl-2.0")])
def test_damaged_notices(text, label):
    f = Finder(BASE, NOTICES)
    norm = (" " + " ".join(["some", "words", *words_of(text), "after"]) + " ").encode()
    found = [x for x in f.near(norm) if x[0] == label]
    assert found and found[0][1] == 2 and found[0][3] >= 1


def distance_within(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(NOTICES), st.lists(st.tuples(st.integers(0, 80), st.sampled_from(["", "q", "zz"])), max_size=6))
def test_every_notice_within_its_errors_is_found(notice, edits):
    label, phrase, errors = notice
    text = phrase
    for at, new in edits:
        at %= max(1, len(text))
        text = text[:at] + new + text[at + 1 :]
    text = " ".join(text.split())
    if text and distance_within(text, phrase, errors):
        assert label in {x for x, *_ in Finder((), (notice,)).near(f" before {text} after ".encode())}


def test_pieces_cover_the_phrase():
    for _, p, e in NOTICES:
        assert "".join(x for x, _ in pieces(p, e)) == p and len(pieces(p, e)) == e + 1 and min(len(x) for x, _ in pieces(p, e)) >= 5
