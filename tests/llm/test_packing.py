import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselq.llm.packing import ChunkIds, pack, plan
from tesselq.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, length int, place_length string"


def laid_out(counts, capacity):
    """Every bin's (offset, length) by the plan's rows."""
    places, n = plan(dict(counts), capacity)
    bins = defaultdict(list)
    ranks = defaultdict(int)
    for length, first, each, m, base, offset in places:
        assert first == ranks[length]
        ranks[length] += each * m
        for b in range(m):
            bins[base + b] += [(offset + i * length, length) for i in range(each)]
    assert dict(ranks) == {k: v for k, v in counts.items() if v}
    assert len(bins) == n
    for items in bins.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= capacity
    return n


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 9), max_size=25))
def test_plan_is_gapless_and_near_the_bound(counts):
    n = laid_out(counts, 60)
    total = sum(k * v for k, v in counts.items())
    assert n >= -(-total // 60)
    assert n <= 1.5 * total / 60 + 2 or n <= sum(v for k, v in counts.items() if k > 20) + 1


@given(st.lists(st.integers(21, 60), max_size=9))
@settings(max_examples=100, deadline=None)
def test_large_items_pair_optimally(items):
    counts = defaultdict(int)
    for i in items:
        counts[i] += 1

    def most(rest):
        if len(rest) < 2:
            return 0
        a, *others = rest
        return max([most(others)] + [1 + most(others[:k] + others[k + 1 :]) for k, b in enumerate(others) if a + b <= 60])

    assert laid_out(counts, 60) == len(items) - most(items)


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = ["", None, "a b", "Don't STOP now\n\n\tthe 42 café é İx <|endoftext|>y", "word " * 3000, "x" * 5000, "a b", "a b"]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "null id", 1, "z"), (2, "a b", 1, "z")]
    got = pack(spark.createDataFrame(rows, DOCS), path, 64, 1, keep_ids=True).collect()
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4").tobytes()
            want[i].append((k, at, len(part) // 4, zlib.crc32(part), part))
    have = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64


#: Letters whose case or composition is odd, marks, blanks and special tokens, among plain ones.
PARTS = ["AKADEMİ", "akademi", "İ", "I\u0307", "J\u030c", "j\u030c", "H\u0331", "E\u0301", "É", "ΣΑΣ", "ß", "ŉ", "K", "Å", "ﬁ", "中", "٣", "n", "don't", "'S", "The", "x", "<|endoftext|>", "<|ENDOFTEXT|>",
         "<|", "|>", ".", ",", "!", "?", ":", "\u0307", "\u0301", "\x01", " ", "  ", "\n", "\t", "\r", "\x0b", "\u00a0", "\u3000", "\x85", "9", "_", "\U0001f600"]


def same_ids(texts, most):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    ours = ChunkIds(tokenizer_path(), most)
    for at in range(0, len(texts), 32):
        for text, ids in zip(texts[at : at + 32], ours.of(texts[at : at + 32]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("most", [50, 500_000])
def test_ids_do_not_depend_on_what_is_remembered(most):
    r = random.Random(most)
    same_ids(["".join(r.choice(PARTS) for _ in range(r.randrange(12))) for _ in range(20_000)], most)


@given(st.lists(st.text(max_size=12), max_size=40))
@settings(max_examples=60, deadline=None)
def test_ids_of_any_text(texts):
    same_ids([*texts, *(t + "." for t in texts), *(t.upper() for t in texts)], 10)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_full_length_documents_fill_a_bin(n):
    assert laid_out({60: n}, 60) == n
