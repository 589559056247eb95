"""Licence notices found by exact seeds and bounded-error verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_ONLY, rows_of, text_of

#: Phrases whose exact places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices searched with errors: label, words, edits allowed.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", 4),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by-sa", "creative commons attribution sharealike", 3),
    ("cc-by", "creative commons attribution 4 0 international", 4),
    ("cc0", "creative commons zero public domain dedication", 4),
    ("gpl", "licensed under the gnu general public license version 3", 5),
    ("gpl", "general public license", 2),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("mpl-2.0", "mozilla public license version 2 0", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    ("reserved", "all rights reserved", 2),
)
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first_word long, last_word long, errors int>>"
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())])))]
)


def pieces(phrase: str, errors: int) -> list[tuple[str, int]]:
    """errors + 1 pieces of the phrase with their offsets: a match with that many edits has one of them unchanged."""
    n = errors + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Looks through normalised text: words joined by single spaces, with one before and one after."""

    def __init__(self, base, notices):
        import ahocorasick
        import regex

        self.base, self.notices = [(f" {p} ".encode(), label) for p, label in base], notices
        self.fuzzy = [regex.compile(b"(?b)(?:" + regex.escape(p.encode()) + b"){e<=%d}" % e) for _, p, e in notices]
        seeds = defaultdict(list)
        for i, (_, p, e) in enumerate(notices):
            for piece, at in pieces(p, e):
                seeds[piece].append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def exact(self, norm: bytes) -> list[tuple[int, str]]:
        """(first word, label) of each place of a base phrase."""
        out = []
        for phrase, label in self.base:
            at = counted = words = 0
            while (at := norm.find(phrase, at)) >= 0:
                words += norm.count(b" ", counted, at)
                counted = at
                out.append((words, label))
                at += 1
        return out

    def verified(self, norm: bytes, i: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, end, errors) of a notice's matches in a window, from word to word; of overlapping ones the best.

        The expression is tried on whole runs of words of a fitting length, as it doesn't try other edits when what
        follows a match doesn't suit.
        """
        _, p, most = self.notices[i]
        blanks = [k for k in range(lo, hi) if norm[k] == 32]
        found = []
        for k, before in enumerate(blanks):
            for after in blanks[k + 1 :]:
                n = after - before - 1
                if n > len(p) + most:
                    break
                if n >= len(p) - most and (m := self.fuzzy[i].fullmatch(norm, before + 1, after)):
                    found.append((sum(m.fuzzy_counts), before + 1, after))
        out, taken = [], bytearray(max(0, hi - lo))
        for errors, a, z in sorted(found):
            if not any(taken[a - lo : z - lo]):
                taken[a - lo : z - lo] = b"\1" * (z - a)
                out.append((a, z, errors))
        return out

    def near(self, norm: bytes) -> list[tuple[str, int, int, int]]:
        """(label, first word, last word, errors) of each notice within its errors."""
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (n, where) in self.seeds.iter(norm.decode("latin-1")):
            for i, at in where:
                _, p, e = self.notices[i]
                start = end - n + 1 - at
                lo, hi = max(0, start - e - 1), start + len(p) + e + 2
                own = windows[i]
                if own and lo <= own[-1][1]:
                    own[-1] = [min(own[-1][0], lo), max(own[-1][1], hi)]
                else:
                    own.append([lo, hi])
        out = []
        for i, own in windows.items():
            own.sort()
            counted = words = 0
            for a, z, errors in sorted(x for lo, hi in own for x in self.verified(norm, i, lo, min(hi, len(norm)))):
                words += norm.count(b" ", counted, a)
                counted = a
                out.append((self.notices[i][0], words - 1, words - 1 + norm.count(b" ", a, z), errors))
        return out


def _scan(base, notices):
    longest = {}
    for label, p, e in notices:
        longest[label] = max(longest.get(label, 0), e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(base, notices)
        for b in batches:
            out = []
            for doc_id, text in rows_of(b):
                words = text.encode().translate(WORDS_ONLY).split()
                norm = b" " + b" ".join(words) + b" "
                exact, near = finder.exact(norm), finder.near(norm)
                labels = {x for _, x in exact}
                score = 1.0 if exact else max((1 - e / (longest[x] + 1) for x, _, _, e in near), default=0.0)
                spans = [{"label": x, "first_word": a, "last_word": z, "errors": e} for x, a, z, e in sorted(near, key=lambda s: (s[1], s[0]))]
                at = [w for w, _ in exact]
                out.append((doc_id, len(words), len(exact), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, *_ in near})), score, spans))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)] if out else [pa.array([], f.type) for f in ARROW], schema=ARROW)

    return run


def find_notices(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row for each row of docs(doc_id, text), with RESULT's columns.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and non-ASCII characters. n_base, first_word and
    last_word are of the places where a base phrase's words stand consecutively. A notice with at most e edits has one
    of its e + 1 pieces unchanged: an automaton finds these in one pass, and a bounded-error regular expression
    verifies the windows around them, which are merged where they overlap. spans: verified notices, from word to word.
    score: 1 with a base phrase, else the best notice's share of unused edits, else 0.

    Null text: empty, so no words and no labels. Null doc_id: kept. Repeated rows: one result each. Empty table: no
    rows. Other columns are not read.
    """
    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_scan(base, notices), RESULT)
