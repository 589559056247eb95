import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tesselq.llm.queries import tokenizer_path
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, as rows, each read from the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.collect())]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        if name != "best_fit_packing":
            assert got.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, rows))
    return dict(out)


def test_quality_keeps_good_documents(spark, stages):
    kept = {r.doc_id for r in stages["quality_classifier"]}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_exact_duplicates_by_brute_force(stages):
    least = {}
    for r in stages["quality_classifier"]:
        least[r.text] = min(r.doc_id, least.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in stages["exact_dedup"]) == sorted(least.values())


def test_near_duplicates_by_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages["exact_dedup"]]
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted({c for _, _, c in brute(rows)})


def test_mixing_keeps_all_and_repeats_at_most_twice(stages):
    before, after = Counter(r.doc_id for r in stages["near_dedup"]), Counter(r.doc_id for r in stages["source_mixing"])
    assert set(before) == set(after) and max(after.values()) <= 2


def test_packing_against_the_tokenizer(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    want, have, bins = Counter(), Counter(), defaultdict(list)
    for r in stages["source_mixing"]:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    for r in stages["best_fit_packing"]:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(n for items in bins.values() for _, n in items)
    assert len(bins) <= total / 4096 * 1.05 + 1


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["best_fit_packing"])


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, KEY string, BLOCK int, kept string, _sha string, mark int, log_weight string"


def test_stages_with_odd_rows_and_names(spark, tmp_path):
    words = "the river runs slowly past the old stone mill and the quiet green fields beyond it".split()
    texts = [" ".join(words[i % 5 :] + [f"end{i}"]) for i in range(30)] + [None, "", "long words here " * 20_000, "again", "again", "İ <|endoftext|>"]
    rows = [(i, t, "en", "a" if i % 3 else None, 1, i, f"k{i}", 100 + i, "kept", "sha", i, "w") for i, t in enumerate(texts)]
    rows += [rows[33], (None, "no id at all", "en", "b", 1, 77, "k77", 177, "kept", "sha", 77, "w"), (None, "again", "en", "b", 1, 78, "k78", 178, "kept", "sha", 78, "w")]
    whole = {(r[0], r[1], *r[5:]) for r in rows}
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30, 3)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = first = spark.createDataFrame(rows, ODD).repartition(3)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert got.columns == docs.columns
            docs = spark.createDataFrame(got.collect(), ODD)
            assert {(r.doc_id, r.text, *r[5:]) for r in docs.collect()} <= whole
        counts.append(got.count())
    assert all(counts)
    dedup, near = (stage(spark, first, str(tmp_path)).collect() for _, stage in corpus_pipeline.STAGES[1:3])
    assert Counter(r.text or "" for r in dedup) == Counter({r[1] or "" for r in rows}) and {r.doc_id for r in dedup if r.text == "again"} == {33}
    assert Counter(r.doc_id for r in near if r.doc_id is not None) == Counter({c for *_, c in brute([r[:2] for r in rows]) if c is not None})


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ODD), str(tmp_path)).count() == 0
