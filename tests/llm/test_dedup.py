import hashlib
from collections import Counter, defaultdict

import pytest

from tesselq.llm.dedup import exact_duplicates, without_duplicates

DOCS = "doc_id long, text string, sha string, home int, kept string"


def rows():
    texts = ["a", "b", "a", "", None, "x" * 50_000, "a", "c", "a "] + ["hot"] * 200 + [f"t{i % 37}" for i in range(120)]
    return [(7 * i % 1009, t, "s", 1, "k") for i, t in enumerate(texts)] + [(None, "a", "s", 1, "k"), (None, "only null", "s", 1, "k"), (0, "a", "s", 1, "k")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, keep):
    data = rows()
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[t or ""].append(i)
    got = exact_duplicates(spark.createDataFrame(data, DOCS).repartition(13), keep).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    kept = Counter()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        ids = groups[by_sha[r.text_sha256]]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] += 1
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    left = without_duplicates(spark.createDataFrame(data, DOCS), keep)
    assert left.columns == ["doc_id", "text", "sha", "home", "kept"]
    assert Counter(r.text or "" for r in left.collect()) == Counter(groups.keys())


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, f"t{i % 4}" if i else None, f"k{i}", i, "r", str(i)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _sha int, row string, KEPT string")
    got = without_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.where("doc_id > 0").collect()) == [rows[i] for i in (1, 2, 3, 4)]


def test_runs_are_merged_as_a_stream():
    import pyarrow as pa

    from tesselq.llm.dedup import RUN_ARROW, _merge

    entries = sorted((h, hashlib.sha256(str(k).encode()).digest(), 1, k, True, i, i, 1) for h in range(3) for k in range(40) for i in range(1 + (h * k) % 7))
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), RUN_ARROW, strict=True)], schema=RUN_ARROW)
    for size in (1, 3, 1000):
        got = pa.Table.from_batches([*_merge(iter(table.to_batches(size)))]).to_pylist()
        assert [(r["home"], r["second"], r["keep_id"], r["members"]) for r in got] == [(h, k, 0, 1 + (h * k) % 7) for h, _, _, k in dict.fromkeys(e[:4] for e in entries)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_duplicates(empty).count() == 0
    assert without_duplicates(empty).count() == 0
