import os

import numpy as np

from tesselq.llm.common import WordHashes, ngram_hashes, tidy, written


def test_written_tables_and_tidy(spark):
    df = written(spark.range(5), "some")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 5 and os.path.isdir(path)
    tidy(spark)
    assert not os.path.exists(path)


def test_word_hashes_are_bounded_and_stable():
    words = [str(i % 50).encode() for i in range(500)]
    assert (WordHashes(most=10).of(words) == WordHashes().of(words)).all()
    h = WordHashes().of(b"a b c d e f a b c d e".split())
    n = ngram_hashes(h, 5)
    assert len(n) == 7 and n[0] == n[6] and len(np.unique(n)) == 6
    assert len(ngram_hashes(h[:3], 5)) == 1 and len(ngram_hashes(h[:0], 5)) == 0
    assert ngram_hashes(h[:3], 5)[0] != ngram_hashes(h[:3], 2)[0]
