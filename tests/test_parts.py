import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselq.functions import labels, sql
from tesselq.operators import deflate, huffman, jobs, matching


def test_new_ids(spark):
    ids = [r.id for r in spark.range(500).select(labels.new_id().alias("id")).collect()]
    assert all(re.fullmatch("[0-9a-z]{7}", i) for i in ids) and len(set(ids)) == 500


@pytest.mark.parametrize("counts, error", [((257, 1, 4), None), ((286, 30, 19), None), ((256, 1, 4), "literal codes"), ((287, 1, 4), "literal codes"), ((257, 0, 4), "distance codes"), ((257, 31, 4), "distance codes"), ((257, 1, 3), "length codes"), ((257, 1, 20), "length codes")])
def test_header_counts(spark, counts, error):
    assert spark.range(1).select(deflate.header_counts_error(*map(F.lit, counts)).alias("e")).first().e == error


def test_a_header_with_too_many_codes_is_an_error():
    with pytest.raises(ValueError):
        deflate.dynamic_header(np.full(287, 9), np.full(30, 5))
    with pytest.raises(ValueError):
        deflate.dynamic_header(np.full(286, 9), np.full(31, 5))


def test_window_slides(spark):
    data = bytes(range(256)) * 200
    window = b""
    for i in range(0, len(data), 700):
        row = spark.range(1).select(matching.window_before(F.lit(bytearray(data)), F.lit(i), 2000).alias("w")).first() if i % 9800 == 0 else None
        assert row is None or bytes(row.w) == window
        window = matching.slid(window, data[i : i + 700], 2000)
    assert window == data[-2000:]
    assert matching.slid(b"abc", b"", 0) == b"" and len(matching.slid(data, data, 10**9)) == 32768


def test_window_match_stays_in_the_window():
    assert matching.window_match(b"abcabcab", b"abcabcabc") == (8, 8)
    assert matching.window_match(b"aaa", b"aaaaaa") == (3, 3)
    assert matching.window_match(b"abcxabc", b"abcd") == (3, 3)
    assert matching.window_match(b"ab", b"ab") == (0, 0) and matching.window_match(b"", b"abc") == (0, 0)


def test_the_smaller_encoding_is_chosen():
    r = np.random.default_rng(1)
    for data in (b"abc" * 50, b"Hello, World!", bytes(r.integers(0, 256, 3000, dtype=np.uint8)), bytes(r.integers(65, 70, 3000, dtype=np.uint8))):
        each = {k: len(deflate.encode(data, 6, k)) for k in ("fixed", "dynamic", "auto", "optimal")}
        assert each["auto"] == min(each["fixed"], each["dynamic"]) and each["optimal"] <= min(each["auto"], len(deflate.stored(data)))


def test_table_function_of_odd_rows(spark):
    sql.register(spark)
    rows = spark.sql("SELECT s.i, t.* FROM VALUES (1, unhex('61616161616161')), (2, unhex('')), (3, CAST(NULL AS BINARY)) s(i, d), LATERAL deflate_tokens(s.d, 6) t").collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, 0, 0, True, 97, None, None), (1, 1, 1, False, None, 1, 6)]


def test_value_in_two_ranges_has_the_first_code(spark):
    codes = spark.createDataFrame([(284, 227, 5, 258), (285, 258, 0, 258)], "code int, base int, extra int, last int")
    values = spark.createDataFrame([(258,), (258,), (1,), (None,)], "v int")
    got = sorted((r.v or 0, r.code, r.extra, r.extra_bits) for r in huffman.coded(values, "v", codes).collect())
    assert got[2:] == [(258, 284, 31, 5)] * 2 and all(x[1] is None for x in got[:2])


def test_states_and_replies(spark):
    rows = [(1, "png", None, None), (2, "png", "broken", None), (3, "png", None, "too large"), (4, "jpeg", "x", None), (5, "unknown", None, None), (6, None, None, None)]
    last = {r.id: (r.seq, r.status) for r in jobs.latest(jobs.transitions(spark.createDataFrame(rows, "id long, kind string, unread string, error string"))).collect()}
    assert last == {1: (3, "done"), 2: (2, "error"), 3: (3, "error"), 4: (2, "error"), 5: (1, "error"), 6: (1, "error")}
    messages = [("a", 1, "compress", "p", None), ("a", 2, "init", None, None), ("a", 3, "compress", "p", None), ("a", 4, "compress", None, None), ("a", 5, "compress", "q", "bad"), ("a", 6, "huh", "q", None), ("b", 1, "compress", "p", None)]
    got = sorted(tuple(r) for r in jobs.replies(spark.createDataFrame(messages, "session string, seq long, type string, id string, failed string")).select("session", "seq", "type", "error").collect())
    assert got == [("a", 1, "error", "not initialized"), ("a", 2, "ready", None), ("a", 3, "compressed", None), ("a", 4, "error", "invalid compress message"), ("a", 5, "error", "bad"), ("b", 1, "error", "not initialized")]
