import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselq.operators import scanlines as S

IMAGES = "image_id long, width int, height int, color_type int, pixels array<int>"


def predicted(f, a, u, c):
    p = a + u - c
    return [0, a, u, (a + u) // 2, min((abs(p - x), i, x) for i, x in enumerate((a, u, c)))[2]][f]


def residuals(f, row, prev, bpp):
    at = lambda r, i: r[i] if i >= 0 else 0
    return [(v - predicted(f, at(row, i - bpp), prev[i], at(prev, i - bpp))) % 256 for i, v in enumerate(row)]


@pytest.mark.parametrize("color_type,bpp", [(0, 1), (2, 3), (6, 4)])
def test_filters_against_brute_force(spark, color_type, bpp):
    r = np.random.default_rng(bpp)
    px = r.integers(0, 256, 5 * 6 * bpp).tolist()
    lines = S.scanlines(spark.createDataFrame([(1, 6, 5, color_type, px)], IMAGES))
    rows = np.array(px).reshape(5, -1)
    for f in range(5):
        for line in S.filtered(lines, f).collect():
            y = line.y
            assert line.bytes == residuals(f, rows[y].tolist(), rows[y - 1].tolist() if y else [0] * len(rows[0]), bpp)
    filters, out = S.choose(rows.astype(np.uint8), bpp, "minsum")
    best = {x.y: (x.filter_type, x.bytes) for x in S.select_filter(lines, "minsum").collect()}
    assert {y: (int(filters[y]), out[y].tolist()) for y in range(5)} == best


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 6), st.sampled_from([1, 3, 4]), st.sampled_from(list(S.STRATEGIES)), st.integers(0, 2**32))
def test_reconstruct_inverts(width, height, bpp, strategy, seed):
    rows = np.random.default_rng(seed).integers(0, 256, (height, width * bpp)).astype(np.uint8)
    assert (S.reconstruct(*S.choose(rows, bpp, strategy), bpp) == rows).all()


def test_native_reconstruction(spark):
    row, prev = [100, 150, 200, 250, 3, 9], [50, 100, 150, 200, 255, 0]
    for bpp in (1, 3):
        df = spark.createDataFrame([(row, prev)], "row array<int>, prev array<int>")
        got = df.select(S.reconstruct_sub(S.residuals(1, F.col("row"), F.col("prev"), F.lit(bpp)), bpp).alias("s"), S.reconstruct_up(S.residuals(2, F.col("row"), F.col("prev"), F.lit(bpp)), F.col("prev")).alias("u")).first()
        assert got.s == row and got.u == row


def test_ties_go_to_the_lowest_filter(spark):
    lines = S.scanlines(spark.createDataFrame([(1, 3, 1, 0, [0, 0, 0])], IMAGES))
    assert [r.filter_type for r in S.select_filter(lines, "minsum").collect()] == [0]
    assert S.with_filter_byte(S.select_filter(lines, "paeth")).first().bytes == [4, 0, 0, 0]
