import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselq.operators import color, quantize


def test_median_cut():
    colors = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]])
    counts = np.full(4, 10)
    assert quantize.median_cut(colors, counts, 4).tolist() == colors.tolist()
    assert len(quantize.median_cut(colors, counts, 2)) == 2
    assert len(quantize.median_cut(np.zeros((0, 3), int), np.zeros(0, int), 4)) == 0


def brute_line(pixels, palette, method):
    """The diffusions as defined, one number at a time."""
    shares, of, carry = quantize.LINES[method]
    cut = lambda x: int(x / of)  # noqa: E731  towards zero
    errors = [[0, 0, 0] for _ in range(len(pixels) + 5)]
    out = []
    for i, p in enumerate(pixels):
        c = [min(255, max(0, p[k] + errors[i][k])) for k in range(3)]
        at = min(range(len(palette)), key=lambda j: (sum((c[k] - palette[j][k]) ** 2 for k in range(3)), j))
        out.append(at)
        for ahead, w in shares:
            for k in range(3):
                errors[i + ahead][k] += cut((c[k] - palette[at][k]) * w)
        if carry:
            errors[i + 1] = [min(255, max(0, x)) for x in errors[i + 1]]
    return out


@pytest.mark.parametrize("method", list(quantize.LINES))
def test_lines_against_brute_force(method):
    r = np.random.default_rng(5)
    pixels, palette = r.integers(0, 256, (200, 3)), r.integers(0, 256, (6, 3))
    assert quantize.diffuse_line(pixels, palette, method).tolist() == brute_line(pixels.tolist(), palette.tolist(), method)


def test_rows_pass_errors_down_only():
    pixels = np.full((2, 4, 3), 100)
    palette = np.array([[0, 0, 0], [255, 255, 255]])
    # errors of 100 pass 18, 43, 31 on: below they add up to 18; 18 + 43 - replaced by 18; …
    out = quantize.diffuse_rows(pixels, palette)
    assert out[0].tolist() == [0, 0, 0, 0] and out.max() <= 1


def test_gray_and_alpha_images(spark):
    rows = [(1, 2, 2, 0, [1, 2, 3, 4]), (2, 2, 1, 6, [9, 9, 9, 0, 8, 8, 8, 255])]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, color_type int, pixels array<int>")
    got = {r.image_id: (r.indices, r.palette) for r in quantize.quantized(df, 16).collect()}
    assert got[1][0] == [0, 1, 2, 3] and got[2][1] == [8, 8, 8, 9, 9, 9]


def test_empty_palette_is_index_zero(spark):
    points = spark.createDataFrame([(1, 5, 5, 5)], "image_id long, r int, g int, b int")
    palette = spark.createDataFrame([], "idx int, r int, g int, b int")
    assert color.map_to_palette(points, palette).select(F.col("idx")).first()[0] == 0
