import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselq.functions.dims import distance_codes, length_codes
from tesselq.operators import deflate, huffman, matching, png
from tesselq.plans import catalog
from tesselq.plans.options import OptionsBuilder, preset, preset_by_number

CASES = [b"", b"a", b"ABC", b"ABCABCABC", b"A" * 300, b"Hello, World! " * 100, bytes(range(256)) * 3, b"\0" * 70_000, random.Random(4).randbytes(2000), b"x" * 259]


@pytest.mark.parametrize("kind", ["auto", "fixed", "dynamic", "optimal"])
@pytest.mark.parametrize("data", CASES, ids=range(len(CASES)))
def test_streams_inflate(data, kind):
    for level in (1, 6, 9):
        assert zlib.decompress(deflate.zlib_stream(data, level, kind)) == data


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"xyz", b"\0\0\0"]), max_size=200).map(b"".join))
def test_streams_of_any_content(data):
    assert zlib.decompress(deflate.zlib_stream(data)) == data


def brute_matches(data, chain):
    out = []
    for p in range(len(data)):
        best = (0, 0)
        if p + 3 <= len(data):
            key = lambda i: ((data[i] << 10) ^ (data[i + 1] << 5) ^ data[i + 2]) & 0x7FFF
            seen = [q for q in range(p - 1, max(-1, p - 32769), -1) if q + 3 <= len(data) and key(q) == key(p)][:chain]
            for q in seen:
                n = 0
                while n < 258 and p + n < len(data) and data[q + n] == data[p + n]:
                    n += 1
                if n >= 3 and n > best[0]:
                    best = (n, p - q)
        out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)) | st.binary(max_size=40), st.sampled_from([4, 8]))
def test_best_matches_against_brute_force(data, chain):
    length, distance = matching.best_matches(data, chain)
    assert list(zip(length.tolist(), distance.tolist(), strict=True)) == brute_matches(data, chain)


def test_window_match_never_overlaps():
    assert matching.window_match(b"abcabc", b"abcabcabc") == (6, 6)
    assert matching.window_match(b"xxabcx", b"abcd") == (4, 3)
    assert matching.window_match(b"", b"abc") == (0, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60))
def test_codes_are_complete_and_prefix_free(freq):
    lengths = huffman.code_lengths(np.array(freq))
    used = lengths[lengths > 0]
    assert sum(2.0**-n for n in used.tolist()) == 1 and used.max() <= 15
    codes = huffman.canonical(lengths)
    strings = [format(int(codes[s]), f"0{int(lengths[s])}b")[::-1] for s in np.flatnonzero(lengths)]
    assert all(not b.startswith(a) for i, a in enumerate(sorted(strings)) for b in sorted(strings)[i + 1 : i + 2])


def test_deep_trees_are_limited():
    freq = [1, 1]
    while len(freq) < 40:
        freq.append(freq[-1] + freq[-2])
    lengths = huffman.code_lengths(np.array(freq), 15)
    assert lengths.max() == 15 and sum(2.0 ** -int(n) for n in lengths) == 1
    assert huffman.code_lengths(np.array([0, 0, 5, 0])).tolist() == [0, 0, 1, 1]


def test_code_tables():
    assert [b for _, b, _ in length_codes()][-3:] == [195, 227, 258] and len(length_codes()) == 29
    assert distance_codes()[-1] == (29, 24577, 13) and len(distance_codes()) == 30
    assert deflate.LENGTHS[0][258] == 284 and deflate.LENGTHS[1][258] == 31
    assert huffman.canonical(np.array([3, 3, 3, 3, 3, 2, 4, 4])).tolist() == [2, 6, 1, 5, 3, 0, 7, 15]


@pytest.mark.parametrize("data,want", [([0] * 150, [(18, 127, 7), (18, 1, 7)]), ([5] * 9, [(5, 0, 0), (16, 3, 2), (5, 0, 0), (5, 0, 0)]), ([0, 0, 3], [(0, 0, 0), (0, 0, 0), (3, 0, 0)])])
def test_runs(data, want):
    assert deflate.runs(data) == want


def test_native_runs_agree(spark):
    r = random.Random(3)
    for data in ([0] * 150, [5] * 9, [r.choice([0, 0, 0, 2, 7]) for _ in range(300)]):
        df = spark.createDataFrame([(1, "a", i, x) for i, x in enumerate(data)], "stream_id long, alphabet string, symbol int, length int")
        got = [(x.symbol, x.extra, x.extra_bits) for x in huffman.length_runs(df).orderBy("start", "part").collect()]
        assert got == deflate.runs(data)


@pytest.mark.parametrize("color_type", [0, 2, 6])
@pytest.mark.parametrize("name", ["fast", "balanced", "max", "builder_fast"])
def test_images_come_back(name, color_type):
    r = random.Random(color_type)
    for w, h in ((1, 1), (7, 5), (16, 16)):
        px = bytes(r.randrange(256) for _ in range(w * h * png.EACH[color_type]))
        width, height, kind, back = png.decode_image(png.encode_image(px, w, h, color_type, preset(name)))
        assert (width, height) == (w, h)
        if color_type == 6 and name in ("balanced", "max"):
            px = png.clear_hidden(px)
        if kind == color_type:
            assert back == px


def test_presets_shrink_and_reduce():
    checks = b"".join((b"\xff\0\0\xff" if (x + y) % 2 == 0 else b"\0\xff\0\x80") for y in range(100) for x in range(100))
    sizes = [len(png.encode_image(checks, 100, 100, 6, preset(p))) for p in ("fast", "balanced", "max")]
    assert sizes[0] >= sizes[1] >= sizes[2]
    gray = b"\x64\x64\x64\xff" * 100
    assert png.decode_image(png.encode_image(gray, 10, 10, 6, preset("balanced")))[2] == 2
    assert png.decode_image(png.encode_image(b"\x64\x64\x64" * 100, 10, 10, 2, preset("balanced")))[2] == 0
    assert png.reduce_color(b"\x64\x64\x64\x05" * 4, 2, 2, 6)[1:] == (0, True)
    hidden = b"\x64\x96\xc8\0" * 100
    assert png.decode_image(png.encode_image(hidden, 10, 10, 6, OptionsBuilder().reduce_color_type(False).build()))[3] == bytes(400)


def test_indexed_images():
    px = bytes([10, 20, 30] * 50 + [200, 100, 0] * 50)
    assert png.decode_image(png.encode_image(px, 10, 10, 2, preset("lossy", 16)))[3] == px
    assert [k for k, _, ok in png.parts(png.encode_image(px, 10, 10, 2, preset("lossy", 16))) if ok] == ["IHDR", "PLTE", "IDAT", "IEND"]
    with pytest.raises(ValueError):
        png.encode_image(px, 9, 10, 2, preset("fast"))


def test_options():
    assert preset_by_number(0) == preset("max") and preset_by_number(7) == preset("balanced")
    o = OptionsBuilder().fast().compression_level(99).filter_strategy("up").optimal_deflate(True).strip_metadata(True).build()
    assert (o.level, o.strategy, o.optimal) == (9, "up", True)


def chain_walk(data, chain):
    """The best match of each position by a plain walk over the earlier positions of its hash."""
    seen, out = {}, {}
    for p in range(len(data) - 2):
        own = seen.setdefault((data[p] << 10 ^ data[p + 1] << 5 ^ data[p + 2]) & 32767, [])
        best = (0, 0)
        for q in own[: -chain - 1 : -1]:
            if p - q > 32768:
                break
            n = 0
            while n < min(258, len(data) - p) and data[p + n] == data[q + n]:
                n += 1
            best = (n, p - q) if n > best[0] and n >= 3 else best
        if best[0]:
            out[p] = best
        own.append(p)
    return out


def test_long_and_far_matches_of_documents(spark, tmp_path):
    r = np.random.default_rng(4)
    noise = lambda n: "".join(map(chr, r.integers(33, 127, n)))
    far, late, long = noise(40), noise(40), noise(400)
    # apart by 32768, which a match may be, and by 32769, which it may not; longer than 258; 300 of one hash before one
    texts = [far + noise(32768 - 40) + far, late + noise(32769 - 40) + late, long + noise(50) + long, "".join(f"abc{c}" for c in noise(300)) + "abc!", "a" * 700]
    docs = [(i, t) for i, t in enumerate([*texts, "", None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {i: {} for i, _ in docs}
    for x in catalog.queries()["best_match_documents"](spark, str(tmp_path)).collect():
        got[x.stream_id][x.pos] = (x.length, x.distance)
    assert got == {i: chain_walk((t or "").encode(), 128) for i, t in docs}
    assert got[0][32768] == (40, 32768) and got[1].get(32769, (0, 0))[0] < 40 and got[2][450] == (258, 450)
