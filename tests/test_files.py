import random
import zlib

import pytest

from tesselq.operators.png import CHANNELS, EACH, PASSES, chunk, decode_image, encode_image
from tesselq.plans.options import preset
from tesselq.sources.images import image_files, read_images, write_files
from tesselq.streaming.queue import adler_stream, encode_folder


def made(tmp_path, n=5):
    r = random.Random(1)
    folder = tmp_path / "in"
    folder.mkdir()
    want = {}
    for i in range(n):
        px = bytes(r.randrange(256) for _ in range(6 * 4 * EACH[2]))
        (folder / f"i{i}.png").write_bytes(encode_image(px, 6, 4, 2, preset("fast")))
        want[f"i{i}.png"] = px
    (folder / "note.txt").write_text("no image")
    return folder, want


def test_folder_in_and_out(spark, tmp_path):
    folder, want = made(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: bytes(r.pixels) for r in read_images(spark, str(folder)).collect()}
    assert got == want
    files = image_files(spark, str(folder)).where("kind = 'png'")
    write_files(files.select("path", "data"), f"file://{tmp_path}/out")
    assert {p.name: decode_image(p.read_bytes())[3] for p in (tmp_path / "out").iterdir()} == want


def test_stream_of_files(spark, tmp_path):
    folder, want = made(tmp_path)
    args = (spark, str(folder), f"{tmp_path}/table", f"{tmp_path}/ckpt", preset("balanced"), 2)
    encode_folder(*args).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/table").collect()
    done = {r.path.rsplit("/", 1)[1]: decode_image(bytes(r.data))[3] for r in rows if r.status == "done"}
    assert done == want
    assert [r.error for r in rows if r.status == "error"] == ["cannot read kind unknown"]
    assert {tuple(r.states) for r in rows} == {("pending", "decoding", "compressing", "done"), ("pending", "error")}
    encode_folder(*args).awaitTermination()  # nothing new
    assert spark.read.parquet(f"{tmp_path}/table").count() == len(rows)


def test_stream_of_checksums(spark, tmp_path):
    schema = "stream_id long, seq long, data binary"
    source = f"{tmp_path}/pieces"
    total = {1: b"", 2: b""}
    for batch in range(3):
        rows = [(s, batch * 2 + k, bytearray(bytes([s, batch, k]) * 50)) for s in (1, 2) for k in (0, 1)]
        for s, _, d in rows:
            total[s] += bytes(d)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        adler_stream(stream, f"{tmp_path}/c", f"{tmp_path}/o").awaitTermination()
        got = {}
        for r in spark.read.parquet(f"{tmp_path}/o").orderBy("n_bytes").collect():
            got[r.stream_id] = (r.adler32, r.n_bytes)
        assert got == {s: (zlib.adler32(d), len(d)) for s, d in total.items()}


def test_files_that_cannot_be_read_have_an_error(spark, tmp_path):
    folder, want = made(tmp_path, 2)
    good = (folder / "i0.png").read_bytes()
    (folder / "photo.jpg").write_bytes(b"\xff\xd8\xff")
    (folder / "deep.png").write_bytes(good[:24] + b"\x10" + good[25:])
    (folder / "laced.png").write_bytes(good[:28] + b"\x02" + good[29:])
    (folder / "short.png").write_bytes(good[:50])
    got = {r.path.rsplit("/", 1)[1]: r for r in read_images(spark, str(folder)).collect()}
    assert {k: bytes(r.pixels) for k, r in got.items() if r.error is None} == want
    assert {k for k, r in got.items() if r.error and r.pixels is None} == {"photo.jpg", "deep.png", "laced.png", "short.png"}
    assert got["photo.jpg"].error == "cannot read kind jpeg"


def by_hand(width, height, color_type, depth, laced, samples, extra):
    """A file of the samples by (y, x), with filter 0 in each row."""
    raw = b""
    for x0, y0, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        for y in range(y0, height, dy):
            own = [v for x in range(x0, width, dx) for v in samples[y, x]]
            if own:
                bits = "".join(f"{v:0{depth}b}" for v in own)
                bits += "0" * (-len(bits) % 8)
                raw += b"\0" + int(bits, 2).to_bytes(len(bits) // 8, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([depth, color_type, 0, 0, laced])
    return b"\x89PNG\r\n\x1a\n" + chunk("IHDR", head) + b"".join(chunk(*e) for e in extra) + chunk("IDAT", zlib.compress(raw)) + chunk("IEND", b"")


@pytest.mark.parametrize("laced", [0, 1])
@pytest.mark.parametrize("clear", [False, True])
@pytest.mark.parametrize("color_type,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind_of_png(color_type, depth, clear, laced):
    r = random.Random(depth * 10 + color_type)
    for width, height in ((1, 1), (5, 3), (9, 11)):
        samples = {(y, x): tuple(r.randrange(1 << depth) for _ in range(CHANNELS[color_type])) for y in range(height) for x in range(width)}
        palette = [tuple(r.randrange(256) for _ in range(3)) for _ in range(1 << depth)] if color_type == 3 else []
        extra = [("PLTE", bytes(v for p in palette for v in p))] if palette else []
        key, alphas = samples[0, 0], [r.randrange(256) for _ in palette][:3]
        clear = clear and color_type in (0, 2, 3)
        if clear:
            extra.append(("tRNS", bytes(alphas) if palette else b"".join(v.to_bytes(2, "big") for v in key)))

        def eight(v):
            return v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1)

        want = []
        for y in range(height):
            for x in range(width):
                v = samples[y, x]
                if palette:
                    want += [*palette[v[0]], *([(alphas + [255] * 256)[v[0]]] if clear else [])]
                elif color_type == 4:
                    want += [eight(v[0])] * 3 + [eight(v[1])]
                elif clear:
                    want += [eight(c) for c in (v * 3 if color_type == 0 else v)] + [0 if v == key else 255]
                else:
                    want += map(eight, v)
        w, h, kind, pixels = decode_image(by_hand(width, height, color_type, depth, laced, samples, extra))
        assert (w, h, list(pixels)) == (width, height, want)
        assert kind == (6 if clear or color_type in (4, 6) else 2 if color_type == 3 else color_type)


def test_broken_files_end_in_error_in_the_stream(spark, tmp_path):
    folder, want = made(tmp_path, 3)
    good = (folder / "i0.png").read_bytes()
    (folder / "short.png").write_bytes(good[:50])
    (folder / "none.png").write_bytes(b"no image")
    (folder / "flip.png").write_bytes(good[:45] + bytes([good[45] ^ 255]) + good[46:])
    encode_folder(spark, str(folder), f"{tmp_path}/table", f"{tmp_path}/ckpt", preset("fast"), 3).awaitTermination()
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert {k for k, r in rows.items() if r.status == "done"} == set(want)
    assert all(rows[k].error and rows[k].data is None for k in ("short.png", "none.png", "flip.png", "note.txt"))
