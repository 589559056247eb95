"""The registered queries over the driver's tables and their SQL for DuckDB, side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselq.functions import bytes as B
from tesselq.functions import dims, labels
from tesselq.functions import sql as names
from tesselq.operators import color, deflate, huffman, jobs, matching, png, quantize, scanlines
from tesselq.plans import views
from tesselq.plans.options import preset
from tesselq.streaming.queue import joined_adler

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

IMG = "img AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5)))::INT) AS px FROM embeddings)"
LINES = IMG + ", l AS (SELECT image_id, y::INT AS y, px[y * 8 + 1 : y * 8 + 8] AS cur, CASE WHEN y = 0 THEN [0, 0, 0, 0, 0, 0, 0, 0] ELSE px[y * 8 - 7 : y * 8] END AS prev FROM img, range(8) t(y))"
PAETH = "CASE WHEN abs(u - c) <= abs(a - c) AND abs(u - c) <= abs(a + u - 2 * c) THEN a WHEN abs(a - c) <= abs(a + u - 2 * c) THEN u ELSE c END"
GUESS = ("0", "a", "u", "(a + u) // 2", PAETH)
POINTS = "pts AS (SELECT l_orderkey % 64 AS image_id, (l_quantity * 5)::INT AS r, (round(l_discount * 100) * 20)::INT AS g, (round(l_tax * 100) * 20)::INT AS b FROM lineitem)"
COUNTS = POINTS + ", cnt AS (SELECT image_id, r, g, b, count(*) AS n FROM pts GROUP BY ALL)"
PALETTE = "pal AS (SELECT i::INT AS idx, ((i & 1) * t)::INT AS r, ((i >> 1 & 1) * t)::INT AS g, ((i >> 2 & 1) * t)::INT AS b FROM (SELECT i, CASE WHEN i < 8 THEN 127 ELSE 255 END AS t FROM range(16) x(i)))"
RGBA = IMG + """, rgba AS (SELECT image_id, list_transform(px, lambda v, i: CASE WHEN image_id % 2 = 0 AND (i - 1) % 4 = 3 THEN 255
    WHEN image_id % 3 = 0 AND (i - 1) % 4 < 3 THEN px[i - (i - 1) % 4] ELSE v END) AS px FROM img)"""
BYTES = "s AS (SELECT doc_id AS stream_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)"
PAGE_BYTES = BYTES.replace("doc_id", "page_id").replace("text", "html").replace("documents", "pages")
ADLER = "((len(b) + coalesce(list_sum(list_transform(b, lambda v, i: (len(b) - i + 1) * v)), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521)::BIGINT"
CRC = "xor(list_reduce(b, lambda c, v: list_reduce(range(8), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(c, v)), 4294967295), 4294967295)::BIGINT"
JOBS = """j AS (SELECT doc_id AS id, source AS session, 'file' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.txt' END AS name,
    CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime,
    (['pending', 'decoding', 'compressing', 'done', 'error'])[doc_id % 5 + 1] AS status, CASE WHEN doc_id % 5 = 4 THEN 'bad file' END AS error,
    n_chars AS original_bytes, CASE WHEN doc_id % 5 = 3 THEN floor(n_chars * (doc_id % 13) / 10)::BIGINT END AS compressed_bytes FROM documents)"""


def size_sql(x: str) -> str:
    def tenth(by: str) -> str:
        t = f"floor({x} / {by}::DOUBLE * 10 + 0.5)::BIGINT"
        return f"(CASE WHEN {t} % 10 = 0 THEN ({t} // 10)::VARCHAR ELSE ({t} // 10)::VARCHAR || '.' || ({t} % 10)::VARCHAR END)"

    return f"CASE WHEN {x} >= 1000000 THEN {tenth('1000000')} || ' MB' WHEN {x} >= 1000 THEN {tenth('1000')} || ' KB' ELSE {x}::VARCHAR || ' bytes' END"


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def joined(numbers: Column | str) -> Column:
    return F.array_join((F.col(numbers) if isinstance(numbers, str) else numbers).cast("array<string>"), ",")


def gray_lines(spark: SparkSession, sf: str) -> DataFrame:
    return scanlines.scanlines(views.images(spark, sf))


def filtered_sql(f: int) -> str:
    guess = GUESS[f]
    inner = f"list_transform(list_zip(cur, list_concat([0], cur[:7]), prev, list_concat([0], prev[:7])), lambda q: (q[1] - ({guess}) + 256) % 256)"
    for name, at in (("a", 2), ("u", 3), ("c", 4)):
        inner = re.sub(rf"\b{name}\b(?!\()", f"q[{at}]", inner)
    return inner


# --- filters ---
for _f, _name in enumerate(scanlines.FILTERS):
    register(
        f"filter_{_name}",
        lambda s, d, f=_f: scanlines.filtered(gray_lines(s, d), f).select("image_id", "y", joined("bytes").alias("bytes")),
        f"WITH {LINES} SELECT image_id, y, array_to_string({filtered_sql(_f)}, ',') AS bytes FROM l",
    )
ALL_SCORES = "f AS (" + " UNION ALL ".join(f"SELECT image_id, y, {f} AS filter_type, list_sum(list_transform({filtered_sql(f)}, lambda v: CASE WHEN v > 127 THEN 256 - v ELSE v END))::BIGINT AS score FROM l" for f in range(5)) + ")"
register(
    "filter_scores",
    lambda s, d: scanlines.scored(gray_lines(s, d)).select("image_id", "y", F.explode("candidates").alias("c")).select("image_id", "y", "c.filter_type", "c.score"),
    f"WITH {LINES}, {ALL_SCORES} SELECT image_id, y, filter_type::INT AS filter_type, score FROM f",
)
for _name, _filters in scanlines.STRATEGIES.items():
    register(
        f"filter_select_{_name}",
        lambda s, d, name=_name: scanlines.select_filter(gray_lines(s, d), name).select("image_id", "y", "filter_type", "score"),
        f"WITH {LINES}, {ALL_SCORES}, m AS (SELECT image_id, y, min(score * 8 + filter_type) AS m FROM f WHERE filter_type IN ({', '.join(map(str, _filters))}) GROUP BY ALL) SELECT image_id, y, (m % 8)::INT AS filter_type, (m // 8)::BIGINT AS score FROM m",
    )
register(
    "scanline_bytes",
    lambda s, d: scanlines.with_filter_byte(scanlines.select_filter(gray_lines(s, d), "up")).select("image_id", "y", joined("bytes").alias("bytes")),
    f"WITH {LINES} SELECT image_id, y, '2,' || array_to_string({filtered_sql(2)}, ',') AS bytes FROM l",
)
ROWS_SQL = f"WITH {LINES} SELECT image_id, y, array_to_string(cur, ',') AS bytes FROM l"
register("reconstruct_sub", lambda s, d: gray_lines(s, d).select("image_id", "y", joined(scanlines.reconstruct_sub(scanlines.residuals(1, F.col("row"), F.col("prev"), F.col("bpp")), 1)).alias("bytes")), ROWS_SQL)
register("reconstruct_up", lambda s, d: gray_lines(s, d).select("image_id", "y", joined(scanlines.reconstruct_up(scanlines.residuals(2, F.col("row"), F.col("prev"), F.col("bpp")), F.col("prev"))).alias("bytes")), ROWS_SQL)


def restored_images(spark: SparkSession, sf: str, strategy: str, color_type: int) -> DataFrame:
    """Images through the codec's filters and back."""
    import pyarrow as pa

    each = png.EACH[color_type]

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                rows = np.array(r["pixels"], np.uint8).reshape(r["height"], -1)
                out.append(scanlines.reconstruct(*scanlines.choose(rows, each, strategy), each).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["image_id", "pixels"])

    df = views.images(spark, sf, color_type).select("image_id", "height", "pixels").mapInArrow(run, "image_id long, pixels array<int>")
    return df.select("image_id", joined("pixels").alias("pixels"))


PIXELS_SQL = f"WITH {IMG} SELECT image_id, array_to_string(px, ',') AS pixels FROM img"
for _name in ("none", "average", "paeth", "minsum"):
    register(f"reconstruct_image_{_name}", lambda s, d, name=_name: restored_images(s, d, name, 0), PIXELS_SQL)
    register(f"reconstruct_rgba_{_name}", lambda s, d, name=_name: restored_images(s, d, name, 6), PIXELS_SQL)

# --- raster properties and reductions ---
GRAY_SQL = "len(list_filter(px, lambda v, i: (i - 1) % 4 = 0 AND (v <> px[i + 1] OR v <> px[i + 2]))) = 0"
OPAQUE_SQL = "len(list_filter(px, lambda v, i: (i - 1) % 4 = 3 AND v <> 255)) = 0"
register(
    "raster_properties",
    lambda s, d: views.opaque_images(s, d).select("image_id", color.has_alpha(F.col("pixels"), F.col("color_type")).alias("has_alpha"), color.is_grayscale(F.col("pixels"), F.col("color_type")).alias("is_grayscale"), color.can_reduce_to_rgb(F.col("pixels"), F.col("width"), F.col("height")).alias("can_rgb"), color.can_reduce_to_gray(F.col("pixels"), F.col("width"), F.col("height"), F.col("color_type")).alias("can_gray"), color.length_fits(F.col("pixels"), F.col("width"), F.col("height"), F.col("color_type")).alias("length_fits")),
    f"WITH {RGBA} SELECT image_id, NOT ({OPAQUE_SQL}) AS has_alpha, {GRAY_SQL} AS is_grayscale, {OPAQUE_SQL} AS can_rgb, {GRAY_SQL} AS can_gray, true AS length_fits FROM rgba",
)
register(
    "reduce_to_rgb",
    lambda s, d: views.opaque_images(s, d).where(color.can_reduce_to_rgb(F.col("pixels"), F.col("width"), F.col("height"))).select("image_id", joined(color.to_rgb(F.col("pixels"))).alias("pixels")),
    f"WITH {RGBA} SELECT image_id, array_to_string(list_filter(px, lambda v, i: (i - 1) % 4 < 3), ',') AS pixels FROM rgba WHERE {OPAQUE_SQL}",
)
register(
    "reduce_to_gray",
    lambda s, d: views.opaque_images(s, d).where(color.can_reduce_to_gray(F.col("pixels"), F.col("width"), F.col("height"), F.col("color_type"))).select("image_id", joined(color.to_gray(F.col("pixels"), F.col("color_type"))).alias("pixels"), color.has_alpha(F.col("pixels"), F.col("color_type")).alias("loses_alpha")),
    f"WITH {RGBA} SELECT image_id, array_to_string(list_filter(px, lambda v, i: (i - 1) % 4 = 0), ',') AS pixels, NOT ({OPAQUE_SQL}) AS loses_alpha FROM rgba WHERE {GRAY_SQL}",
)
register(
    "optimize_alpha",
    lambda s, d: views.images(s, d, 6).withColumn("pixels", F.transform(F.col("pixels"), lambda v: F.when(v < 110, 0).otherwise(v))).select("image_id", joined(color.clear_hidden(F.col("pixels"))).alias("pixels")),
    f"WITH {IMG}, z AS (SELECT image_id, list_transform(px, lambda v: CASE WHEN v < 110 THEN 0 ELSE v END) AS px FROM img) SELECT image_id, array_to_string(list_transform(px, lambda v, i: CASE WHEN (i - 1) % 4 < 3 AND px[i - (i - 1) % 4 + 3] = 0 THEN 0 ELSE v END), ',') AS pixels FROM z",
)
PART = "p AS (SELECT p_partkey, p_size::BIGINT AS w, p_partkey % 97 AS h, ([0, 2, 3, 6, 5])[p_partkey % 5 + 1]::BIGINT AS ct, ([1, 2, 4, 8, 16, 3])[p_partkey % 6 + 1]::BIGINT AS depth, (p_partkey % 11) // 10 AS comp, (p_partkey % 13) // 12 AS filt, p_partkey % 17 % 3 AS inter FROM part)"


def part_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields of many kinds, right and wrong ones, one for each part."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int")).cast("long")
    return views.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"), (k % 97).alias("h"), pick((0, 2, 3, 6, 5), 5).alias("ct"), pick((1, 2, 4, 8, 16, 3), 6).alias("depth"), F.floor(k % 11 / 10).alias("comp"), F.floor(k % 13 / 12).alias("filt"), (k % 17 % 3).alias("inter"))


BPP_SQL = "CASE ct WHEN 2 THEN 3 WHEN 6 THEN 4 ELSE 1 END"
register(
    "image_sizes",
    lambda s, d: part_headers(s, d).select("p_partkey", scanlines.bytes_per_pixel(F.col("ct")).alias("bpp"), scanlines.bytes_per_pixel(F.col("ct"), 4).alias("bridge_bpp"), scanlines.scanline_length(F.col("w"), F.col("ct")).alias("line"), scanlines.expected_idat_size(F.col("w"), F.col("h"), F.col("ct")).alias("expected")),
    f"WITH {PART} SELECT p_partkey, {BPP_SQL} AS bpp, CASE ct WHEN 2 THEN 3 WHEN 6 THEN 4 WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 4 END AS bridge_bpp, 1 + w * ({BPP_SQL}) AS line, 2 + greatest(10, (1 + w * ({BPP_SQL})) * h // 2) + 4 AS expected FROM p",
)
register(
    "header_errors",
    lambda s, d: part_headers(s, d).select("p_partkey", png.ihdr_error(*(F.col(c) for c in ("w", "h", "depth", "ct", "comp", "filt", "inter"))).alias("error")),
    f"""WITH {PART} SELECT p_partkey, CASE WHEN w = 0 OR h = 0 THEN 'zero dimension' WHEN ct = 5 THEN 'invalid color type'
    WHEN NOT ((ct = 0 AND depth IN (1, 2, 4, 8, 16)) OR (ct = 3 AND depth IN (1, 2, 4, 8)) OR (ct IN (2, 6) AND depth IN (8, 16))) THEN 'invalid bit depth'
    WHEN comp <> 0 THEN 'invalid compression' WHEN filt <> 0 THEN 'invalid filter' WHEN inter > 1 THEN 'invalid interlace' END AS error FROM p""",
)
register(
    "header_chunks",
    lambda s, d: part_headers(s, d).select("p_partkey", F.hex(png.chunk_column(F.lit("IHDR"), png.ihdr_column(*(F.col(c) for c in ("w", "h", "depth", "ct"))))).alias("chunk")),
    f"""WITH {PART}, c AS (SELECT p_partkey, '49484452' || printf('%08X', w) || printf('%08X', h) || printf('%02X', depth) || printf('%02X', ct) || '000000' AS body FROM p),
    s AS (SELECT p_partkey, body, list_transform(regexp_extract_all(body, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM c)
    SELECT p_partkey, '0000000D' || body || printf('%08X', {CRC}) AS chunk FROM s""",
)
register(
    "chunk_kinds",
    lambda s, d: views.table(s, d, "nation").select("n_nationkey", (kind := F.element_at(F.array(*map(F.lit, ("IHDR", "IDAT", "IEND", "tRNS", "gAMA", "PLTE"))), (F.col("n_nationkey") % 6 + 1).cast("int"))).alias("kind"), png.is_critical(kind).alias("critical"), png.is_required(kind).alias("required")),
    "WITH k AS (SELECT n_nationkey, (['IHDR', 'IDAT', 'IEND', 'tRNS', 'gAMA', 'PLTE'])[n_nationkey % 6 + 1] AS kind FROM nation) SELECT n_nationkey, kind, kind IN ('IHDR', 'IDAT', 'IEND', 'PLTE') AS critical, kind IN ('IHDR', 'IDAT', 'IEND') AS required FROM k",
)
register(
    "palette_checks",
    lambda s, d: views.table(s, d, "part").select("p_partkey", png.palette_error(F.col("p_partkey") % 300, F.col("p_size")).alias("error")),
    "SELECT p_partkey, CASE WHEN p_partkey % 300 NOT BETWEEN 1 AND 256 THEN 'palette size' WHEN p_size > p_partkey % 300 THEN 'more alphas than colors' END AS error FROM part",
)
register(
    "zlib_headers",
    lambda s, d: s.range(0, 17).select(F.col("id").alias("bits"), F.hex(deflate.zlib_header_column(F.expr("shiftleft(1L, cast(id as int))"), F.lit(2))).alias("header")),
    "SELECT b AS bits, CASE WHEN b BETWEEN 8 AND 15 THEN printf('%02X%02X', 8 + 16 * (b - 8), 128 + (31 - ((8 + 16 * (b - 8)) * 256 + 128) % 31) % 31) END AS header FROM range(17) t(b)",
)
register(
    "stored_blocks",
    lambda s, d: views.byte_streams(s, d).select("stream_id", F.hex(deflate.stored_block_column(F.col("data"), F.lit(True))).alias("block")),
    "WITH e AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT *, len(h) // 2 AS n FROM e) SELECT stream_id, CASE WHEN n <= 65535 THEN '01' || printf('%02X%02X%02X%02X', n % 256, n // 256, (65535 - n) % 256, (65535 - n) // 256) || h END AS block FROM n",
)

# --- colors ---
register("count_colors", lambda s, d: color.count_colors(views.color_points(s, d)), f"WITH {COUNTS} SELECT * FROM cnt")
register("unique_colors", lambda s, d: color.unique_colors(views.color_points(s, d)), f"WITH {COUNTS} SELECT image_id, count(*) AS n_colors FROM cnt GROUP BY image_id")
register("ranked_colors", lambda s, d: color.ranked_colors(color.count_colors(views.color_points(s, d))), f"WITH {COUNTS} SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b))::INT AS rank FROM cnt")
register("mean_color", lambda s, d: color.weighted_mean(color.count_colors(views.color_points(s, d))), f"WITH {COUNTS} SELECT image_id, " + ", ".join(f"(sum({c} * n) // sum(n))::INT AS {c}" for c in "rgb") + " FROM cnt GROUP BY image_id")
register(
    "color_extents",
    lambda s, d: color.extents(color.count_colors(views.color_points(s, d))),
    f"WITH {COUNTS}, e AS (SELECT image_id, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in "rgb") + " FROM cnt GROUP BY image_id) SELECT *, CASE WHEN max_r - min_r >= max_g - min_g AND max_r - min_r >= max_b - min_b THEN 'r' WHEN max_g - min_g >= max_b - min_b THEN 'g' ELSE 'b' END AS widest FROM e",
)
NEAR = "near AS (SELECT c.r, c.g, c.b, min(((c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2)::BIGINT * 16 + p.idx) % 16 AS idx FROM (SELECT DISTINCT r, g, b FROM pts) c, pal p GROUP BY ALL)"
register("nearest_palette", lambda s, d: color.nearest(views.color_points(s, d), views.palette(s)), f"WITH {POINTS}, {PALETTE}, {NEAR} SELECT r, g, b, idx::INT AS idx FROM near")
register(
    "map_to_palette",
    lambda s, d: color.map_to_palette(views.color_points(s, d), views.palette(s)).groupBy("image_id", "idx").agg(F.count("*").alias("n")),
    f"WITH {POINTS}, {PALETTE}, {NEAR} SELECT image_id, idx::INT AS idx, count(*) AS n FROM pts JOIN near USING (r, g, b) GROUP BY ALL",
)
register(
    "median_cut_sizes",
    lambda s, d: quantize.palettes(color.count_colors(views.color_points(s, d)), 64).groupBy("image_id").agg(F.count("*").alias("n_colors")),
    f"WITH {COUNTS} SELECT image_id, least(64, count(*)) AS n_colors FROM cnt GROUP BY image_id",
)
register("median_cut", lambda s, d: quantize.palettes(color.count_colors(views.color_points(s, d)), 16))
GRAYS = np.array([[v, v, v] for v in (40, 80, 110, 128, 150, 200)])
NEAR_GRAY = "list_transform(px, lambda v: list_aggregate(list_transform([40, 80, 110, 128, 150, 200], lambda p, i: abs(v - p) * 10 + i - 1), 'min') % 10)"
register("threshold", lambda s, d: quantize.dither(views.images(s, d), GRAYS, "threshold").select("image_id", joined("indices").alias("indices")), f"WITH {IMG} SELECT image_id, array_to_string({NEAR_GRAY}, ',') AS indices FROM img")
for _name in ("floyd_steinberg", "jarvis", "encoder", "floyd_steinberg_rows"):
    register(f"dither_{_name}", lambda s, d, name=_name: quantize.dither(views.images(s, d), GRAYS, name).select("image_id", joined("indices").alias("indices")))
register("quantized_error", lambda s, d: quantize.mean_error(quantize.quantized(views.images(s, d), 16), views.images(s, d)))
register("quantize_16", lambda s, d: quantize.quantized(views.images(s, d), 16).select("image_id", joined("indices").alias("indices"), joined("palette").alias("palette")))
register("quantize_dithered", lambda s, d: quantize.quantized(views.images(s, d), 8, True).select("image_id", joined("indices").alias("indices"), joined("palette").alias("palette")))

# --- bytes ---
register(
    "byte_histogram",
    lambda s, d: views.byte_streams(s, d).select("stream_id", F.explode(B.chars_of(F.col("data"))).alias("c")).groupBy("stream_id", "c").agg(F.count("*").alias("n")).select("stream_id", F.ascii("c").alias("byte"), "n"),
    f"WITH {BYTES}, e AS (SELECT stream_id, unnest(b) AS v FROM s) SELECT stream_id, v::INT AS byte, count(*) AS n FROM e GROUP BY ALL",
)


def literal_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    streams = views.byte_streams(spark, sf)
    seen = streams.select("stream_id", F.explode(B.chars_of(F.col("data"))).alias("c")).groupBy("stream_id", "c").agg(F.count("*").alias("freq")).select("stream_id", F.ascii("c").alias("symbol"), "freq")
    return seen.unionByName(streams.select("stream_id", F.lit(256).alias("symbol"), F.lit(1).cast("long").alias("freq")))


register("literal_frequencies", literal_frequencies, f"WITH {BYTES}, e AS (SELECT stream_id, unnest(b) AS v FROM s) SELECT stream_id, v::INT AS symbol, count(*) AS freq FROM e GROUP BY ALL UNION ALL SELECT stream_id, 256, 1 FROM s")
register("adler32", lambda s, d: views.byte_streams(s, d).select("stream_id", B.adler32_of(F.col("data")).alias("adler32")), f"WITH {BYTES} SELECT stream_id, {ADLER} AS adler32 FROM s")
register("adler32_pages", lambda s, d: views.page_streams(s, d).select("stream_id", B.adler32_of(F.col("data")).alias("adler32")), f"WITH {PAGE_BYTES} SELECT stream_id, {ADLER} AS adler32 FROM s")


def adler_of_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Checksums from pieces of 1000 bytes, each summed for itself."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("data") / 1000).cast("int"))).alias("seq")
    pieces = views.byte_streams(spark, sf).select("stream_id", "data", at).select("stream_id", "seq", F.expr("substring(data, seq * 1000 + 1, 1000)").alias("data"))
    return joined_adler(pieces, F.col("data"))


register("adler32_joined", adler_of_pieces, f"WITH {BYTES} SELECT stream_id, {ADLER} AS adler32 FROM s")
register("crc32", lambda s, d: views.byte_streams(s, d).select("stream_id", F.crc32("data").alias("crc32")), f"WITH {BYTES} SELECT stream_id, {CRC} AS crc32 FROM s")


def trigram_hashes(spark: SparkSession, sf: str) -> DataFrame:
    hashed = views.byte_streams(spark, sf).select("stream_id", B.trigram_hashes_of(F.col("data")).alias("h"))
    return hashed.select("stream_id", F.size("h").cast("long").alias("n"), F.aggregate("h", F.lit(0).cast("long"), lambda s, h: s + h).alias("total"))


register("trigram_hashes", trigram_hashes, f"WITH {BYTES}, h AS (SELECT stream_id, list_transform(b[3:], lambda c, i: xor(xor(b[i] << 10, b[i + 1] << 5), c) & 32767) AS h FROM s) SELECT stream_id, len(h) AS n, coalesce(list_sum(h), 0)::BIGINT AS total FROM h")

# --- matching, codes, streams ---
IMAGE_STREAMS = "s AS (SELECT image_id AS stream_id, list_transform(px, lambda v: v // 16) AS b FROM img)"


def image_streams(spark: SparkSession, sf: str) -> DataFrame:
    """The gray images at 16 levels as streams of 64 bytes, which repeat."""
    coarse = views.images(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v / 16).cast("int")))
    return views.binary_images(coarse).select(F.col("image_id").alias("stream_id"), F.col("pixels").alias("data"))


def best_match_rows(spark: SparkSession, sf: str) -> DataFrame:
    numbers = B.bytes_of(F.col("data"))
    at = image_streams(spark, sf).select("stream_id", numbers.alias("data"), F.size(numbers).alias("n"), F.explode(F.sequence(F.lit(0), F.octet_length("data") - 3)).alias("pos"))
    hashed = at.withColumn("hash", B.trigram_hash(F.get("data", F.col("pos")), F.get("data", F.col("pos") + 1), F.get("data", F.col("pos") + 2)))
    return matching.best_matches_sql(hashed, 4)


def best_match_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows by the search that whole streams use."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(i, int(p), int(n[p]), int(far[p])) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, far in [matching.best_matches(data, 4)] for p in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["stream_id", "pos", "length", "distance"])

    return image_streams(spark, sf).mapInArrow(run, "stream_id long, pos int, length int, distance int")


def best_match_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The search over whole texts with the chains of level 6: every position that has a match."""
    return matching.match_rows(views.byte_streams(spark, sf), 6)


MATCH_SQL = f"""WITH {IMG}, {IMAGE_STREAMS}, p AS (SELECT stream_id, b, i - 1 AS pos, xor(xor(b[i] << 10, b[i + 1] << 5), b[i + 2]) & 32767 AS h FROM s, range(1, 63) t(i)),
    c AS (SELECT x.stream_id, x.b, x.pos, y.pos AS q, row_number() OVER (PARTITION BY x.stream_id, x.pos ORDER BY y.pos DESC) AS k FROM p x JOIN p y ON x.stream_id = y.stream_id AND x.h = y.h AND y.pos < x.pos),
    m AS (SELECT stream_id, pos, q, coalesce(list_min(list_filter(range(64 - pos), lambda i: b[pos + i + 1] <> b[q + i + 1])), 64 - pos) AS n FROM c WHERE k <= 4)
    SELECT stream_id, pos::INT AS pos, (max(n * 100 - (pos - q)) + 99) // 100 AS length, ((max(n * 100 - (pos - q)) + 99) // 100 * 100 - max(n * 100 - (pos - q)))::INT AS distance FROM m WHERE n >= 3 GROUP BY stream_id, pos"""
MATCH_SQL = MATCH_SQL.replace("(max(n * 100 - (pos - q)) + 99) // 100 AS length", "((max(n * 100 - (pos - q)) + 99) // 100)::INT AS length")
register("best_match_relational", best_match_rows, MATCH_SQL)
register("best_match_search", best_match_search, MATCH_SQL)
register("best_match_documents", best_match_documents)
MD5_SQL = "SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents"


def checked(df: DataFrame) -> DataFrame:
    return df.select("stream_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


register("lz77_round_trip", lambda s, d: checked(matching.round_trip(views.byte_streams(s, d), 6)), MD5_SQL)
register("lz77_tokens_restored", lambda s, d: checked(matching.restored(matching.tokens(image_streams(s, d), 9))), f"WITH {IMG}, {IMAGE_STREAMS} SELECT stream_id, 64::BIGINT AS n_bytes, md5(array_to_string(list_transform(b, lambda v: chr(v::INT)), '')) AS md5 FROM s")
for _kind in ("auto", "fixed", "dynamic", "optimal"):
    register(f"deflate_round_trip_{_kind}", lambda s, d, kind=_kind: checked(deflate.inflated(deflate.deflated(views.byte_streams(s, d), 2 if kind != "optimal" else 8, kind))), MD5_SQL)
register("deflate_pages", lambda s, d: checked(deflate.inflated(deflate.deflated(views.page_streams(s, d), 6))), MD5_SQL.replace("doc_id", "page_id").replace("text", "html").replace("documents", "pages"))
register(
    "token_coverage",
    lambda s, d: matching.tokens(views.byte_streams(s, d), 2).groupBy("stream_id").agg(F.sum(F.when(F.col("is_literal"), 1).otherwise(F.col("length"))).cast("long").alias("n_bytes")),
    "SELECT doc_id AS stream_id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents WHERE text <> ''",
)
register("token_frequencies", lambda s, d: deflate.token_frequencies(views.byte_streams(s, d), 2))
register("fixed_block_bits", lambda s, d: deflate.fixed_block_bits(matching.tokens(views.byte_streams(s, d), 2)))
# the same on short streams, whose greedy parse SQL can follow
PARSE_SQL = f"""WITH RECURSIVE m AS ({MATCH_SQL}), {IMG}, {IMAGE_STREAMS},
    path AS (SELECT stream_id, 0 AS pos FROM s UNION ALL SELECT p.stream_id, p.pos + coalesce(m.length, 1) FROM path p LEFT JOIN m ON m.stream_id = p.stream_id AND m.pos = p.pos WHERE p.pos + coalesce(m.length, 1) < 64),
    tok AS (SELECT p.stream_id, p.pos, s.b[p.pos + 1] AS literal, m.length, m.distance FROM path p JOIN s ON s.stream_id = p.stream_id LEFT JOIN m ON m.stream_id = p.stream_id AND m.pos = p.pos)"""
LENGTH_EXTRA = "(CASE WHEN length < 11 THEN 0 ELSE floor(log2(length - 3))::INT - 2 END)"
LENGTH_CODE = f"(CASE WHEN length < 11 THEN 254 + length ELSE 257 + 4 * {LENGTH_EXTRA} + ((length - 3) >> {LENGTH_EXTRA}) END)"
DISTANCE_CODE = "(CASE WHEN distance < 3 THEN distance - 1 ELSE 2 * floor(log2(distance - 1))::INT + ((distance - 1) >> (floor(log2(distance - 1))::INT - 1)) % 2 END)"
register(
    "token_frequencies_images",
    lambda s, d: deflate.token_frequencies(image_streams(s, d), 1),
    f"""{PARSE_SQL}, e AS (SELECT stream_id, 'literal' AS alphabet, CASE WHEN length IS NULL THEN literal ELSE {LENGTH_CODE} END AS symbol FROM tok
    UNION ALL SELECT stream_id, 'literal', 256 FROM s UNION ALL SELECT stream_id, 'distance', {DISTANCE_CODE} FROM tok WHERE length IS NOT NULL)
    SELECT stream_id, alphabet, symbol::INT AS symbol, count(*) AS freq FROM e GROUP BY ALL""",
)
register(
    "fixed_block_bits_images",
    lambda s, d: deflate.fixed_block_bits(matching.tokens(image_streams(s, d), 1)),
    f"""{PARSE_SQL}, w AS (SELECT stream_id, CASE WHEN length IS NULL THEN CASE WHEN literal < 144 THEN 8 ELSE 9 END ELSE 7 + {LENGTH_EXTRA} + 5 + (CASE WHEN distance < 5 THEN 0 ELSE floor(log2(distance - 1))::INT - 1 END) END AS bits FROM tok)
    SELECT stream_id, (sum(bits) + 10)::BIGINT AS bits, ((sum(bits) + 17) // 8)::BIGINT AS n_bytes FROM w GROUP BY stream_id""",
)
register(
    "coarse_distances_images",
    lambda s, d: coarse_distances(image_streams(s, d), 1),
    f"{PARSE_SQL} SELECT stream_id, (CASE WHEN distance <= 4 THEN distance - 1 ELSE ceil(log2(distance)) + 1 END)::INT AS code, count(*) AS n FROM tok WHERE length IS NOT NULL GROUP BY ALL",
)


def coarse_distances(streams: DataFrame, level: int) -> DataFrame:
    found = matching.tokens(streams, level).where("NOT is_literal").select("stream_id", huffman.coarse_distance_code(F.col("distance")).cast("int").alias("code"))
    return found.groupBy("stream_id", "code").agg(F.count("*").alias("n"))


def kraft(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of 2 ** -length of each text's own code, 1 if it is complete, and that no code is too long."""
    freqs = literal_frequencies(spark, sf).withColumn("alphabet", F.lit("literal"))
    return huffman.code_table(freqs).groupBy("stream_id").agg(F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"), (F.max("length") <= huffman.LONGEST).alias("short"))


register("huffman_kraft", kraft, "SELECT doc_id AS stream_id, 1.0::DOUBLE AS kraft, true AS short FROM documents")


def fixed_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(0, a, i, n) for a in ("literal", "distance") for i, n in enumerate(huffman.fixed_lengths(a))]
    return huffman.canonical_codes(spark.createDataFrame(rows, "stream_id long, alphabet string, symbol int, length int")).select("alphabet", "symbol", "length", "code", "bits")


register(
    "fixed_codes",
    fixed_codes,
    """WITH c AS (SELECT 'literal' AS alphabet, s::INT AS symbol, CASE WHEN s < 144 THEN 8 WHEN s < 256 THEN 9 WHEN s < 280 THEN 7 ELSE 8 END AS length,
      CASE WHEN s < 144 THEN 48 + s WHEN s < 256 THEN 400 + s - 144 WHEN s < 280 THEN s - 256 ELSE 192 + s - 280 END AS code FROM range(288) t(s)
      UNION ALL SELECT 'distance', s::INT, 5, s FROM range(30) t(s))
    SELECT alphabet, symbol, length, code::BIGINT AS code, list_reduce(range(length), lambda x, i: x * 2 + (code >> i & 1), 0::BIGINT)::BIGINT AS bits FROM c""",
)


def run_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the images' values at four levels: how many islands they come from, and how far they reach."""
    lengths = views.images(spark, sf).select(F.col("image_id").alias("stream_id"), F.lit("literal").alias("alphabet"), F.posexplode(F.transform("pixels", lambda v: F.greatest(F.lit(0), F.floor(v / 16).cast("int") - 7))).alias("symbol", "length"))
    runs = huffman.length_runs(lengths)
    return runs.groupBy("stream_id").agg(F.count_distinct("start").alias("n_islands"), F.sum("repeat").cast("long").alias("covered"))


register("length_runs", run_coverage, f"WITH {IMG}, v AS (SELECT image_id AS stream_id, i, greatest(0, px[i] // 16 - 7) AS x, greatest(0, px[i - 1] // 16 - 7) AS before FROM img, range(1, 65) t(i)) SELECT stream_id, count(*) FILTER (i = 1 OR x <> before) AS n_islands, count(*) AS covered FROM v GROUP BY stream_id")
register(
    "length_code_map",
    lambda s, d: s.range(3, 259).select(F.col("id").alias("length"), huffman.first_code(F.col("id"), dims.length_codes()).alias("code")),
    "SELECT n AS length, (CASE WHEN n < 11 THEN 254 + n ELSE 257 + 4 * (floor(log2(n - 3))::INT - 1) + ((n - 3) >> (floor(log2(n - 3))::INT - 2)) % 4 END)::INT AS code FROM range(3, 259) t(n)",
)
register(
    "distance_code_map",
    lambda s, d: s.range(1, 32769).select(F.col("id").alias("distance"), huffman.first_code(F.col("id"), dims.distance_codes()).alias("code"), huffman.coarse_distance_code(F.col("id")).cast("int").alias("coarse")),
    "SELECT n AS distance, (CASE WHEN n < 3 THEN n - 1 ELSE 2 * floor(log2(n - 1))::INT + ((n - 1) >> (floor(log2(n - 1))::INT - 1)) % 2 END)::INT AS code, (CASE WHEN n <= 4 THEN n - 1 WHEN n > 16384 THEN 16 ELSE ceil(log2(n)) + 1 END)::INT AS coarse FROM range(1, 32769) t(n)",
)
register("level_chains", lambda s, d: dims.dim_level(s), "SELECT n::INT AS level, (2 << n)::INT AS max_chain FROM range(1, 10) t(n)")
register(
    "bit_packing",
    lambda s, d: deflate.packed_bytes(views.table(s, d, "lineitem").select((F.col("l_orderkey") % 64).alias("stream_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), (F.col("l_partkey") % 8).alias("bits"), F.lit(3).alias("width")), F.floor(F.col("seq.l_orderkey") / (1 << 16))).withColumnRenamed("at", "byte_no"),
    """WITH f AS (SELECT l_orderkey % 64 AS stream_id, l_partkey % 8 AS v, 3 * (row_number() OVER (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS p FROM lineitem),
    t AS (SELECT stream_id, (p + i) // 8 AS byte_no, (v >> i & 1) << ((p + i) % 8) AS bit FROM f, range(3) r(i)) SELECT stream_id, byte_no::BIGINT AS byte_no, sum(bit)::INT AS value FROM t GROUP BY ALL""",
)

# --- whole files ---
for _name in ("fast", "balanced", "max"):

    def png_back(spark: SparkSession, sf: str, name: str = _name) -> DataFrame:
        files = png.encode_png(views.binary_images(views.images(spark, sf)), preset(name))
        return png.decode_png(files).select("image_id", joined(B.bytes_of(F.col("pixels"))).alias("pixels"))

    register(f"png_round_trip_{_name}", png_back, PIXELS_SQL)


def png_chunks(spark: SparkSession, sf: str) -> DataFrame:
    files = png.encode_png(views.binary_images(views.images(spark, sf)), preset("balanced"))
    return png.chunks(files).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda x: x["type"]), ",").alias("types"), F.bool_and("crc_ok").alias("crc_ok"))


register("png_chunks", png_chunks, "SELECT vec_id AS image_id, 'IHDR,IDAT,IEND' AS types, true AS crc_ok FROM embeddings")
register("png_indexed", lambda s, d: png.decode_png(png.encode_png(views.binary_images(views.images(s, d)), preset("lossy", 16))).select("image_id", "width", "height", "color_type"), "SELECT vec_id AS image_id, 8 AS width, 8 AS height, 2 AS color_type FROM embeddings")
register("png_sizes", lambda s, d: png.encode_png(views.binary_images(views.opaque_images(s, d)), preset("max")).select("image_id", "n_bytes", "error"))

# --- jobs ---
register(
    "job_kinds",
    lambda s, d: views.jobs(s, d).select("id", (k := labels.file_kind(F.col("mime"), F.col("name"))).alias("kind"), labels.kind_text(k).alias("kind_text"), labels.status_text(F.col("status"), F.col("error")).alias("status_text"), labels.output_name(F.col("name")).alias("output")),
    f"""WITH {JOBS}, k AS (SELECT *, CASE WHEN mime LIKE '%png%' OR name LIKE '%.png' THEN 'png' WHEN mime LIKE '%jpeg%' OR mime LIKE '%jpg%' OR name LIKE '%.jpg' OR name LIKE '%.jpeg' THEN 'jpeg' ELSE 'unknown' END AS kind FROM j)
    SELECT id, kind, CASE kind WHEN 'png' THEN 'PNG' WHEN 'jpeg' THEN 'JPEG' ELSE 'Unknown' END AS kind_text,
    CASE status WHEN 'error' THEN 'Error: ' || error WHEN 'pending' THEN 'Pending' WHEN 'decoding' THEN 'Decoding...' WHEN 'compressing' THEN 'Compressing...' ELSE 'Done' END AS status_text, 'file' || id || '.png' AS output FROM k""",
)
PERCENT = "(original_bytes - compressed_bytes) / original_bytes::DOUBLE * 100.0"
register(
    "job_savings",
    lambda s, d: views.jobs(s, d).where("status = 'done'").select("id", labels.format_size(F.col("original_bytes")).alias("size"), F.round(labels.percent_saved(F.col("original_bytes"), F.col("compressed_bytes")), 6).alias("percent"), F.round(labels.savings(F.col("original_bytes"), F.col("compressed_bytes")), 6).alias("savings"), labels.savings_class(labels.percent_saved(F.col("original_bytes"), F.col("compressed_bytes"))).alias("class")),
    f"WITH {JOBS} SELECT id, {size_sql('original_bytes')} AS size, round({PERCENT}, 6) AS percent, CASE WHEN {PERCENT} > 0 THEN round({PERCENT}, 6) END AS savings, CASE WHEN {PERCENT} >= 30 THEN 'green' WHEN {PERCENT} >= 10 THEN 'yellow' ELSE 'gray' END AS class FROM j WHERE status = 'done'",
)
register("job_sizes", lambda s, d: views.table(s, d, "orders").select("o_orderkey", labels.format_size((F.col("o_totalprice") * 37).cast("long")).alias("size")), f"WITH o AS (SELECT o_orderkey, trunc(o_totalprice * 37)::BIGINT AS n FROM orders) SELECT o_orderkey, {size_sql('n')} AS size FROM o")
register("job_summary", lambda s, d: jobs.summary(views.jobs(s, d)), f"WITH {JOBS} SELECT session, count(*) AS n_jobs, bool_or(status = 'pending') AS any_pending, bool_or(status = 'done') AS any_done, coalesce(sum(original_bytes - compressed_bytes) FILTER (status = 'done'), 0)::BIGINT AS bytes_saved FROM j GROUP BY session")
register("job_downloads", lambda s, d: jobs.downloads(views.jobs(s, d)), f"WITH {JOBS} SELECT session, id, 'compressed_' || name AS file, ((row_number() OVER (PARTITION BY session ORDER BY id) - 1) * 100)::INT AS delay_ms FROM j WHERE status = 'done' AND compressed_bytes IS NOT NULL")
register("job_pasted", lambda s, d: jobs.pasted(views.jobs(s, d)).select("id", "name"), f"WITH {JOBS} SELECT id, name FROM j WHERE mime LIKE 'image/%'")
register(
    "job_latest",
    lambda s, d: jobs.latest(views.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))),
    "SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
)
register(
    "job_updates",
    lambda s, d: jobs.updated(views.jobs(s, d), views.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "done").alias("status"))).select("id", "status", "error"),
    f"WITH {JOBS} SELECT j.id, CASE WHEN l.quality = 1 THEN 'done' ELSE j.status END AS status, j.error FROM j LEFT JOIN labels l ON l.doc_id = j.id",
)
register("job_removal", lambda s, d: jobs.without(views.jobs(s, d), views.table(s, d, "labels").select(F.col("doc_id").alias("id"))).select("id", "name"), f"WITH {JOBS} SELECT id, name FROM j WHERE id NOT IN (SELECT doc_id FROM labels)")
register(
    "setting_names",
    lambda s, d: views.table(s, d, "part").select("p_partkey", labels.color_choice(F.col("p_size") * 8).cast("int").alias("colors"), labels.color_choice_label(F.col("p_size") * 8).alias("label"), labels.preset_of_number(F.col("p_size") % 4).alias("preset")),
    "SELECT p_partkey, (CASE WHEN p_size * 8 IN (8, 16, 32, 64, 128, 256) THEN p_size * 8 ELSE 0 END)::INT AS colors, CASE WHEN p_size * 8 IN (8, 16, 32, 64, 128, 256) THEN (p_size * 8)::VARCHAR || ' colors' ELSE 'Lossless' END AS label, CASE p_size % 4 WHEN 0 THEN 'max' WHEN 2 THEN 'fast' ELSE 'balanced' END AS preset FROM part",
)


# --- palettes as chunks, and small parts ---
def common_palettes(spark: SparkSession, sf: str) -> DataFrame:
    """The sixteen most frequent colors of each image, in order."""
    ranked = color.ranked_colors(color.count_colors(views.color_points(spark, sf))).where("rank <= 16")
    ordered = ranked.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "r", "g", "b"))).alias("c"))
    return ordered.select("image_id", F.transform("c", lambda x: F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"))).alias("palette"))


TOP16 = COUNTS + ", o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM cnt), top AS (SELECT * FROM o WHERE k <= 16)"
register(
    "palette_chunks",
    lambda s, d: common_palettes(s, d).select("image_id", F.hex(png.chunk_column(F.lit("PLTE"), png.plte_data(F.col("palette")))).alias("chunk")),
    f"""WITH {TOP16}, h AS (SELECT image_id, '504C5445' || string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY k) AS body FROM top GROUP BY image_id),
    s AS (SELECT image_id, body, list_transform(regexp_extract_all(body, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM h)
    SELECT image_id, printf('%08X', len(body) // 2 - 4) || body || printf('%08X', {CRC}) AS chunk FROM s""",
)
register(
    "transparency_chunks",
    lambda s, d: views.opaque_images(s, d).select("image_id", F.hex(png.chunk_column(F.lit("tRNS"), png.trns_data(F.filter("pixels", lambda v, i: i % 4 == 3)))).alias("chunk")),
    f"""WITH {RGBA}, h AS (SELECT image_id, '74524E53' || array_to_string(list_transform(list_filter(px, lambda v, i: (i - 1) % 4 = 3), lambda v: printf('%02X', v)), '') AS body FROM rgba),
    s AS (SELECT image_id, body, list_transform(regexp_extract_all(body, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM h)
    SELECT image_id, '00000010' || body || printf('%08X', {CRC}) AS chunk FROM s""",
)


def palette_access(spark: SparkSession, sf: str) -> DataFrame:
    """A color more where the palette has room for it, and the entry at the image's number."""
    grey = F.struct(F.lit(9).alias("r"), F.lit(9).alias("g"), F.lit(9).alias("b"))
    more, at = color.add_color(F.col("palette"), grey, 16)
    found = color.get_color(F.col("palette"), (F.col("image_id") % 20).cast("int"))
    return common_palettes(spark, sf).select("image_id", F.size(more).alias("size"), at.alias("place"), found["r"].alias("r"), found["g"].alias("g"), found["b"].alias("b"))


register(
    "palette_access",
    palette_access,
    f"WITH {TOP16}, z AS (SELECT image_id, least(16, count(*) + 1)::INT AS size, (CASE WHEN count(*) >= 16 THEN -1 ELSE count(*) END)::INT AS place FROM top GROUP BY image_id) SELECT z.image_id, size, place, coalesce(t.r, 0) AS r, coalesce(t.g, 0) AS g, coalesce(t.b, 0) AS b FROM z LEFT JOIN top t ON t.image_id = z.image_id AND t.k = z.image_id % 20 + 1",
)
register(
    "last_nonzero",
    lambda s, d: views.images(s, d).select("image_id", F.posexplode("pixels").alias("i", "v")).groupBy("image_id").agg(F.coalesce(F.max(F.when(F.col("v") > 150, F.col("i"))), F.lit(0)).alias("last")),
    f"WITH {IMG} SELECT image_id, coalesce(list_max(list_filter(range(64), lambda i: px[i + 1] > 150)), 0)::INT AS last FROM img",
)
register(
    "capabilities",
    lambda s, d: s.range(1).select(F.lit(256).alias("most_colors"), F.lit(True).alias("dithering"), F.lit(",".join(p[0] for p in dims.PRESETS)).alias("presets")),
    "SELECT 256 AS most_colors, true AS dithering, 'fast,balanced,max,lossy,builder_fast' AS presets",
)
register("coarse_distances", lambda s, d: coarse_distances(views.byte_streams(s, d), 2))
# every third page has a signature before its text
register(
    "signatures",
    lambda s, d: views.page_streams(s, d).select("stream_id", png.has_signature(F.when(F.col("stream_id") % 3 == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), "data")).otherwise(F.col("data"))).alias("png")),
    "SELECT page_id AS stream_id, page_id % 3 = 0 AS png FROM pages",
)
register(
    "jobs_appended",
    lambda s, d: jobs.appended(jobs.new_jobs(views.jobs(s, d)), jobs.new_jobs(views.jobs(s, d).withColumn("id", -F.col("id") - 1))).select("id", "name", "kind", "status", "original_bytes", F.col("compressed_bytes").isNull().alias("open")),
    f"""WITH {JOBS}, k AS (SELECT id, name, CASE WHEN mime LIKE '%png%' OR name LIKE '%.png' THEN 'png' WHEN mime LIKE '%jpeg%' OR name LIKE '%.jpg' THEN 'jpeg' ELSE 'unknown' END AS kind, 'pending' AS status, original_bytes::BIGINT AS original_bytes, true AS open FROM j)
    SELECT * FROM k UNION ALL SELECT -id - 1, name, kind, status, original_bytes, open FROM k""",
)


# --- diffusion, pixel by pixel, on the gray images ---
CLIP = "least(255, greatest(0, {}))"
SIX_GRAYS = "src AS (SELECT image_id, px, [40, 80, 110, 128, 150, 200] AS pal FROM img)"
GRAY_AT = "(list_aggregate(list_transform(pal, lambda p, k: abs(v - p) * 10 + k - 1), 'min') % 10)"


def cut_sql(weight: int, of: int) -> str:
    return f"(sign(err) * (abs(err) * {weight} // {of}))::INT"


def steps_sql(state: str, start: str, change: str, src: str, more: str = "") -> str:
    """A recursion over an image's 64 pixels: state's columns start as given and change by v, the pixel's value with what it
    waits for, near, its palette index, and err, what is left. src is the CTE of image_id, px and pal, a list of grays."""
    own = "e0" if "e0" in state else "above[i % 8 + 1]"
    return f"""WITH RECURSIVE {IMG}, {src}, d AS (SELECT image_id, px, pal, 0 AS i, {start}, []::INT[] AS out FROM src UNION ALL
    SELECT image_id, px, pal, i + 1, {change}, list_append(out, near::INT) FROM (SELECT *, v - pal[near + 1] AS err FROM
      (SELECT *, {GRAY_AT} AS near FROM (SELECT *, {CLIP.format(f"px[i + 1] + {own}")} AS v FROM d WHERE i < 64))))
    SELECT image_id, array_to_string(out, ',') AS indices{more} FROM d WHERE i = 64"""


def line_sql(weights: tuple[int, ...], of: int, carry: bool, src: str = SIX_GRAYS, more: str = "") -> str:
    moved = [f"{f'e{k + 1} + ' if k < 3 else ''}{cut_sql(w, of) if w else 0}" for k, w in enumerate((*weights, 0, 0, 0, 0)[:4])]
    moved = [CLIP.format(x) if carry and k == 0 else x for k, x in enumerate(moved)]
    names_ = [f"e{k}" for k in range(4)]
    return steps_sql(", ".join(names_), ", ".join(f"0 AS {n}" for n in names_), ", ".join(f"({x})::INT" for x in moved), src, more)


_SQL["dither_floyd_steinberg"] = line_sql((7, 1), 16, False)
_SQL["dither_jarvis"] = line_sql((7, 5, 3, 1), 48, False)
_SQL["dither_encoder"] = line_sql((7,), 16, True)
BELOW = f"list_transform(below, lambda b, k: CASE k - 1 - i % 8 WHEN 0 THEN {cut_sql(3, 16)} WHEN 1 THEN {CLIP.format(f'b + CASE WHEN i % 8 < 7 THEN {cut_sql(7, 16)} ELSE 0 END')} WHEN 2 THEN b + CASE WHEN i % 8 < 6 THEN {cut_sql(5, 16)} ELSE 0 END ELSE b END)"
NONE_YET = "list_transform(range(10), lambda z: 0)"
_SQL["dither_floyd_steinberg_rows"] = steps_sql(
    "above, below", f"{NONE_YET} AS above, {NONE_YET} AS below", f"CASE WHEN i % 8 = 7 THEN {BELOW} ELSE above END, CASE WHEN i % 8 = 7 THEN {NONE_YET} ELSE {BELOW} END", SIX_GRAYS
)


def cut_boxes_sql(most: int) -> str:
    """CTEs from cnt(image_id, r, g, b, n) to cut(image_id, idx, r, g, b): boxes as lists, the first longest halved in each step."""
    return f"""start AS (SELECT image_id, [list({{'r': r, 'g': g, 'b': b, 'n': n}} ORDER BY n DESC, r, g, b)] AS boxes FROM cnt GROUP BY image_id),
    few AS (SELECT image_id, list_transform(boxes[1], lambda x: [x]) AS boxes FROM start WHERE len(boxes[1]) <= {most}),
    halved AS (SELECT image_id, boxes FROM start WHERE len(boxes[1]) > {most} UNION ALL
      SELECT image_id, list_append(list_transform(boxes, lambda x, i: CASE WHEN i = longest THEN along[: len(along) // 2] ELSE x END), along[len(along) // 2 + 1 :]) FROM
      (SELECT *, list_transform(list_sort(list_transform(own, lambda x, i: {{'v': CASE WHEN wr >= wg AND wr >= wb THEN x.r WHEN wg >= wb THEN x.g ELSE x.b END, 'i': i, 'x': x}})), lambda y: y.x) AS along FROM
      (SELECT *, {", ".join(f"list_max(list_transform(own, lambda x: x.{c})) - list_min(list_transform(own, lambda x: x.{c})) AS w{c}" for c in "rgb")} FROM
      (SELECT *, boxes[longest] AS own FROM
      (SELECT *, list_position(list_transform(boxes, lambda x: len(x)), list_max(list_transform(boxes, lambda x: len(x)))) AS longest FROM halved WHERE len(boxes) < {most}))))),
    boxed AS (SELECT image_id, unnest(range(len(boxes))) AS idx, unnest(boxes) AS box FROM (FROM few UNION ALL SELECT * FROM halved WHERE len(boxes) = {most})),
    cut AS (SELECT image_id, idx::INT AS idx, {", ".join(f"(list_sum(list_transform(box, lambda x: x.{c} * x.n)) // list_sum(list_transform(box, lambda x: x.n)))::INT AS {c}" for c in "rgb")} FROM boxed)"""


GRAY_COUNTS = "cnt AS (SELECT image_id, v AS r, v AS g, v AS b, count(*) AS n FROM (SELECT image_id, unnest(px) AS v FROM img) GROUP BY ALL)"
OWN_GRAYS = "src AS (SELECT img.image_id, px, pal FROM img JOIN (SELECT image_id, list(r ORDER BY idx) AS pal FROM cut GROUP BY image_id) c ON c.image_id = img.image_id)"
PAL_TEXT = "array_to_string(flatten(list_transform(pal, lambda p: [p, p, p])), ',') AS palette"
_SQL["median_cut"] = f"WITH RECURSIVE {COUNTS}, {cut_boxes_sql(16)} SELECT * FROM cut"
_SQL["quantize_16"] = f"""WITH RECURSIVE {IMG}, {GRAY_COUNTS}, {cut_boxes_sql(16)}, {OWN_GRAYS}
    SELECT image_id, array_to_string(list_transform(px, lambda v: list_min(list_transform(pal, lambda p, k: abs(v - p) * 100 + k - 1)) % 100), ',') AS indices, {PAL_TEXT} FROM src"""
_SQL["quantized_error"] = f"""WITH RECURSIVE {IMG}, {GRAY_COUNTS}, {cut_boxes_sql(16)}, {OWN_GRAYS}
    SELECT image_id, list_sum(list_transform(px, lambda v: list_min(list_transform(pal, lambda p: (v - p) * (v - p)))))::DOUBLE / 64 AS error FROM src"""
_SQL["quantize_dithered"] = line_sql((7,), 16, True, f"{GRAY_COUNTS}, {cut_boxes_sql(8)}, {OWN_GRAYS}", f", {PAL_TEXT}")


def mapped_error(spark: SparkSession, sf: str) -> DataFrame:
    """The mean squared distance of each gray image from itself in six grays."""
    images = views.images(spark, sf)
    grays = F.array(*(F.lit(int(v)) for v in GRAYS.ravel()))
    return quantize.mean_error(quantize.dither(images, GRAYS, "threshold").withColumn("palette", grays), images)


register("mapped_error", mapped_error, f"WITH {IMG} SELECT image_id, list_sum(list_transform(px, lambda v: list_min(list_transform([40, 80, 110, 128, 150, 200], lambda p: (v - p) * (v - p)))))::DOUBLE / 64 AS error FROM img")


def indexed_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Images of sixteen levels through files with a palette, and back as r, g, b."""
    coarse = views.images(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v / 16).cast("int")))
    back = png.decode_png(png.encode_png(views.binary_images(coarse), preset("lossy", 16)))
    return back.select("image_id", "color_type", joined(B.bytes_of(F.col("pixels"))).alias("pixels"))


register("png_indexed_pixels", indexed_pixels, f"WITH {IMG} SELECT image_id, 2 AS color_type, array_to_string(flatten(list_transform(px, lambda v: [v // 16, v // 16, v // 16])), ',') AS pixels FROM img")


# --- codes: cost, runs, ranges ---
def huffman_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of each text by its own code, of any length."""
    coded = huffman.code_table(literal_frequencies(spark, sf).withColumn("alphabet", F.lit("literal")), 64)
    return coded.groupBy("stream_id").agg(F.sum(F.col("freq") * F.col("length")).alias("bits"))


register(
    "huffman_cost",
    huffman_cost,
    f"""WITH RECURSIVE {BYTES}, e AS (SELECT stream_id, unnest(list_append(b, 256)) AS v FROM s), f AS (SELECT stream_id, v, count(*) AS n FROM e GROUP BY ALL),
    h AS (SELECT stream_id, list_sort(list(n)) AS q, CASE WHEN count(*) = 1 THEN sum(n) ELSE 0 END::BIGINT AS bits FROM f GROUP BY stream_id
      UNION ALL SELECT stream_id, list_sort(list_append(q[3:], q[1] + q[2])), bits + q[1] + q[2] FROM h WHERE len(q) > 1)
    SELECT stream_id, bits FROM h WHERE len(q) = 1""",
)


def run_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of the images' values at two levels, above 150 or not, as symbols with their extra bits."""
    lengths = views.images(spark, sf).select(F.col("image_id").alias("stream_id"), F.lit("literal").alias("alphabet"), F.posexplode(F.transform("pixels", lambda v: F.when(v > 110, 0).otherwise(7))).alias("symbol", "length"))
    return huffman.length_runs(lengths).drop("alphabet")


ONE_RUN = "{{'symbol': {}, 'repeat': {}}}"
register(
    "length_run_symbols",
    run_symbols,
    f"""WITH {IMG}, v AS (SELECT image_id AS stream_id, i, CASE WHEN px[i] > 110 THEN 0 ELSE 7 END AS x, CASE WHEN px[i - 1] > 110 THEN 0 ELSE 7 END AS before FROM img, range(1, 65) t(i)),
    g AS (SELECT *, sum((i = 1 OR x <> before)::INT) OVER (PARTITION BY stream_id ORDER BY i) AS island FROM v),
    r AS (SELECT stream_id, x, min(i) - 1 AS start, count(*) AS n FROM g GROUP BY stream_id, x, island),
    p AS (SELECT stream_id, start, CASE WHEN x = 0 THEN CASE WHEN n >= 11 THEN [{ONE_RUN.format(18, "n")}] WHEN n >= 3 THEN [{ONE_RUN.format(17, "n")}] ELSE list_transform(range(n), lambda k: {ONE_RUN.format("0::BIGINT", "1::BIGINT")}) END
      ELSE list_concat([{ONE_RUN.format("x::BIGINT", "1::BIGINT")}], list_transform(range((n - 1) // 6), lambda k: {ONE_RUN.format("16::BIGINT", "6::BIGINT")}),
        CASE WHEN (n - 1) % 6 >= 3 THEN [{ONE_RUN.format("16::BIGINT", "(n - 1) % 6")}] ELSE list_transform(range((n - 1) % 6), lambda k: {ONE_RUN.format("x::BIGINT", "1::BIGINT")}) END) END AS parts FROM r),
    u AS (SELECT stream_id, start, unnest(range(len(parts))) AS part, unnest(parts) AS q FROM p)
    SELECT stream_id, start::INT AS start, part::INT AS part, q.symbol::INT AS symbol, q.repeat::INT AS repeat, (CASE q.symbol WHEN 18 THEN q.repeat - 11 WHEN 17 THEN q.repeat - 3 WHEN 16 THEN q.repeat - 3 ELSE 0 END)::INT AS extra,
      (CASE q.symbol WHEN 18 THEN 7 WHEN 17 THEN 3 WHEN 16 THEN 2 ELSE 0 END)::INT AS extra_bits FROM u""",
)
register(
    "header_counts",
    lambda s, d: views.table(s, d, "part").select("p_partkey", deflate.header_counts_error(F.col("p_partkey") % 40 + 250, F.col("p_size") % 33, F.col("p_partkey") % 21).alias("error")),
    "SELECT p_partkey, CASE WHEN p_partkey % 40 + 250 NOT BETWEEN 257 AND 286 THEN 'literal codes' WHEN p_size % 33 NOT BETWEEN 1 AND 30 THEN 'distance codes' WHEN p_partkey % 21 NOT BETWEEN 4 AND 19 THEN 'length codes' END AS error FROM part",
)
register(
    "coded_lengths",
    lambda s, d: huffman.coded(views.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 256 + 3).alias("length")), "length", dims.dim_length_code(s)),
    f"WITH p AS (SELECT p_partkey, p_partkey % 256 + 3 AS length FROM part) SELECT p_partkey, length, {LENGTH_CODE}::INT AS code, (CASE WHEN length < 11 THEN 0 ELSE (length - 3) & ((1 << {LENGTH_EXTRA}) - 1) END)::BIGINT AS extra, {LENGTH_EXTRA}::INT AS extra_bits FROM p",
)
DISTANCE_EXTRA = "(CASE WHEN distance < 5 THEN 0 ELSE floor(log2(distance - 1))::INT - 1 END)"
register(
    "coded_distances",
    lambda s, d: huffman.coded(views.table(s, d, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 32768 + 1).alias("distance")), "distance", dims.dim_distance_code(s)),
    f"WITH p AS (SELECT p_partkey, p_partkey * 7919 % 32768 + 1 AS distance FROM part) SELECT p_partkey, distance, {DISTANCE_CODE}::INT AS code, ((distance - 1) & ((1 << {DISTANCE_EXTRA}) - 1))::BIGINT AS extra, {DISTANCE_EXTRA}::INT AS extra_bits FROM p",
)


# --- the sliding window, and names for SQL ---
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """What a window of 1500 bytes holds before each 1000 bytes of a text."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("data") / 1000).cast("int"))).alias("seq")
    window = matching.window_before(F.col("data"), F.col("seq") * 1000, 1500)
    return views.byte_streams(spark, sf).select("stream_id", "data", at).select("stream_id", "seq", F.octet_length(window).alias("n_bytes"), F.md5(F.hex(window)).alias("md5"))


register(
    "sliding_windows",
    sliding_windows,
    "WITH e AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT stream_id, unnest(range(len(h) // 2000 + 1)) AS seq, h FROM e), x AS (SELECT stream_id, seq, substr(h, greatest(0, seq * 1000 - 1500) * 2 + 1, least(seq * 1000, 1500) * 2) AS w FROM w) SELECT stream_id, seq::INT AS seq, (len(w) // 2)::INT AS n_bytes, md5(w) AS md5 FROM x",
)


def window_matches(spark: SparkSession, sf: str) -> DataFrame:
    at = image_streams(spark, sf).select("stream_id", "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 3)).alias("pos"))
    return matching.window_matches(at.select("stream_id", "pos", matching.window_before(F.col("data"), F.col("pos")).alias("window"), F.expr("substring(data, pos + 1)").alias("ahead")))


register(
    "window_matches",
    window_matches,
    f"""WITH {IMG}, {IMAGE_STREAMS}, c AS (SELECT stream_id, b, p, q FROM s, range(64) t(p), range(64) u(q) WHERE q < p AND p <= 61),
    m AS (SELECT stream_id, p, p - q AS far, least(p - q, coalesce(list_min(list_filter(range(64 - p), lambda i: b[p + i + 1] <> b[q + i + 1])), 64 - p)) AS n FROM c)
    SELECT stream_id, p::INT AS pos, max(n)::INT AS length, (100 - max(n * 100 + 100 - far) % 100)::INT AS distance FROM m WHERE n >= 3 GROUP BY stream_id, p""",
)


def tokens_by_name(spark: SparkSession, sf: str) -> DataFrame:
    names.register(spark)
    return spark.sql("SELECT s.stream_id, t.pos, coalesce(t.literal, -1) AS literal, coalesce(t.length, 0) AS length, coalesce(t.distance, 0) AS distance FROM {streams} s, LATERAL deflate_tokens(s.data, 1) t", streams=image_streams(spark, sf))


register("tokens_by_name", tokens_by_name, f"{PARSE_SQL} SELECT stream_id, pos::INT AS pos, (CASE WHEN length IS NULL THEN literal ELSE -1 END)::INT AS literal, coalesce(length, 0)::INT AS length, coalesce(distance, 0)::INT AS distance FROM tok")


def checksums_by_name(spark: SparkSession, sf: str) -> DataFrame:
    names.register(spark)
    return spark.sql("SELECT stream_id, adler32(data) AS adler32, cast(size(trigram_hashes(data)) AS bigint) AS n_hashes FROM {streams}", streams=views.page_streams(spark, sf))


register("checksums_by_name", checksums_by_name, f"WITH {PAGE_BYTES} SELECT stream_id, {ADLER} AS adler32, greatest(0, len(b) - 2)::BIGINT AS n_hashes FROM s")

# --- settings, states and messages ---
register(
    "preset_settings",
    lambda s, d: jobs.with_settings(views.table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("fast", "balanced", "max", "lossy", "unknown"))), F.col("p_size") % 6).alias("preset"))),
    """WITH d(preset, level, strategy, optimize_alpha, reduce_color, optimal) AS (VALUES ('fast', 2, 'minsum', false, false, false), ('balanced', 6, 'adaptive', true, true, false), ('max', 9, 'minsum', true, true, true), ('lossy', 9, 'minsum', true, false, true)),
    p AS (SELECT p_partkey, (['fast', 'balanced', 'max', 'lossy', 'balanced', 'balanced'])[p_size % 6 + 1] AS preset FROM part) SELECT p_partkey, d.* FROM p JOIN d USING (preset)""",
)


def setting_flags(spark: SparkSession, sf: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("smaller", "balanced", "faster", "else"))), F.col("p_size") % 4)
    return views.table(spark, sf, "part").select("p_partkey", labels.preset_label(name).alias("label"), F.coalesce(labels.preset_number(name), F.lit(-1)).alias("number"), labels.is_lossless(F.col("p_size") * 8).alias("lossless"))


register(
    "setting_flags",
    setting_flags,
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Smaller' WHEN 1 THEN 'Balanced' WHEN 2 THEN 'Faster' END AS label, (CASE WHEN p_size % 4 < 3 THEN p_size % 4 ELSE -1 END)::INT AS number, p_size * 8 NOT IN (8, 16, 32, 64, 128, 256) AS lossless FROM part",
)
register(
    "palette_alphas",
    lambda s, d: common_palettes(s, d).select("image_id", color.palette_has_alpha(F.col("palette")).alias("has_alpha"), joined(color.palette_alphas(F.col("palette"))).alias("alphas")),
    f"WITH {TOP16} SELECT image_id, false AS has_alpha, string_agg('255', ',') AS alphas FROM top GROUP BY image_id",
)


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    j = views.jobs(spark, sf)
    return jobs.transitions(j.select("id", labels.file_kind(F.col("mime"), F.col("name")).alias("kind"), F.when(F.col("id") % 10 == 4, "unreadable").alias("unread"), F.when(F.col("id") % 10 == 9, "too large").alias("error")))


register(
    "job_transitions",
    job_transitions,
    f"""WITH {JOBS}, k AS (SELECT id, CASE WHEN mime LIKE '%png%' OR name LIKE '%.png' THEN CASE id % 10 WHEN 4 THEN 'pending,decoding,error' WHEN 9 THEN 'pending,decoding,compressing,error' ELSE 'pending,decoding,compressing,done' END
      WHEN mime LIKE '%jpeg%' OR name LIKE '%.jpg' THEN 'pending,decoding,error' ELSE 'pending,error' END AS way FROM j),
    t AS (SELECT id, string_split(way, ',') AS w FROM k) SELECT id, unnest(range(len(w)))::INT AS seq, unnest(w) AS status FROM t""",
)


def worker_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages: every ninth an init, some of no known type, some without an id, some that fail."""
    e = F.col("event_id")
    kind = F.when(e % 9 == 0, "init").when(e % 9 == 8, "else").otherwise("compress")
    return jobs.replies(views.table(spark, sf, "events").select(F.col("user_id").alias("session"), e.alias("seq"), kind.alias("type"), F.when(e % 11 != 0, e.cast("string")).alias("id"), F.when(e % 13 == 0, "bad pixels").alias("failed")))


register(
    "worker_replies",
    worker_replies,
    """WITH m AS (SELECT user_id AS session, event_id AS seq, event_id % 9 AS k, min(CASE WHEN event_id % 9 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS ready FROM events),
    a AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN seq % 11 = 0 THEN 'invalid compress message' WHEN ready IS NULL OR ready > seq THEN 'not initialized' WHEN seq % 13 = 0 THEN 'bad pixels' END AS error FROM m WHERE k <> 8)
    SELECT session, seq, CASE WHEN error IS NOT NULL THEN 'error' WHEN k = 0 THEN 'ready' ELSE 'compressed' END AS type, CASE WHEN k <> 0 AND seq % 11 <> 0 THEN seq::VARCHAR END AS id, error FROM a""",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
