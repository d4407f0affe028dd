"""Queries over the driver's tables, one or more for each family of operators, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.functions import argb, riff, sql
from rastra.functions.bits import le_bytes
from rastra.operators import animation, batch, container, lossy, pixels, transforms
from rastra.sources import images
from rastra.streaming import arrivals, incremental
from rastra.plans.raster import ARGB, FRAMES_SQL, LINES_SQL, LUMA_SQL, PAGES_SQL, PX_SQL, embedding_pixels, event_frames, line_pixels, luma_planes, page_files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ARGB_SQL = f"pa AS (SELECT img, x, y, a, r, g, b, {ARGB} AS argb FROM px)"
NEAR_SQL = """ne AS (SELECT *, lag(argb) OVER (PARTITION BY img, y ORDER BY x) AS l, lag(argb) OVER (PARTITION BY img, x ORDER BY y) AS t FROM pa)"""


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


# --- files and chunks -------------------------------------------------------------------------------------------


@query(f"WITH {PAGES_SQL} SELECT fourcc, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ck GROUP BY fourcc")
def chunk_summary(spark, sf_dir):
    return container.chunks(page_files(spark, sf_dir)).groupBy("fourcc").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {PAGES_SQL} SELECT * FROM ck")
def chunk_table(spark, sf_dir):
    return container.chunks(page_files(spark, sf_dir)).select("path", "idx", "fourcc", "payload_start", "size")


@query(f"WITH {PAGES_SQL} SELECT path, idx, fourcc, payload_start + size > 64 AS truncated FROM ck WHERE payload_start <= 64")
def lenient_scan(spark, sf_dir):
    cut = page_files(spark, sf_dir).withColumn("content", F.substring("content", 1, 64))
    return container.chunks(cut, lenient=True).select("path", "idx", "fourcc", "truncated")


@query(f"WITH {PAGES_SQL} SELECT path, 46 + image + image % 2 + exif + exif % 2 AS declared_length, 46 + image + image % 2 + exif + exif % 2 <= 1000 AS is_complete FROM pg")
def completeness(spark, sf_dir):
    return container.completeness(page_files(spark, sf_dir).withColumn("content", F.substring("content", 1, 1000)))


@query(f"WITH {PAGES_SQL} SELECT path, CAST(w AS INT) AS width, CAST(h AS INT) AS height, 'lossless' AS codec, alpha AS has_alpha, true AS has_metadata, false AS is_animated, CAST(NULL AS VARCHAR) AS error FROM pg")
def probe(spark, sf_dir):
    return container.images(page_files(spark, sf_dir))


@query("SELECT page_id AS path, true AS no_icc, coalesce(url, '') AS exif, true AS no_xmp FROM pages")
def metadata_read(spark, sf_dir):
    found = container.metadata(page_files(spark, sf_dir))
    return found.select("path", F.col("icc").isNull().alias("no_icc"), F.decode("exif", "UTF-8").alias("exif"), F.col("xmp").isNull().alias("no_xmp"))


@query(f"""WITH {PAGES_SQL}, s AS (SELECT path, 'ICCP' AS fourcc, 1 AS idx, CAST(3 AS BIGINT) AS size FROM pg UNION ALL SELECT path, 'VP8L', 2, image FROM pg
UNION ALL SELECT path, 'XMP ', 3, CAST(6 AS BIGINT) FROM pg UNION ALL SELECT path, 'VP8X', 0, CAST(10 AS BIGINT) FROM pg) SELECT path, idx, fourcc, size FROM s""")
def metadata_rewrite(spark, sf_dir):
    files = page_files(spark, sf_dir)
    null = F.lit(None).cast("binary")
    edited = container.with_metadata(files, F.lit(b"icc"), null, F.lit(b"<xmp/>"), F.lit(1), F.lit(1))
    return container.chunks(edited).select("path", "idx", "fourcc", "size")


@query(f"WITH {PAGES_SQL} SELECT path, 'extended' AS container, CAST(3 AS INT) AS n_chunks, CAST(w AS BIGINT) AS width FROM pg")
def inspect_report(spark, sf_dir):
    found = container.report(page_files(spark, sf_dir))
    return found.select("path", "container", F.json_array_length(F.get_json_object("json", "$.chunks")).alias("n_chunks"), F.get_json_object("json", "$.width").cast("long").alias("width"))


@query("SELECT p_partkey, p_size AS width, CAST(p_partkey % 16383 + 1 AS BIGINT) AS height, p_partkey % 3 = 0 AS has_alpha FROM part")
def lossless_header(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    head = riff.vp8l_header(F.col("p_size"), F.pmod("p_partkey", F.lit(16383)) + 1, F.pmod("p_partkey", F.lit(3)) == 0)
    read = part.select("p_partkey", riff.read_vp8l_header(head).alias("h"))
    return read.select("p_partkey", F.col("h.width").cast("int").alias("width"), F.col("h.height").alias("height"), "h.has_alpha")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS width, p_partkey % 16383 + 1 AS height, p_partkey % 500000 AS first_partition FROM part")
def lossy_header(spark, sf_dir):
    head = riff.vp8_header(F.col("p_size"), F.pmod("p_partkey", F.lit(16383)) + 1, F.pmod("p_partkey", F.lit(500000)))
    return table(spark, sf_dir, "part").select("p_partkey", riff.read_vp8_header(head).alias("h")).select("p_partkey", "h.width", "h.height", "h.first_partition")


# --- animations -------------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES_SQL} SELECT * FROM fr")
def frame_table(spark, sf_dir):
    return animation.frames(animation.write(event_frames(spark, sf_dir))).withColumn("payload", F.decode("payload", "UTF-8"))


@query(f"WITH {FRAMES_SQL} SELECT path, max(x + width) AS canvas_w, max(y + height) AS canvas_h, CAST(0 AS BIGINT) AS background, CAST(3 AS BIGINT) AS loop_count, count(*) AS frame_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM fr GROUP BY path")
def animation_probe(spark, sf_dir):
    return animation.animations(animation.write(event_frames(spark, sf_dir), loop_count=3))


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT path, frame_idx - CAST(frame_idx > 1 AS INT) AS frame_idx, duration_ms FROM fr WHERE frame_idx <> 1)
SELECT path, CAST(frame_idx + CAST(frame_idx >= 2 AS INT) AS INT) AS frame_idx, duration_ms FROM k UNION ALL
SELECT path, CAST(least(2, count(*)) AS INT), CAST(7 AS BIGINT) FROM k GROUP BY path""")
def frame_edits(spark, sf_dir):
    """Frame 1 goes, then a frame of 7 ms comes in before frame 2 (at the end of shorter animations)."""
    rows = animation.without_frame(event_frames(spark, sf_dir), 1)
    new = event_frames(spark, sf_dir).where("frame_idx = 0").withColumn("duration_ms", F.lit(7).cast("long"))
    return animation.with_frame(rows, new, 2).select("path", "frame_idx", "duration_ms")


@query(f"WITH {PX_SQL}, {ARGB_SQL}, d AS (SELECT n.img, n.x, n.y FROM pa n JOIN pa p ON n.img = p.img + 1 AND n.x = p.x AND n.y = p.y WHERE (n.argb >> 4) <> (p.argb >> 4)) SELECT img, CAST(min(x) - min(x) % 2 AS INT) AS x, CAST(min(y) - min(y) % 2 AS INT) AS y, CAST(max(x) - (min(x) - min(x) % 2) + 1 AS INT) AS width, CAST(max(y) - (min(y) - min(y) % 2) + 1 AS INT) AS height FROM d GROUP BY img")
def changed_boxes(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir).withColumn("argb", F.shiftright("argb", 4))
    box = animation.changed_boxes(px, px.withColumn("img", F.col("img") + 1))
    return box.select("img", *[F.col(c).cast("int").alias(c) for c in ("x", "y", "width", "height")])


@query(f"WITH {PX_SQL}, {ARGB_SQL}, d AS (SELECT n.img, n.x, n.y, CASE WHEN n.argb = p.argb THEN 0 ELSE n.argb END AS argb, n.argb = p.argb OR n.a = 255 AS fine FROM pa n JOIN pa p ON n.img = p.img + 1 AND n.x = p.x AND n.y = p.y) SELECT img, x, y, argb, bool_and(fine) OVER (PARTITION BY img) AS valid FROM d")
def blend_deltas(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    return animation.blend_deltas(px, px.withColumn("img", F.col("img") + 1))


@query(f"WITH {PX_SQL}, f AS (SELECT img - 1 AS img, x, y, CASE WHEN img % 4 = 0 THEN 0 ELSE a END AS a FROM px) SELECT px.img, CASE WHEN bool_or(px.a > 0) AND bool_and(coalesce(f.a = 0, false)) THEN 'background' ELSE 'keep' END AS dispose FROM px LEFT JOIN f USING (img, x, y) GROUP BY px.img")
def disposals(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    following = px.select((F.col("img") - 1).alias("img"), "x", "y", F.when(F.pmod("img", F.lit(4)) == 0, 0).otherwise(F.col("argb")).alias("argb"))
    return animation.disposals(px, following)


@query(f"WITH {PX_SQL}, {ARGB_SQL}, f AS (SELECT img // 5 AS img, img % 5 AS frame_idx, x, y, CASE WHEN r % 3 = 0 THEN 0 ELSE argb | 4278190080 END AS argb FROM pa) SELECT img, x, y, max_by(argb, frame_idx) AS argb FROM f WHERE argb >> 24 > 0 GROUP BY img, x, y")
def canvas_after_frames(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    drawn = F.when(F.pmod(argb.channel(F.col("argb"), "r"), F.lit(3)) == 0, F.lit(0).cast("long")).otherwise(argb.opaque(F.col("argb")))
    return animation.last_drawn(px.select(F.floor(F.col("img") / 5).alias("img"), F.pmod("img", F.lit(5)).alias("frame_idx"), "x", "y", drawn.alias("argb")))


@query(f"WITH {PX_SQL}, {ARGB_SQL}, f AS (SELECT img // 5 AS path, img % 5 AS frame_idx, y * 8 + x AS i, argb | 4278190080 AS argb FROM pa) SELECT path, CAST(frame_idx AS INT) AS frame_idx, CAST(sum(argb * (i + 1)) AS BIGINT) AS checksum FROM f GROUP BY path, frame_idx")
def composited_frames(spark, sf_dir):
    """Opaque full frames cover everything below: the fold must return the frames themselves."""
    px = embedding_pixels(spark, sf_dir).withColumn("argb", argb.opaque(F.col("argb")))
    flat = px.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "argb"))), lambda p: p["argb"]).alias("argb"))
    eight = {c: F.lit(8) for c in ("width", "height", "canvas_w", "canvas_h")}
    rows = flat.withColumns({"path": F.floor(F.col("img") / 5), "frame_idx": F.pmod("img", F.lit(5)), "x": F.lit(0), "y": F.lit(0), "duration_ms": F.lit(40), "blend": F.lit("blend"), "dispose": F.when(F.pmod("img", F.lit(2)) == 0, "keep").otherwise("background"), "has_alpha": F.lit(False), **eight})
    folded = animation.composited(rows)
    total = F.aggregate(F.transform("argb", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return folded.select("path", "frame_idx", total.alias("checksum"))


#: Five images make an animation on a canvas of 8 x 8: three of four are parts of it, some overwrite, some are disposed, some have alpha.
_PARTS_SQL = """al AS (SELECT img, bool_or(a < 255) AS has_alpha FROM px GROUP BY img),
fa AS (SELECT img // 5 AS path, CAST(img % 5 AS INT) AS idx, CASE WHEN img % 4 = 0 THEN 0 ELSE 2 * (img % 3) END AS x, CASE WHEN img % 4 = 0 THEN 0 ELSE 2 * (img % 2) END AS y, CASE WHEN img % 4 = 0 THEN 8 ELSE 4 END AS w, CASE WHEN img % 4 = 0 THEN 8 ELSE 6 END AS h,
  img % 3 = 0 AS overwrite, img % 7 < 3 AS dispose, has_alpha, pix FROM al JOIN (SELECT img, list(argb ORDER BY y, x) AS pix FROM pa GROUP BY img) USING (img)),
cv AS (WITH RECURSIVE c AS (SELECT path, -1 AS idx, list_transform(range(64), lambda i: CAST(0 AS BIGINT)) AS canvas, CAST(NULL AS BIGINT) AS cx, CAST(NULL AS BIGINT) AS cy, CAST(NULL AS BIGINT) AS cw, CAST(NULL AS BIGINT) AS ch, true AS next_key FROM (SELECT DISTINCT path FROM fa)
  UNION ALL SELECT path, idx, list_transform(range(64), lambda i: CASE WHEN i % 8 >= x AND i % 8 < x + w AND i // 8 >= y AND i // 8 < y + h
    THEN CASE WHEN key OR overwrite OR (cx IS NOT NULL AND i % 8 >= cx AND i % 8 < cx + cw AND i // 8 >= cy AND i // 8 < cy + ch) THEN pix[(i // 8 - y) * 8 + i % 8 - x + 1] ELSE {over} END
    ELSE CASE WHEN key THEN 0 ELSE below[i + 1] END END), CASE WHEN dispose THEN x END, CASE WHEN dispose THEN y END, CASE WHEN dispose THEN w END, CASE WHEN dispose THEN h END, dispose AND (w * h = 64 OR key)
  FROM (SELECT fa.*, cx, cy, cw, ch, next_key OR (fa.w * fa.h = 64 AND (fa.overwrite OR NOT fa.has_alpha)) AS key,
    list_transform(range(64), lambda i: CASE WHEN cx IS NOT NULL AND i % 8 >= cx AND i % 8 < cx + cw AND i // 8 >= cy AND i // 8 < cy + ch THEN 0 ELSE canvas[i + 1] END) AS below FROM c JOIN fa ON fa.path = c.path AND fa.idx = c.idx + 1)) SELECT * FROM c WHERE idx >= 0)"""


def _list_over_sql() -> str:
    """One pixel of a list drawn over another."""
    p, d = "pix[(i // 8 - y) * 8 + i % 8 - x + 1]", "below[i + 1]"
    a, rest = f"(({p} >> 24) & 255)", f"(((({d} >> 24) & 255) * (256 - (({p} >> 24) & 255))) >> 8)"
    c = lambda k: f"(((((({p} >> {k}) & 255) * {a} + (({d} >> {k}) & 255) * {rest}) * (16777216 // ({a} + {rest}))) >> 24) & 255)"
    return f"CASE WHEN {a} = 255 THEN {p} WHEN {a} = 0 THEN {d} ELSE (({a} + {rest}) << 24) | ({c(16)} << 16) | ({c(8)} << 8) | {c(0)} END"


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {_PARTS_SQL.format(over=_list_over_sql())} SELECT path, idx AS frame_idx, CAST(list_sum(list_transform(range(64), lambda i: canvas[i + 1] * (i + 1))) AS BIGINT) AS checksum FROM cv")
def composited_parts(spark, sf_dir):
    """The canvas after each frame, with parts, blending, overwriting, disposals and alpha."""
    px, n = embedding_pixels(spark, sf_dir), F.col("img")
    whole = F.pmod(n, F.lit(4)) == 0
    place = lambda k: F.when(whole, 0).otherwise(2 * F.pmod(n, F.lit(k))).cast("int")
    size = lambda k: F.when(whole, 8).otherwise(k)
    inside = (F.col("x") < size(4)) & (F.col("y") < size(6))
    cell = F.when(inside, F.struct("y", "x", "argb"))
    flat = px.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda p: p["argb"]).alias("argb"), F.bool_or(argb.channel(F.col("argb"), "a") < 255).alias("has_alpha"))
    rows = flat.select(
        F.call_function("div", n, F.lit(5)).alias("path"), F.pmod(n, F.lit(5)).cast("int").alias("frame_idx"), place(3).alias("x"), place(2).alias("y"), size(4).alias("width"), size(6).alias("height"), F.lit(8).alias("canvas_w"), F.lit(8).alias("canvas_h"),
        F.lit(40).alias("duration_ms"), F.when(F.pmod(n, F.lit(3)) == 0, "overwrite").otherwise("blend").alias("blend"), F.when(F.pmod(n, F.lit(7)) < 3, "background").otherwise("keep").alias("dispose"), "has_alpha", "argb",
    )
    total = F.aggregate(F.transform("argb", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return animation.composited(rows).select("path", "frame_idx", total.alias("checksum"))


@query(f"WITH {FRAMES_SQL}, k AS (SELECT path, CASE WHEN payload IN ('click', 'view') AND path % 3 < 2 THEN 'l' WHEN path % 3 > 0 THEN 'v' END AS c FROM fr) SELECT path, CASE WHEN bool_or(c IS NULL) THEN 'unknown' WHEN count(DISTINCT c) = 2 THEN 'mixed' WHEN max(c) = 'l' THEN 'lossless' ELSE 'lossy' END AS codec FROM k GROUP BY path")
def animation_codecs(spark, sf_dir):
    rows = event_frames(spark, sf_dir)
    image = F.lit(b"abc")
    third = F.pmod("path", F.lit(3))
    still = F.when(F.decode("payload", "UTF-8").isin("click", "view") & (third < 2), riff.chunk("VP8L", image)).when(third > 0, F.concat(riff.chunk("ALPH", image), riff.chunk("VP8 ", image))).otherwise(riff.chunk("junk", image))
    return animation.codecs(animation.write(rows.withColumn("payload", still)))


@query("SELECT page_id AS path, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 3 = 1 THEN coalesce(url, '') END AS exif FROM pages")
def metadata_selection(spark, sf_dir):
    """EXIF is replaced, kept or left out, by the page's number; the files are written again and read back."""
    files = page_files(spark, sf_dir)
    third, null = F.pmod("path", F.lit(3)), F.lit(None).cast("binary")
    old = container.metadata(files).withColumnRenamed("exif", "old").select("path", "old")
    exif = container.resolved(F.col("old"), F.when(third == 0, F.lit(b"new")), third == 1)
    again = container.with_metadata(files.join(old, "path"), null, exif, null, F.lit(1), F.lit(1))
    return container.metadata(again).select("path", F.decode("exif", "UTF-8").alias("exif"))


@query("SELECT p_partkey, CAST(p_partkey & 3 AS BIGINT) AS method, CAST((p_partkey >> 2) & 3 AS BIGINT) AS filter, CAST((p_partkey >> 4) & 3 AS BIGINT) AS preprocessing FROM part WHERE p_partkey & 192 = 0")
def alpha_header(spark, sf_dir):
    """The first byte of alpha data; headers with reserved bits have no row."""
    head = riff.read_alph_header(le_bytes(F.col("p_partkey").bitwiseAND(F.lit(255)), 1))
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("h")).where("h is not null").select("p_partkey", "h.method", "h.filter", "h.preprocessing")


@query(f"WITH {FRAMES_SQL}, n AS (SELECT path, count(*) AS n FROM fr GROUP BY path) SELECT path, frame_idx, CASE WHEN frame_idx = 1 THEN CAST(5 AS BIGINT) ELSE duration_ms END AS duration_ms FROM fr UNION ALL SELECT path, 1, CAST(5 AS BIGINT) FROM n WHERE n = 1")
def frame_replacement(spark, sf_dir):
    """Frame 1 of every animation becomes one of 5 ms."""
    rows = event_frames(spark, sf_dir)
    new = rows.where("frame_idx = 0").withColumn("duration_ms", F.lit(5).cast("long"))
    return animation.replaced_frame(rows, new, 1).select("path", "frame_idx", "duration_ms")


@query(f"WITH {PX_SQL}, f AS (SELECT img - 1 AS img, x, y, CASE WHEN img % 4 = 0 THEN 0 ELSE a END AS a FROM px) SELECT px.img, CASE WHEN px.img % 3 > 0 AND bool_or(px.a > 0) AND bool_and(coalesce(f.a = 0, false)) THEN 'background' ELSE 'keep' END AS dispose FROM px LEFT JOIN f USING (img, x, y) WHERE px.img % 3 = 0 OR x < 5 GROUP BY px.img")
def part_disposals(spark, sf_dir):
    """Every third image fills its canvas of 8 x 8 and is kept; of the others only the left part is a frame."""
    px = embedding_pixels(spark, sf_dir)
    following = px.select((F.col("img") - 1).alias("img"), "x", "y", F.when(F.pmod("img", F.lit(4)) == 0, 0).otherwise(F.col("argb")).alias("argb"))
    return animation.disposals(px.where((F.pmod("img", F.lit(3)) == 0) | (F.col("x") < 5)), following, (8, 8))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb FROM pa")
def raw_round_trip(spark, sf_dir):
    """Pixels written as raw files and read again."""
    files = images.to_raw(embedding_pixels(spark, sf_dir)).withColumnsRenamed({"img": "path"})
    return images.raw_pixels(files.select("path", F.lit(8).alias("width"), F.lit(8).alias("height"), "content"))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb | 4278190080 AS argb FROM pa")
def ppm_round_trip(spark, sf_dir):
    """Pixels written as PPM files, given a comment of 600 characters each, and read again; alpha is lost."""
    files = images.to_ppm(embedding_pixels(spark, sf_dir)).withColumnRenamed("img", "path")
    comment = F.concat(F.lit(b"P6\n#"), F.repeat(F.lit("long "), F.lit(120)).cast("binary"), F.lit(b"\n"))
    return images.ppm_pixels(files.withColumn("content", F.concat(comment, F.expr("substring(content, 4)"))))


@query("SELECT page_id AS path, kind AS format, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height FROM (SELECT page_id, page_id % 500 + 1 AS w, page_id % 300 + 1 AS h, CASE page_id % 3 WHEN 0 THEN 'ppm' WHEN 1 THEN 'gif' ELSE 'bmp' END AS kind FROM pages)")
def header_sizes(spark, sf_dir):
    """Sizes from the headers of PPM (behind comments), GIF and BMP files."""
    w, h = F.pmod("page_id", F.lit(500)) + 1, F.pmod("page_id", F.lit(300)) + 1
    binary = lambda c: c.cast("string").cast("binary")
    ppm = F.concat(F.lit(b"P6\n# "), F.repeat(F.lit("x"), F.lit(700)).cast("binary"), F.lit(b"\n"), binary(w), F.lit(b" "), binary(h), F.lit(b"\n255\n"))
    gif = F.concat(F.lit(b"GIF89a"), le_bytes(w, 2), le_bytes(h, 2), F.lit(bytes(10)))
    bmp = F.concat(F.lit(b"BM" + bytes(16)), le_bytes(w, 4), le_bytes(h, 4), F.lit(bytes(20)))
    third = F.pmod("page_id", F.lit(3))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.when(third == 0, ppm).when(third == 1, gif).otherwise(bmp).alias("content"))
    return images.sizes(files).select("path", "format", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


# --- pixels -----------------------------------------------------------------------------------------------------


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb, printf('%02X%02X%02X%02X', r, g, b, a) AS rgba, printf('%02X%02X%02X%02X', b, g, r, a) AS bgra, true AS back FROM pa")
def layouts(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    rgba, bgra = (argb.to_layout(F.col("argb"), x) for x in ("rgba8", "bgra8"))
    return px.select("img", "x", "y", "argb", rgba.alias("rgba"), bgra.alias("bgra"), ((argb.from_layout(rgba, "rgba8") == F.col("argb")) & (argb.from_layout(bgra, "bgra8") == F.col("argb"))).alias("back"))


@query(f"WITH {PX_SQL} SELECT img, bool_or(a <> 255) AS has_alpha FROM px GROUP BY img")
def alpha_flags(spark, sf_dir):
    return pixels.alpha_flags(embedding_pixels(spark, sf_dir))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x - 2 AS x, y - 1 AS y, argb FROM pa WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 3")
def crop(spark, sf_dir):
    return pixels.crop(embedding_pixels(spark, sf_dir), 2, 1, 5, 3)


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, 7 - y AS y, argb FROM pa")
def flip(spark, sf_dir):
    return pixels.flip(embedding_pixels(spark, sf_dir))


@query(f"WITH {PX_SQL}, {ARGB_SQL}, g AS (SELECT img, CAST(i % 10 AS INT) AS x, CAST(i // 10 AS INT) AS y FROM (SELECT DISTINCT img FROM px), (SELECT unnest(range(0, 120)) AS i)) SELECT img, x, y, coalesce(argb, 0) AS argb FROM g LEFT JOIN pa USING (img, x, y)")
def pad(spark, sf_dir):
    return pixels.pad(embedding_pixels(spark, sf_dir), 10, 12)


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb | 4278190080 AS opaque, 4278190080 | (a << 16) | (a << 8) | a AS gray, CASE WHEN a = 0 THEN 0 ELSE argb END AS clean FROM pa")
def alpha_maps(spark, sf_dir):
    p = F.col("argb")
    return embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.opaque(p).alias("opaque"), argb.alpha_as_gray(p).alias("gray"), argb.clear_hidden(p).alias("clean"))


@query("SELECT p_partkey, CAST((CAST(p_size AS BIGINT) * 30 + p_partkey % 90) // (p_partkey % 90 + 1) AS BIGINT) AS width_of_30, CAST(((p_partkey % 90 + 1) * 40 + p_size - 1) // p_size AS BIGINT) AS height_of_40 FROM part")
def scaled_sizes(spark, sf_dir):
    w, h = F.col("p_size").cast("long"), F.pmod("p_partkey", F.lit(90)) + 1
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", pixels.scaled_size(w, h, zero, F.lit(30).cast("long"))[0].alias("width_of_30"), pixels.scaled_size(w, h, F.lit(40).cast("long"), zero)[1].alias("height_of_40"))


def _over_sql(s: str, d: str) -> str:
    rest = f"(({d}.a * (256 - {s}.a)) >> 8)"
    c = lambda k: f"((({s}.{k} * {s}.a + {d}.{k} * {rest}) * (16777216 // ({s}.a + {rest}))) >> 24) & 255"
    return f"CASE WHEN {s}.a = 255 THEN {s}.argb WHEN {s}.a = 0 THEN {d}.argb ELSE (({s}.a + {rest}) << 24) | (({c('r')}) << 16) | (({c('g')}) << 8) | ({c('b')}) END"


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT s.img, s.x, s.y, {_over_sql('s', 'd')} AS argb FROM pa s JOIN pa d ON s.img = d.img + 1 AND s.x = d.x AND s.y = d.y")
def blend_over(spark, sf_dir):
    s = embedding_pixels(spark, sf_dir)
    d = s.select((F.col("img") + 1).alias("img"), "x", "y", F.col("argb").alias("below"))
    return s.join(d, ["img", "x", "y"]).select("img", "x", "y", argb.over(F.col("argb"), F.col("below")).alias("argb"))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, CASE WHEN a = 255 THEN argb WHEN a = 0 THEN 0 ELSE (a << 24) | (((r * a * 65793 + 8388608) >> 24) << 16) | (((g * a * 65793 + 8388608) >> 24) << 8) | ((b * a * 65793 + 8388608) >> 24) END AS argb FROM pa")
def premultiplied(spark, sf_dir):
    return embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.matte(F.col("argb")).alias("argb"))


@query(f"WITH {PX_SQL}, o AS (SELECT img, x // 2 AS x, y // 2 AS y, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM px GROUP BY ALL) SELECT img, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(4278190080 | (CAST((2 * r + n) // (2 * n) AS BIGINT) << 16) | (CAST((2 * g + n) // (2 * n) AS BIGINT) << 8) | CAST((2 * b + n) // (2 * n) AS BIGINT) AS BIGINT) AS argb FROM o")
def shrink_opaque(spark, sf_dir):
    """All images, with their alpha set to opaque."""
    px = embedding_pixels(spark, sf_dir)
    return pixels.shrink(px.withColumn("argb", argb.opaque(F.col("argb"))), 2)


_MATTE = ", ".join(f"CASE WHEN a = 255 THEN {c} WHEN a = 0 THEN 0 ELSE ({c} * a * 65793 + 8388608) >> 24 END AS {c}" for c in "rgb")
_MEANS = ", ".join(f"CAST((2 * sum({c}) + count(*)) // (2 * count(*)) AS BIGINT) AS {c}" for c in "argb")
_RESTORED = " | ".join(f"((({c} * (4278190080 // a) + 8388608) >> 24) << {n})" for c, n in (("r", 16), ("g", 8), ("b", 0)))


@query(f"WITH {PX_SQL}, m AS (SELECT img, x // 2 AS x, y // 2 AS y, a, {_MATTE} FROM px), o AS (SELECT img, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {_MEANS} FROM m GROUP BY ALL) SELECT img, x, y, CASE WHEN a = 255 THEN {ARGB} WHEN a = 0 THEN 0 ELSE (a << 24) | {_RESTORED} END AS argb FROM o")
def shrink(spark, sf_dir):
    return pixels.shrink(embedding_pixels(spark, sf_dir), 2)


@query(f"WITH {PX_SQL}, d AS (SELECT n.img, (n.r - p.r) ** 2 + (n.g - p.g) ** 2 + (n.b - p.b) ** 2 AS se, greatest(abs(n.r - p.r), abs(n.g - p.g), abs(n.b - p.b), abs(n.a - p.a)) AS d FROM px n JOIN px p ON n.img = p.img + 1 AND n.x = p.x AND n.y = p.y) SELECT img, 8 AS width, 8 AS height, CASE WHEN sum(se) > 0 THEN round(10 * log10(65025.0 * 3 * count(*) / sum(se)), 6) END AS psnr, CAST(max(d) AS BIGINT) AS max_delta, CAST(NULL AS VARCHAR) AS error FROM d GROUP BY img")
def image_diff(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    found = pixels.compare(px, px.withColumn("img", F.col("img") + 1))
    return found.withColumn("psnr", F.round("psnr", 6))


_SSIM = " UNION ALL ".join(f"SELECT n.img, n.x // 4 AS bx, n.y // 4 AS b_y, '{c}' AS c, CAST(n.{c} AS DOUBLE) AS p, CAST(p.{c} AS DOUBLE) AS q FROM px n JOIN px p ON n.img = p.img + 1 AND n.x = p.x AND n.y = p.y" for c in "rgb")


@query(f"WITH {PX_SQL}, v AS ({_SSIM}), m AS (SELECT img, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS vp, var_pop(q) AS vq, covar_pop(p, q) AS cov FROM v GROUP BY img, bx, b_y, c) SELECT img, round(avg((2 * mp * mq + 6.5025) * (2 * cov + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (vp + vq + 58.5225))), 6) AS ssim FROM m GROUP BY img".replace("v AS (SELECT img, label", "v0 AS (SELECT img, label").replace("FROM v)", "FROM v0)"))
def image_ssim(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    return pixels.ssim(px, px.withColumn("img", F.col("img") + 1), 4).withColumn("ssim", F.round("ssim", 6))


@query(f"WITH {LINES_SQL} SELECT img, CASE WHEN bool_or(a <> 255) THEN 'transparent' WHEN count(DISTINCT (r << 16) | (g << 8) | b) <= 20 THEN 'graphic' ELSE 'photo' END AS class FROM px GROUP BY img")
def content_classes(spark, sf_dir):
    return pixels.classes(line_pixels(spark, sf_dir), 20)


@query(f"WITH {LINES_SQL}, h AS (SELECT 'a' AS channel, a AS value FROM px UNION ALL SELECT 'r', r FROM px UNION ALL SELECT 'g', g FROM px UNION ALL SELECT 'b', b FROM px) SELECT channel, CAST(value AS BIGINT) AS value, count(*) AS n FROM h GROUP BY ALL")
def histograms(spark, sf_dir):
    return pixels.histogram(line_pixels(spark, sf_dir))


@query(f"WITH {LINES_SQL}, h AS (SELECT 'a' AS channel, a AS value FROM px UNION ALL SELECT 'r', r FROM px UNION ALL SELECT 'g', g FROM px UNION ALL SELECT 'b', b FROM px), c AS (SELECT channel, value, count(*) AS n FROM h GROUP BY ALL) SELECT channel, round(sum(n) * log2(sum(n)) - sum(n * log2(n)), 3) AS bits FROM c GROUP BY channel")
def channel_entropy(spark, sf_dir):
    return pixels.entropies(pixels.histogram(line_pixels(spark, sf_dir)), "channel").withColumn("bits", F.round("bits", 3))


@query(f"""WITH {PX_SQL}, {ARGB_SQL}, q AS (SELECT DISTINCT img, (argb >> 6) & 50529027 AS argb FROM pa), n AS (SELECT img, count(*) AS c FROM q GROUP BY img HAVING count(*) <= 24),
o AS (SELECT q.img, c, row_number() OVER (PARTITION BY q.img ORDER BY argb) - 1 AS idx, argb, coalesce(lag(argb) OVER (PARTITION BY q.img ORDER BY argb), 0) AS p FROM q JOIN n USING (img))
SELECT img, CAST(idx AS INT) AS idx, argb, ((((argb >> 24) - (p >> 24)) & 255) << 24) | (((((argb >> 16) & 255) - ((p >> 16) & 255)) & 255) << 16) | (((((argb >> 8) & 255) - ((p >> 8) & 255)) & 255) << 8) | (((argb & 255) - (p & 255)) & 255) AS delta,
CASE WHEN c <= 2 THEN 3 WHEN c <= 4 THEN 2 WHEN c <= 16 THEN 1 ELSE 0 END AS bundle_bits FROM o""")
def palettes(spark, sf_dir):
    few = embedding_pixels(spark, sf_dir).withColumn("argb", F.shiftright("argb", 6).bitwiseAND(F.lit(0x03030303)))
    return pixels.palettes(few, 24)


@query(f"WITH {PX_SQL}, {ARGB_SQL}, q AS (SELECT img, x, y, (argb >> 6) & 50529027 AS argb FROM pa), n AS (SELECT img FROM q GROUP BY img HAVING count(DISTINCT argb) <= 24) SELECT img, x, y, argb FROM q JOIN n USING (img)")
def palette_round_trip(spark, sf_dir):
    few = embedding_pixels(spark, sf_dir).withColumn("argb", F.shiftright("argb", 6).bitwiseAND(F.lit(0x03030303)))
    palette = pixels.palettes(few, 24)
    return pixels.unindexed(pixels.indexed(few, palette), palette)


@query(f"WITH {PX_SQL} SELECT img, x, y, CAST((16839 * r + 33059 * g + 6420 * b + 1081344) >> 16 AS BIGINT) AS luma FROM px")
def luma_plane(spark, sf_dir):
    return embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.luma(F.col("argb")).alias("luma"))


_UV = "least(255, greatest(0, CAST(({} + 33554432 + 131072) >> 18 AS BIGINT)))"


@query(f"WITH {PX_SQL}, s AS (SELECT img, x // 2 AS x, y // 2 AS y, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM px GROUP BY ALL) SELECT img, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {_UV.format('-9719 * r - 19081 * g + 28800 * b')} AS u, {_UV.format('28800 * r - 24116 * g - 4684 * b')} AS v FROM s")
def chroma_planes(spark, sf_dir):
    return pixels.chroma_planes(embedding_pixels(spark, sf_dir))


@query(f"WITH {PX_SQL}, c AS (SELECT img, x, y, r AS yy, g AS u, b AS v FROM px), d AS (SELECT img, x, y, ((yy * 19077) >> 8) AS k, u, v FROM c) SELECT img, x, y, 4278190080 | (least(255, greatest(0, (k + ((v * 26149) >> 8) - 14234) >> 6)) << 16) | (least(255, greatest(0, (k - ((u * 6419) >> 8) - ((v * 13320) >> 8) + 8708) >> 6)) << 8) | least(255, greatest(0, (k + ((u * 33050) >> 8) - 17685) >> 6)) AS argb FROM d")
def yuv_to_rgb(spark, sf_dir):
    p = F.col("argb")
    return embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.yuv_to_argb(*[argb.channel(p, c) for c in "rgb"]).alias("argb"))


# --- transforms -------------------------------------------------------------------------------------------------


@query(f"WITH {PX_SQL} SELECT img, x, y, (a << 24) | (((r - g) & 255) << 16) | (g << 8) | ((b - g) & 255) AS argb, true AS back FROM px")
def subtract_green(spark, sf_dir):
    p = F.col("argb")
    return embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.subtract_green(p).alias("argb"), (argb.add_green(argb.subtract_green(p)) == p).alias("back"))


_SB = "(CASE WHEN {0} > 127 THEN {0} - 256 ELSE {0} END)"


@query(f"WITH {PX_SQL}, m AS (SELECT *, (x // 4) * 37 + 11 AS gr, (y // 4) * 91 + 5 AS gb, 200 AS rb FROM px) SELECT img, x, y, (a << 24) | (((r - (({_SB.format('gr')} * {_SB.format('g')}) >> 5)) & 255) << 16) | (g << 8) | ((b - ((({_SB.format('gb')} * {_SB.format('g')}) >> 5) + ((-56 * {_SB.format('r')}) >> 5))) & 255) AS argb, true AS back FROM m")
def cross_colour(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    tiles = px.select("img", F.shiftright("x", 2).alias("tx"), F.shiftright("y", 2).alias("ty")).distinct().withColumns({"green_to_red": F.col("tx") * 37 + 11, "green_to_blue": F.col("ty") * 91 + 5, "red_to_blue": F.lit(200)})
    there = transforms.cross_coloured(px, tiles, 2)
    back = transforms.cross_coloured(there, tiles, 2, inverse=True).withColumnRenamed("argb", "again")
    return there.join(back, ["img", "x", "y"]).join(px.withColumnRenamed("argb", "was"), ["img", "x", "y"]).select("img", "x", "y", "argb", (F.col("again") == F.col("was")).alias("back"))


_EDGE = "CASE WHEN x = 0 AND y = 0 THEN 4278190080 WHEN y = 0 THEN l WHEN x = 0 THEN t ELSE {} END"


def _sub_sql(guess: str) -> str:
    return " | ".join(f"(((((argb >> {s}) & 255) - ((({guess}) >> {s}) & 255)) & 255) << {s})" for s in (24, 16, 8, 0))


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {NEAR_SQL} SELECT img, x, y, {_sub_sql(_EDGE.format('t'))} AS argb FROM ne")
def predict_top(spark, sf_dir):
    return transforms.residuals(embedding_pixels(spark, sf_dir), 2)


_MEAN = " | ".join(f"(((((l >> {s}) & 255) + ((t >> {s}) & 255)) >> 1) << {s})" for s in (24, 16, 8, 0))


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {NEAR_SQL} SELECT img, x, y, {_sub_sql(_EDGE.format(_MEAN))} AS argb FROM ne")
def predict_mean(spark, sf_dir):
    return transforms.residuals(embedding_pixels(spark, sf_dir), 7)


_GRAD = " | ".join(f"(least(255, greatest(0, ((l >> {s}) & 255) + ((t >> {s}) & 255) - ((tl >> {s}) & 255))) << {s})" for s in (24, 16, 8, 0))


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {NEAR_SQL}, n2 AS (SELECT *, lag(t) OVER (PARTITION BY img, y ORDER BY x) AS tl FROM ne) SELECT img, x, y, {_sub_sql(_EDGE.format(_GRAD))} AS argb FROM n2")
def predict_gradient(spark, sf_dir):
    return transforms.residuals(embedding_pixels(spark, sf_dir), 12)


def _multiplier_sql(name: str, rest: str, by: str, source: str) -> str:
    """The table ``name`` (img, tx, ty, m): for each tile the candidate that leaves least of ``rest``."""
    signed = f"(CASE WHEN {by} > 127 THEN {by} - 256 ELSE {by} END)"
    left = f"((({rest} - ((m * {signed}) >> 5)) % 256 + 256) % 256)"
    return f"""{name} AS MATERIALIZED (SELECT img, tx, ty, min({{'c': c, 'a': abs(m), 'm': m}})['m'] AS m FROM (SELECT img, tx, ty, m, sum(least({left}, 256 - {left})) AS c FROM {source}, range(-128, 128) AS k(m) GROUP BY img, tx, ty, m) GROUP BY img, tx, ty)"""


def _share_sql(m: str, c: str) -> str:
    return f"(({m} * (CASE WHEN {c} > 127 THEN {c} - 256 ELSE {c} END)) >> 5)"


_MULTIPLIERS = ", ".join(
    [
        "tp AS MATERIALIZED (SELECT img, x // 4 AS tx, y // 4 AS ty, r, g, b FROM px)",
        _multiplier_sql("gr", "r", "g", "tp"),
        _multiplier_sql("gb0", "b", "g", "tp"),
        *(
            part
            for n in range(3)
            for part in (
                _multiplier_sql(f"rb{n}", "(b - " + _share_sql("h", "g") + ")", "r", f"(SELECT tp.*, gb{n}.m AS h FROM tp JOIN gb{n} USING (img, tx, ty))"),
                *([_multiplier_sql(f"gb{n + 1}", "(b - " + _share_sql("h", "r") + ")", "g", f"(SELECT tp.*, rb{n}.m AS h FROM tp JOIN rb{n} USING (img, tx, ty))")] if n < 2 else []),
            )
        ),
    ]
)


@query(f"WITH {PX_SQL}, {_MULTIPLIERS} SELECT img, tx, ty, CAST(gr.m AS INT) AS green_to_red, CAST(gb2.m AS INT) AS green_to_blue, CAST(rb2.m AS INT) AS red_to_blue FROM gr JOIN gb2 USING (img, tx, ty) JOIN rb2 USING (img, tx, ty)")
def cross_colour_search(spark, sf_dir):
    return transforms.cross_colour_multipliers(embedding_pixels(spark, sf_dir), 2)


_MODES_SQL = f"""nb AS (SELECT *, lag(t) OVER w AS tl, coalesce(lead(t) OVER w, first_value(argb) OVER w) AS tr FROM ne WINDOW w AS (PARTITION BY img, y ORDER BY x)),
ch AS (SELECT img, x, y, s, (argb >> s) & 255 AS v, (l >> s) & 255 AS l, (t >> s) & 255 AS t, (tl >> s) & 255 AS tl, (tr >> s) & 255 AS tr,
  sum(abs(((l >> s) & 255) - ((tl >> s) & 255)) - abs(((t >> s) & 255) - ((tl >> s) & 255))) OVER (PARTITION BY img, x, y) AS lean FROM nb, (VALUES (0), (8), (16), (24)) AS c(s)),
gs AS (SELECT img, x, y, s, v, unnest(range(14)) AS mode, unnest([CASE s WHEN 24 THEN 255 ELSE 0 END, l, t, tr, tl, ((l + tr) // 2 + t) // 2, (l + tl) // 2, (l + t) // 2, (tl + t) // 2, (t + tr) // 2,
  ((l + tl) // 2 + (t + tr) // 2) // 2, CASE WHEN lean <= 0 THEN t ELSE l END, least(255, greatest(0, l + t - tl)),
  least(255, greatest(0, (l + t) // 2 + CAST(trunc(((l + t) // 2 - tl) / 2.0) AS BIGINT)))]) AS g FROM ch),
hs AS (SELECT img, x // 4 AS tx, y // 4 AS ty, mode, s, (v - g + 256) % 256 AS value, count(*) AS n FROM gs WHERE x > 0 AND y > 0 GROUP BY ALL),
lg AS (SELECT n, list_reduce(list_prepend(n << (16 - CAST(floor(log2(n)) AS INT)), range(16)), lambda m, k: ((((m & 4294967295) * (m & 4294967295)) >> 16) >> CASE WHEN ((m & 4294967295) * (m & 4294967295)) >> 16 >= 131072 THEN 1 ELSE 0 END)
  + (((m >> 32) * 2 + CASE WHEN ((m & 4294967295) * (m & 4294967295)) >> 16 >= 131072 THEN 1 ELSE 0 END) << 32)) >> 32 AS part, CAST(floor(log2(n)) AS INT) AS whole FROM range(1, 17) AS r(n)),
eb AS (SELECT img, tx, ty, mode, s, sum(hs.n) AS total, sum(hs.n * CASE WHEN hs.n > 1 THEN whole * 65536 + part ELSE 0 END) AS used FROM hs JOIN lg ON lg.n = hs.n GROUP BY ALL),
co AS (SELECT img, tx, ty, mode, sum(CAST(total * CASE WHEN total > 1 THEN whole * 65536 + part ELSE 0 END - used AS BIGINT) >> 16) AS cost FROM eb JOIN lg ON lg.n = total GROUP BY ALL),
mo AS (SELECT img, tx, ty, min({{'c': cost, 'm': mode}})['m'] AS mode FROM co GROUP BY ALL)"""


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {NEAR_SQL}, {_MODES_SQL} SELECT img, tx, ty, CAST(mode AS INT) AS mode FROM mo")
def predictor_choice(spark, sf_dir):
    return transforms.predictor_modes(embedding_pixels(spark, sf_dir), 2)


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {NEAR_SQL}, {_MODES_SQL} SELECT img, x, y, CAST(sum(((v - CASE WHEN x = 0 AND y = 0 THEN CASE s WHEN 24 THEN 255 ELSE 0 END WHEN y = 0 THEN l WHEN x = 0 THEN t ELSE g END + 256) % 256) << s) AS BIGINT) AS argb "
       "FROM ch JOIN gs USING (img, x, y, s, v) JOIN mo ON mo.img = ch.img AND mo.tx = x // 4 AND mo.ty = y // 4 AND mo.mode = gs.mode GROUP BY ALL")  # fmt: skip
def predictor_residuals(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    return transforms.predicted(px, transforms.predictor_modes(px, 2), 2)


_GRID = " | ".join(f"((CASE WHEN ((argb >> {s}) & 255) + 3 + ((((argb >> {s}) & 255) >> 3) & 1) > 255 THEN 255 ELSE (((argb >> {s}) & 255) + 3 + ((((argb >> {s}) & 255) >> 3) & 1)) & 65528 END) << {s})" for s in (24, 16, 8, 0))
_SMOOTH = " AND ".join(f"abs(((argb >> {s}) & 255) - (({n} >> {s}) & 255)) < 8" for n in ("l", "t", "rr", "bb") for s in (24, 16, 8, 0))


@query(f"WITH {PX_SQL}, {ARGB_SQL}, {NEAR_SQL}, n4 AS (SELECT *, lead(argb) OVER (PARTITION BY img, y ORDER BY x) AS rr, lead(argb) OVER (PARTITION BY img, x ORDER BY y) AS bb FROM ne) SELECT img, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND NOT ({_SMOOTH}) THEN {_GRID} ELSE argb END AS argb FROM n4")
def near_lossless(spark, sf_dir):
    return transforms.near_lossless(embedding_pixels(spark, sf_dir), 3)


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, ((argb * 506832829) & 4294967295) >> 22 AS slot FROM pa")
def colour_cache(spark, sf_dir):
    return embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.cache_index(F.col("argb"), 10).alias("slot"))


_PLANE = "ap AS (SELECT img, x, y, r AS v FROM px), an AS (SELECT *, lag(v) OVER (PARTITION BY img, y ORDER BY x) AS l, lag(v) OVER (PARTITION BY img, x ORDER BY y) AS t FROM ap), a2 AS (SELECT *, lag(t) OVER (PARTITION BY img, y ORDER BY x) AS tl FROM an)"


@query(f"WITH {PX_SQL}, {_PLANE} SELECT img, x, y, (v - coalesce(l, t, 0)) & 255 AS horizontal, (v - coalesce(t, l, 0)) & 255 AS vertical, (v - CASE WHEN t IS NULL THEN coalesce(l, 0) WHEN l IS NULL THEN t ELSE least(255, greatest(0, l + t - tl)) END) & 255 AS gradient FROM a2")
def alpha_filters(spark, sf_dir):
    plane = embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.channel(F.col("argb"), "r").alias("v"))
    out = transforms.alpha_filtered(plane, "horizontal").withColumnRenamed("v", "horizontal")
    for kind in ("vertical", "gradient"):
        out = out.join(transforms.alpha_filtered(plane, kind).withColumnRenamed("v", kind), ["img", "x", "y"])
    return out


@query(f"WITH {PX_SQL} SELECT img, x, y, r AS v FROM px")
def alpha_filter_round_trip(spark, sf_dir):
    plane = embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.channel(F.col("argb"), "r").alias("v"))
    return transforms.alpha_unfiltered_rows(transforms.alpha_filtered(plane, "horizontal"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey + 1 AS n FROM orders), d AS (SELECT *, n - 1 AS d, CASE WHEN n > 1 THEN CAST(floor(log2(n - 1)) AS INT) ELSE 0 END AS hb FROM v)
SELECT o_orderkey, CAST(CASE WHEN n <= 4 THEN d ELSE 2 * hb + ((d >> (hb - 1)) & 1) END AS INT) AS symbol, CASE WHEN n <= 4 THEN 0 ELSE hb - 1 END AS extra_bits, CASE WHEN n <= 4 THEN 0 ELSE d - ((d >> (hb - 1)) << (hb - 1)) END AS extra, n AS back FROM d""")
def prefix_codes(spark, sf_dir):
    coded = table(spark, sf_dir, "orders").select("o_orderkey", transforms.prefix_code(F.col("o_custkey") + 1).alias("c")).select("o_orderkey", "c.*")
    return coded.withColumn("back", transforms.prefix_value(F.col("symbol"), F.col("extra")).cast("long"))


@query("""WITH l AS (SELECT n_regionkey AS img, CAST(n_nationkey AS INT) AS symbol, CAST(3 + n_nationkey % 3 AS INT) AS length FROM nation),
c AS (SELECT *, coalesce(sum(1 << (32 - length)) OVER (PARTITION BY img ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
k AS (SELECT img, symbol, length, CAST(s AS BIGINT) >> (32 - length) AS code FROM c)
SELECT *, CAST(list_sum(list_transform(range(0, length), lambda i: ((code >> i) & 1) << (length - 1 - i))) AS BIGINT) AS reversed FROM k""")
def canonical_codes(spark, sf_dir):
    lengths = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("img"), F.col("n_nationkey").cast("int").alias("symbol"), (3 + F.pmod("n_nationkey", F.lit(3))).cast("int").alias("length"))
    return transforms.canonical_codes(lengths)


_LEVEL = "CASE WHEN c <= n THEN 9 WHEN c <= 2 * n THEN 8 WHEN c <= 3 * n THEN 7 WHEN c <= 4 * n THEN 5 WHEN c <= 5 * n THEN 4 ELSE 3 END"


@query(f"WITH {PX_SQL}, d AS (SELECT img, (g - coalesce(lag(g) OVER (PARTITION BY img, y ORDER BY x), 0)) & 255 AS v FROM px), h AS (SELECT img, v, count(*) AS n FROM d GROUP BY ALL), es AS (SELECT img, sum(n) AS n, floor(round(sum(n) * log2(sum(n)) - sum(n * log2(n)), 6)) AS c FROM h GROUP BY img) SELECT img, {_LEVEL} AS level FROM es")
def effort_levels(spark, sf_dir):
    return pixels.effort_levels(embedding_pixels(spark, sf_dir))


_SIGNS = "sg AS (SELECT * FROM (VALUES (0, [1, 1, 1, 1]), (1, [1, 1, -1, -1]), (2, [1, -1, -1, 1]), (3, [1, -1, 1, -1])) AS t(k, s))"


@query(f"WITH {PX_SQL}, {_SIGNS}, b AS (SELECT img, x // 4 AS bx, y // 4 AS b_y, p.k AS u, q.k AS v, sum(r * p.s[x % 4 + 1] * q.s[y % 4 + 1]) AS c FROM px, sg p, sg q GROUP BY ALL) SELECT img, CAST(bx AS INT) AS bx, CAST(b_y AS INT) AS by, u, v, CAST(c AS BIGINT) >> 1 AS c FROM b")
def block_hadamard(spark, sf_dir):
    return pixels.block_hadamard(embedding_pixels(spark, sf_dir).select("img", "x", "y", argb.channel(F.col("argb"), "r").alias("v")))


# --- batches, ledgers, rate ---------------------------------------------------------------------------------------


@query("SELECT page_id, 'out/' || page_id || '.webp' AS output, printf('f-%03d.png', page_id % 2000) AS numbered, CASE WHEN page_id % 3 = 0 THEN 'png' WHEN page_id % 3 = 1 THEN 'jpeg' ELSE 'webp' END AS format FROM pages")
def output_names(spark, sf_dir):
    page = F.col("page_id")
    path = F.concat(F.lit("in/a.b/"), page.cast("string"), F.when(F.pmod(page, F.lit(3)) == 0, ".png").when(F.pmod(page, F.lit(3)) == 1, ".JPEG").otherwise(".blob"))
    content = riff.envelope(F.lit(b""))
    return table(spark, sf_dir, "pages").select("page_id", batch.output_name(path, "out").alias("output"), batch.numbered_name(F.lit("f"), F.pmod(page, F.lit(2000))).alias("numbered"), batch.file_format(path, content).alias("format"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS converted, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped, CAST(coalesce(sum(o_orderkey) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS in_bytes, CAST(coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS out_bytes FROM orders")
def batch_totals(spark, sf_dir):
    outcome = F.when(F.col("o_orderstatus") == "F", "converted").when(F.col("o_orderstatus") == "O", "failed").when(F.col("o_orderstatus") == "P", "skipped")
    return batch.totals(table(spark, sf_dir, "orders").select(outcome.alias("outcome"), F.col("o_orderkey").alias("in_bytes"), F.col("o_custkey").alias("out_bytes")))


@query("SELECT o_orderkey, 'o/' || o_orderkey AS output FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_files(spark, sf_dir):
    inputs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("output"))
    return batch.pending(inputs, table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("path")))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS s, c_nationkey AS n FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS n FROM customer WHERE c_custkey % 11 <> 0)
SELECT k AS c_custkey, 's' AS field, a.s AS before, b.s AS after FROM a JOIN b USING (k) WHERE a.s IS DISTINCT FROM b.s UNION ALL SELECT k, 'n', CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR) FROM a JOIN b USING (k) WHERE a.n IS DISTINCT FROM b.n
UNION ALL SELECT k, NULL, CASE WHEN a.k IS NOT NULL THEN 'present' END, CASE WHEN b.k IS NOT NULL THEN 'present' END FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL""".replace("SELECT k, NULL, CASE WHEN a.k", "SELECT coalesce(a.k, b.k), NULL, CASE WHEN a.k").replace("FULL JOIN b USING (k)", "FULL JOIN b ON a.k = b.k"))
def ledger_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n"))
    mod = lambda k: F.pmod("c_custkey", F.lit(k))
    new = c.where(mod(11) != 0).withColumns({"s": F.when(mod(7) == 0, "NEW").otherwise(F.col("s")), "n": F.when(mod(5) == 0, -1).otherwise(F.col("n"))})
    return batch.ledger_changes(c.where(mod(10) != 0), new, "c_custkey", ["s", "n"])


_TRIALS = "t AS (SELECT p_partkey, q * 10 AS quality, p_partkey % 50 * 20 + q * (p_size + 20) AS bytes, 20.0 + q * (2 + p_partkey % 3) AS psnr FROM part, (SELECT unnest(range(0, 11)) AS q))"


@query(f"""WITH {_TRIALS}, s AS (SELECT p_partkey, coalesce(max(quality) FILTER (bytes <= 800), min(quality)) AS a, coalesce(min(quality) FILTER (psnr >= 36), max(quality)) AS b FROM t GROUP BY p_partkey)
SELECT t.p_partkey, CAST(t.quality AS INT) AS quality, CAST(t.bytes AS BIGINT) AS bytes, CAST(t.psnr AS DOUBLE) AS psnr, t.bytes <= 800 AND t.psnr >= 36 AS met FROM t JOIN s ON t.p_partkey = s.p_partkey AND t.quality = greatest(a, b)""")
def target_quality(spark, sf_dir):
    trials = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("q"))
    trials = trials.select("p_partkey", (F.col("q") * 10).alias("quality"), (F.pmod("p_partkey", F.lit(50)) * 20 + F.col("q") * (F.col("p_size") + 20)).cast("long").alias("bytes"), (20.0 + F.col("q") * (2 + F.pmod("p_partkey", F.lit(3)))).cast("double").alias("psnr"))
    return batch.best_quality(trials, ["p_partkey"], F.lit(800), F.lit(36))


@query("SELECT c_custkey, CASE WHEN levenshtein(c_mktsegment, 'BUILDINGS') <= 3 THEN 'BUILDINGS' WHEN levenshtein(c_mktsegment, 'MACHINE') <= 3 THEN 'MACHINE' END AS meant FROM customer")
def nearest_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", batch.nearest_name(F.col("c_mktsegment"), ["BUILDINGS", "MACHINE"]).alias("meant"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1024 WHEN 2 THEN o_custkey * 1048576 END AS bytes FROM orders")
def sizes_in_text(spark, sf_dir):
    unit = F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit("kb")), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", batch.size_in_bytes(F.concat(F.col("o_custkey").cast("string"), unit)).alias("bytes"))


@query(f"WITH {LINES_SQL} SELECT flag, status, count(*) AS n, CAST(sum(r + g + b) AS BIGINT) AS light FROM px GROUP BY ROLLUP (flag, status)")
def category_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    low = lambda c: F.col(c).cast("long").bitwiseAND(F.lit(255))
    light = low("l_partkey") + low("l_suppkey") + low("l_quantity")
    return lines.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), light.alias("light")).rollup("flag", "status").agg(F.count("*").alias("n"), F.sum("light").alias("light"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [0, 1, 3, 4, 6, 7, 9][CAST(least(p_size % 9, 6) AS INT) + 1] WHEN 1 THEN least(p_size, 9) WHEN 2 THEN least(p_size * 3 // 10, 9) END AS level FROM part")
def effort_options(spark, sf_dir):
    of = lambda k, c: F.when(F.pmod("p_partkey", F.lit(4)) == k, c)
    level = batch.effort(of(0, F.pmod("p_size", F.lit(9))), of(1, F.col("p_size")), of(2, F.col("p_size") * 3))
    return table(spark, sf_dir, "part").select("p_partkey", level.alias("level"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 7 END AS code, CASE WHEN c_custkey % 5 = 0 THEN 'argument' WHEN c_custkey % 3 = 0 THEN 'environment' ELSE 'default' END AS origin FROM customer")
def exit_codes_and_settings(spark, sf_dir):
    n = lambda k: F.pmod("c_custkey", F.lit(k))
    error = F.when(n(4) == 1, "not_webp").when(n(4) == 2, "invalid_dimensions").when(n(4) == 3, "limit_exceeded")
    setting = batch.effective(("argument", F.when(n(5) == 0, 1)), ("environment", F.when(n(3) == 0, 2)), ("default", F.lit(3)))
    return table(spark, sf_dir, "customer").select("c_custkey", batch.exit_code(error).alias("code"), setting["origin"].alias("origin"))


# --- frames and stills, nested chunks, pieces -------------------------------------------------------------------------


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT path, count(*) AS n FROM fr GROUP BY path)
SELECT path, CAST(NULL AS INT) AS parent_idx, 0 AS idx, 'VP8X' AS fourcc, CAST(20 AS BIGINT) AS payload_start, CAST(10 AS BIGINT) AS size FROM n UNION ALL SELECT path, NULL, 1, 'ANIM', 38, 6 FROM n
UNION ALL SELECT path, NULL, frame_idx + 2, 'ANMF', 52 + 36 * frame_idx, 28 FROM fr UNION ALL SELECT path, frame_idx + 2, 0, 'VP8L', 76 + 36 * frame_idx, 3 FROM fr""")
def nested_chunks(spark, sf_dir):
    rows = event_frames(spark, sf_dir).withColumn("payload", riff.chunk("VP8L", F.lit(b"abc")))
    return container.nested_chunks(animation.write(rows))


@query(f"WITH {FRAMES_SQL} SELECT path, frame_idx, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CASE WHEN path % 2 = 0 THEN 'lossless' ELSE 'lossy' END AS codec, frame_idx % 2 = 1 AS has_alpha FROM fr WHERE path % 7 <> 6")
def frames_as_stills(spark, sf_dir):
    """Frames taken out as files and probed: lossless ones, lossy ones with and without alpha, and (left out by the operator) such without an image."""
    rows, w, h, alpha = event_frames(spark, sf_dir), F.col("width"), F.col("height"), F.pmod("frame_idx", F.lit(2)) == 1
    coded = F.concat(F.when(alpha, riff.chunk("ALPH", F.lit(b"abc"))).otherwise(F.lit(b"")), riff.chunk("VP8 ", F.concat(riff.vp8_header(w, h, F.lit(0)), F.lit(b"xyz"))))
    path = F.col("path")
    payload = F.when(F.pmod(path, F.lit(7)) == 6, riff.chunk("junk", F.lit(b"abc"))).when(F.pmod(path, F.lit(2)) == 0, riff.chunk("VP8L", riff.vp8l_header(w, h, alpha))).otherwise(coded)
    stills = animation.as_stills(animation.frames(animation.write(rows.withColumn("payload", payload)))).where("content is not null")
    found = container.images(stills.select(F.concat_ws("-", "path", "frame_idx").alias("path"), "content"))
    part = lambda i, kind: F.split_part("path", F.lit("-"), F.lit(i)).cast(kind)
    return found.select(part(1, "long").alias("path"), part(2, "int").alias("frame_idx"), "width", "height", "codec", "has_alpha")


@query(f"""WITH {PAGES_SQL}, e AS (SELECT *, CASE WHEN path % 4 = 1 OR path % 9 = 0 THEN 'invalid_frame' WHEN path % 5 = 0 THEN 'not_webp' END AS error FROM pg)
SELECT path, path % 4 AS x, CASE WHEN error IS NULL OR path % 5 <> 0 THEN w END AS width, error, CASE WHEN error IS NULL THEN CAST(8 + image + image % 2 AS BIGINT) END AS payload_bytes FROM e""".replace("path % 4 = 1", "path % 2 = 1 AND path % 4 < 3"))
def stills_as_frames(spark, sf_dir):
    """Files as frames; odd offsets, durations that are too long and files that are no images have an error."""
    path = F.col("path")
    fifth = F.pmod(path, F.lit(5)) == 0
    files = page_files(spark, sf_dir).withColumn("content", F.when(fifth, F.lit(b"no such image file")).otherwise(F.col("content")))
    x = F.pmod(path, F.lit(4))
    made = animation.from_stills(files, F.when(x == 3, 4).otherwise(x), F.lit(2), F.when(F.pmod(path, F.lit(9)) == 0, 1 << 24).otherwise(40), F.lit("blend"), F.lit("keep"))
    return made.select("path", F.pmod("path", F.lit(4)).alias("x"), "width", "error", F.octet_length("payload").cast("long").alias("payload_bytes"))


@query(f"WITH {FRAMES_SQL} SELECT path, CASE WHEN path % 3 = 0 THEN CAST(9 AS BIGINT) ELSE 5 END AS loop_count, CASE WHEN path % 2 = 0 THEN CAST(4278190335 AS BIGINT) ELSE 17 END AS background, count(*) AS frame_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM fr GROUP BY path")
def animation_settings(spark, sf_dir):
    """Another loop count for every third animation, another background for every second."""
    files = animation.write(event_frames(spark, sf_dir), loop_count=5, background=17)
    edited = animation.with_settings(files, F.when(F.pmod("path", F.lit(3)) == 0, F.lit(9)), F.when(F.pmod("path", F.lit(2)) == 0, F.lit(0xFF0000FF)))
    return animation.animations(edited).select("path", "loop_count", "background", "frame_count", "total_duration_ms")


@query(f"WITH {PAGES_SQL} SELECT path, alpha AS has_alpha, true AS has_icc, false AS has_exif, w AS width FROM pg")
def metadata_flags(spark, sf_dir):
    """The flags of rewritten files: alpha is what the image's header says."""
    files = page_files(spark, sf_dir).withColumn("w", F.pmod("path", F.lit(500)) + 1)
    null = F.lit(None).cast("binary")
    edited = container.with_metadata(files, F.lit(b"icc"), null, null, F.col("w"), F.lit(1))
    head = container.chunks(edited).where("fourcc = 'VP8X'").select("path", riff.read_vp8x(F.col("payload")).alias("x"))
    return head.select("path", "x.has_alpha", "x.has_icc", "x.has_exif", "x.width")


@query(f"""WITH {PAGES_SQL}, e AS (SELECT path, 46 + image + image % 2 + exif + exif % 2 AS n FROM pg)
SELECT CAST(path AS VARCHAR) AS path, 'chunk' AS event, CAST(idx AS INT) AS idx, fourcc, payload_start, size FROM ck UNION ALL SELECT CAST(path AS VARCHAR), 'header', NULL, NULL, 12, n FROM e UNION ALL SELECT CAST(path AS VARCHAR), 'finished', 3, NULL, NULL, n FROM e""")
def piece_events(spark, sf_dir):
    """Files in pieces of 700 bytes: the events are the chunks."""
    cut = F.explode(F.sequence(F.lit(0), F.call_function("div", F.octet_length("content") - 1, F.lit(700)).cast("int")))
    pieces = page_files(spark, sf_dir).select("path", "content", cut.alias("seq"))
    return incremental.whole_events(pieces.select("path", "seq", F.expr("substring(content, seq * 700 + 1, 700)").alias("bytes")))


# --- more formats -------------------------------------------------------------------------------------------------


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb FROM pa")
def pam_round_trip(spark, sf_dir):
    return images.pam_pixels(images.to_pam(embedding_pixels(spark, sf_dir)).withColumnRenamed("img", "path"))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb FROM pa")
def bmp_round_trip(spark, sf_dir):
    return images.bmp_pixels(images.to_bmp(embedding_pixels(spark, sf_dir)).withColumnRenamed("img", "path"))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, argb FROM pa")
def image_rows_round_trip(spark, sf_dir):
    """Through the rows of Spark's image source."""
    return images.image_pixels(images.to_image_rows(embedding_pixels(spark, sf_dir))).withColumn("img", F.col("img").cast("long"))


@query("""WITH b AS (SELECT page_id, [CAST(14695981039346656037 AS HUGEINT)] || list_transform(range(1, length(url) + 1), lambda i: CAST(ascii(substr(url, i, 1)) AS HUGEINT)) AS v FROM pages)
SELECT page_id, CAST(list_reduce(v, lambda h, c: xor(h, c) * 1099511628211 % 18446744073709551616) AS DECIMAL(20, 0)) AS hash FROM b""")
def address_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", images.fnv1a(F.col("url").cast("binary")).alias("hash"))


# --- lossy coding as arithmetic -------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT p_partkey, p_size, {list(lossy.QUALITY_QUANTISERS)}[CAST(least(100, greatest(0, p_partkey % 130 - 10)) AS INT) + 1] AS base FROM part),
q AS (SELECT p_partkey, CAST(least(127, base + CASE WHEN p_size % 2 = 0 THEN (142 - base) // 16 ELSE 0 END + (p_size % 5) * 127 // 100) AS INT) AS q FROM b),
s AS (SELECT p_partkey, q, {list(lossy.DC_STEPS)}[q + 1] AS dc, {list(lossy.AC_STEPS)}[q + 1] AS ac, {list(lossy.DC_STEPS)}[least(q, 117) + 1] AS uv FROM q)
SELECT p_partkey, q, dc AS y1_dc, ac AS y1_ac, dc * 2 AS y2_dc, CAST(greatest(8, (CAST(ac AS BIGINT) * 101581) >> 16) AS INT) AS y2_ac, uv AS uv_dc, ac AS uv_ac FROM s""")
def quantisers(spark, sf_dir):
    q = lossy.quantiser(F.pmod("p_partkey", F.lit(130)) - 10, F.pmod("p_size", F.lit(2)) == 0, F.pmod("p_size", F.lit(5)))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q")).select("p_partkey", "q", F.inline(F.array(lossy.steps(F.col("q")))))


_BLOCKS_SQL = f"{PX_SQL}, bl AS (SELECT img, CAST(x // 4 AS INT) AS bx, CAST(y // 4 AS INT) AS b_y, list((r - 128) * 8 ORDER BY y, x) AS c FROM px GROUP BY ALL)"


def _coefficients(spark, sf_dir):
    """Blocks of 8 times the red samples around zero, taken as coefficients."""
    red = (argb.channel(F.col("argb"), "r") - 128) * 8
    return lossy.blocks(embedding_pixels(spark, sf_dir).select("img", "x", "y", red.alias("v")))


@query(f"""WITH {_BLOCKS_SQL}, z AS (SELECT unnest(range(0, 16)) AS n, unnest({list(lossy.ZIGZAG)}) AS j), f AS (SELECT unnest(range(0, 16)) AS j, unnest({list(lossy.SHARPENING)}) AS w),
cv AS (SELECT img, bx, b_y, n, j, c[j + 1] AS v, {list(lossy.AC_STEPS)}[CAST(img % 128 AS INT) + 1] AS ac, w, CASE WHEN j = 0 THEN {list(lossy.DC_STEPS)}[CAST(img % 128 AS INT) + 1] ELSE ac END AS step FROM bl, z JOIN f USING (j)),
l AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE sign(v) * least(2047, ((abs(v) + ((w * ac) >> 11)) * ((131072 + step // 2) // step) + 65536) >> 17) END AS l FROM cv)
SELECT img, bx, b_y AS by, string_agg(CAST(CAST(l AS BIGINT) AS VARCHAR), ',' ORDER BY n) AS levels, string_agg(CAST(CAST(l * step AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS restored, CAST(coalesce(max(n) FILTER (l <> 0), 0) AS INT) AS last FROM l GROUP BY ALL""")
def quantised_blocks(spark, sf_dir):
    step = lossy.steps(F.pmod("img", F.lit(128)))
    found = _coefficients(spark, sf_dir).withColumn("s", step).withColumn("f", lossy.quantised(F.col("block"), F.col("s.y1_dc"), F.col("s.y1_ac"), first=1, sharpen=True))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("img", "bx", "by", text("f.levels").alias("levels"), text("f.values").alias("restored"), "f.last")


def _columns_sql(source: str, add: int) -> str:
    """The four outputs of each column of a block's list c, as a list in the order of columns."""
    return f"""(SELECT img, bx, b_y, list(v ORDER BY i, k) AS c FROM (SELECT img, bx, b_y, i, unnest([p + r + h, p - r + l, p - r - l, p + r - h]) AS v, unnest([0, 1, 2, 3]) AS k
FROM (SELECT *, ((q * 35468) >> 16) - (((s * 20091) >> 16) + s) AS l, ((q * 20091) >> 16) + q + ((s * 35468) >> 16) AS h
FROM (SELECT img, bx, b_y, i, c[i + 1] + {add} AS p, c[i + 5] AS q, c[i + 9] AS r, c[i + 13] AS s FROM {source}, (SELECT unnest(range(0, 4)) AS i)))) GROUP BY ALL)"""


@query(f"""WITH {_BLOCKS_SQL}, t AS {_columns_sql("bl", 0)}, d AS {_columns_sql("t", 4)} SELECT img, bx, b_y AS by, array_to_string(list_transform(c, lambda v: CAST(least(255, greatest(0, 100 + (v >> 3))) AS BIGINT)), ',') AS samples FROM d""")
def inverse_dct(spark, sf_dir):
    """Residuals on a flat prediction of 100."""
    samples = lossy.reconstructed(F.array_repeat(F.lit(100).cast("long"), 16), lossy.inverse_dct(F.col("block")))
    return _coefficients(spark, sf_dir).select("img", "bx", "by", F.array_join(samples.cast("array<string>"), ",").alias("samples"))


@query(f"""WITH {_BLOCKS_SQL}, {_SIGNS}, s AS (SELECT img, bx, b_y, p.k AS i, q.k AS k, (CAST(sum(c[4 * u + v + 1] * p.s[u + 1] * q.s[v + 1]) AS BIGINT) + 3) >> 3 AS o FROM bl, sg p, sg q, (SELECT unnest(range(0, 4)) AS u), (SELECT unnest(range(0, 4)) AS v) GROUP BY ALL)
SELECT img, bx, b_y AS by, string_agg(CAST(o AS VARCHAR), ',' ORDER BY i, k) AS firsts FROM s GROUP BY ALL""")
def inverse_hadamard(spark, sf_dir):
    return _coefficients(spark, sf_dir).select("img", "bx", "by", F.array_join(lossy.inverse_hadamard(F.col("block")).cast("array<string>"), ",").alias("firsts"))


@query(f"""WITH s AS (SELECT p_partkey, p_partkey % 8 AS sharp, p_partkey % 2 = 0 AS small, (5 * (p_size * 2) * ({list(lossy.AC_STEPS)}[CAST(p_partkey % 128 AS INT) + 1] // 4)) // (256 + p_partkey % 256) AS f FROM part),
l AS (SELECT *, CASE WHEN f < 2 THEN 0 ELSE least(63, f) END AS level FROM s),
m AS (SELECT *, least(63, greatest(0, level - 3 + CASE WHEN small THEN 5 ELSE 0 END)) AS v FROM l),
i AS (SELECT *, greatest(1, CASE WHEN sharp = 0 THEN v WHEN sharp > 4 THEN least(v // 4, 9 - sharp) ELSE least(v // 2, 9 - sharp) END) AS inside FROM m)
SELECT p_partkey, CAST(level AS INT) AS level, CAST(CASE WHEN v > 0 THEN 2 * v + inside ELSE 0 END AS INT) AS edge_limit, CAST(CASE WHEN v > 0 THEN inside ELSE 0 END AS INT) AS inner_limit, v > 0 AND small AS inner_edges, CASE WHEN v >= 40 THEN 2 WHEN v >= 15 THEN 1 ELSE 0 END AS hev_threshold FROM i""")
def filter_strengths(spark, sf_dir):
    key = lambda k: F.pmod("p_partkey", F.lit(k))
    level = lossy.filter_level(key(128), F.col("p_size") * 2, key(256))
    limits = lossy.filter_limits(F.col("level"), key(8), key(2) == 0, F.lit(-3), F.lit(5))
    return table(spark, sf_dir, "part").withColumn("level", level).select("p_partkey", "level", F.inline(F.array(limits)))


@query("SELECT l_orderkey AS img, l_linenumber AS segment, CAST(255 * (a - min(a) OVER w) // greatest(1, max(a) OVER w - min(a) OVER w) AS INT) AS bias FROM (SELECT *, l_partkey % 200 AS a FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)")
def segment_biases(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("segment"), F.pmod("l_partkey", F.lit(200)).alias("activity"))
    return lossy.segment_biases(rows).select("img", "segment", "bias")


@query("""SELECT p_partkey, CAST(trunc((p_partkey % 256 - 128) * (p_size * 2) / 512) AS INT) AS shaping, CAST(2 + (p_size * 2 * 254 + 50) // 100 AS INT) AS alpha_levels,
CASE p_partkey % 5 WHEN 0 THEN 80 WHEN 1 THEN 80 WHEN 2 THEN 25 WHEN 3 THEN 0 ELSE 50 END AS noise_shaping, CASE p_partkey % 5 WHEN 0 THEN 35 WHEN 1 THEN 30 WHEN 2 THEN 10 WHEN 3 THEN 0 ELSE 60 END AS filter_strength,
CAST(CASE WHEN p_size % 2 = 0 THEN least(7, p_size) ELSE CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 0 END END AS INT) AS filter_sharpness, CASE WHEN p_partkey % 5 = 3 THEN 2 ELSE 4 END AS segments FROM part""")
def tuning_values(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("picture", "Photo", "drawing", "text", "no such"))), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    knobs = lossy.tuning(name, filter_sharpness=F.when(F.pmod("p_size", F.lit(2)) == 0, F.col("p_size")))
    shaping = lossy.noise_shaping(F.pmod("p_partkey", F.lit(256)), F.col("p_size") * 2)
    return table(spark, sf_dir, "part").select("p_partkey", shaping.alias("shaping"), lossy.alpha_levels(F.col("p_size") * 2).alias("alpha_levels"), F.inline(F.array(knobs)))


def _log2_sql(n: str, out: str) -> str:
    """CTEs from table {out}_0 (img, n) to {out} (img, l): the logarithm of n times 65,536, a bit in each."""
    steps = [f"{out}_1 AS (SELECT img, length(bin(n)) - 1 AS w, CASE WHEN length(bin(n)) <= 17 THEN n << (17 - length(bin(n))) ELSE n >> (length(bin(n)) - 17) END AS m, 0 AS f FROM (SELECT img, CAST({n} AS BIGINT) AS n FROM se))"]
    for k in range(16):
        steps.append(f"{out}_{k + 2} AS (SELECT img, w, CASE WHEN q >= 131072 THEN q >> 1 ELSE q END AS m, f * 2 + CASE WHEN q >= 131072 THEN 1 ELSE 0 END AS f FROM (SELECT *, (m * m) >> 16 AS q FROM {out}_{k + 1}))")
    return ", ".join([*steps, f"{out} AS (SELECT img, w * 65536 + f AS l FROM {out}_17)"])


@query(f"""WITH {PX_SQL}, se AS (SELECT n.img, sum((n.r - p.r) * (n.r - p.r) + (n.g - p.g) * (n.g - p.g) + (n.b - p.b) * (n.b - p.b)) AS se, count(*) AS n FROM px n JOIN px p ON n.img = p.img + CASE WHEN p.img % 9 = 0 THEN 0 ELSE 1 END AND n.x = p.x AND n.y = p.y WHERE p.img % 9 <> 8 GROUP BY n.img),
{_log2_sql("195075 * n", "a")}, {_log2_sql("greatest(se, 1)", "b")}
SELECT img, CASE WHEN se = 0 THEN 4294967295 ELSE CAST(greatest(0, a.l - b.l) * 1000 // 217706 AS BIGINT) END AS centidecibels FROM se JOIN a USING (img) JOIN b USING (img)""")
def exact_psnr(spark, sf_dir):
    """Each image against the one before, the first of nine against itself."""
    px = embedding_pixels(spark, sf_dir)
    ninth = F.pmod("img", F.lit(9))
    before = px.where(ninth != 8).withColumn("img", F.col("img") + F.when(ninth == 0, 0).otherwise(1))
    return pixels.exact_psnr(px, before)


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, CASE WHEN x < 6 THEN (argb & 16777215) | (g << 24) END AS argb FROM pa")
def alpha_planes(spark, sf_dir):
    """Alpha from a plane that lacks the last two columns."""
    px = embedding_pixels(spark, sf_dir)
    return pixels.with_alpha(px, px.where("x < 6").select("img", "x", "y", argb.channel(F.col("argb"), "g").alias("v")))


@query("""WITH o AS (SELECT p_partkey, p_partkey % 2 = 0 AS jpeg, p_partkey % 3 = 0 AS lossless, p_partkey % 5 = 0 AS near, p_partkey % 7 = 0 AS loose, p_size % 4 = 0 AS q, p_size FROM part),
m AS (SELECT *, (lossless OR near) AND (loose OR q) AS clash, NOT (lossless OR near OR loose OR q) AS derived FROM o),
c AS (SELECT *, CASE WHEN clash THEN NULL WHEN lossless OR near THEN 'lossless' WHEN loose OR q OR jpeg THEN 'lossy' ELSE 'lossless' END AS codec FROM m),
t AS (SELECT *, p_size % 3 = 0 AS opt, p_size % 5 = 0 AS aim FROM c)
SELECT p_partkey, codec, CASE WHEN codec = 'lossy' THEN CASE WHEN q THEN p_size ELSE 75 END END AS quality, derived, CASE WHEN clash OR (opt AND (aim OR (codec = 'lossy' AND NOT derived))) OR (NOT opt AND aim AND codec = 'lossless') THEN 'conflicting_options' END AS error,
CASE WHEN codec IS NULL OR error IS NOT NULL THEN NULL WHEN opt AND codec = 'lossless' THEN 'optimise' WHEN aim THEN 'search' ELSE 'once' END AS strategy FROM t""")
def encode_modes(spark, sf_dir):
    """Codec and strategy for combinations of options; a clash in either is an error."""
    part = lambda k: F.pmod("p_partkey", F.lit(k)) == 0
    size = lambda k: F.pmod("p_size", F.lit(k)) == 0
    mode = batch.encode_mode(F.when(part(2), "jpeg").otherwise("png"), part(3), F.when(part(5), 60), part(7), F.when(size(4), F.col("p_size")))
    found = table(spark, sf_dir, "part").withColumn("m", mode).withColumn("s", batch.strategy(F.col("m.codec"), F.col("m.derived"), size(3), size(5)))
    return found.select("p_partkey", "m.codec", "m.quality", "m.derived", F.coalesce("m.error", "s.error").alias("error"), F.when(F.col("m.error").isNull(), F.col("s.strategy")).alias("strategy"))


@query("SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN '4' WHEN 1 THEN '4' WHEN 2 THEN '3,4' WHEN 3 THEN '2,3,4' ELSE '2,3,4,5' END AS tile_bits, p_size % 10 > 0 AS cross_colour, p_size % 10 > 0 AS optimal_parse, p_size % 10 > 5 AS blockwise_codes FROM part")
def search_breadth(spark, sf_dir):
    found = table(spark, sf_dir, "part").select("p_partkey", batch.breadth(F.pmod("p_size", F.lit(10))).alias("b"))
    return found.select("p_partkey", F.array_join(F.col("b.tile_bits").cast("array<string>"), ",").alias("tile_bits"), "b.cross_colour", "b.optimal_parse", "b.blockwise_codes")


# --- choices that cluster, and geometry of any ratio -------------------------------------------------------------

_BLOCKS_SQL = """b4 AS (SELECT img, x // 4 AS sx, y // 4 AS sy, list(v ORDER BY y, x) AS b FROM lu GROUP BY ALL HAVING count(*) = 16),
rw AS (SELECT img, sx, sy, i, b[4 * i + 1] + b[4 * i + 4] AS e, b[4 * i + 2] + b[4 * i + 3] AS o, b[4 * i + 2] - b[4 * i + 3] AS n, b[4 * i + 1] - b[4 * i + 4] AS u FROM b4, range(4) AS r(i)),
rt AS (SELECT img, sx, sy, k AS i, list([(e + o) * 8, (n * 2217 + u * 5352 + 1812) >> 9, (e - o) * 8, (u * 2217 - n * 5352 + 937) >> 9][k + 1] ORDER BY i) AS c FROM rw, range(4) AS q(k) GROUP BY ALL),
cw AS (SELECT img, sx, sy, i, c[1] + c[4] AS e, c[2] + c[3] AS o, c[2] - c[3] AS n, c[1] - c[4] AS u FROM rt),
cf AS (SELECT img, sx, sy, i, k, [(e + o + 7) >> 4, ((n * 2217 + u * 5352 + 12000) >> 16) + CASE WHEN u <> 0 THEN 1 ELSE 0 END, (e - o + 7) >> 4, (u * 2217 - n * 5352 + 51000) >> 16][k + 1] AS c FROM cw, range(4) AS q(k)),
bn AS (SELECT img, sx // 4 AS mx, sy // 4 AS my, CASE WHEN i = 0 AND k = 0 THEN 0 ELSE least(31, abs(c) >> 3) END AS bin, count(*) AS n FROM cf GROUP BY ALL),
ac AS MATERIALIZED (SELECT img, mx, my, CAST(CASE WHEN max(n) > 1 THEN least(255, 510 * max(bin) // max(n)) ELSE 0 END AS INT) AS activity FROM bn GROUP BY ALL),
h AS MATERIALIZED (SELECT img, activity AS a, count(*) AS n FROM ac GROUP BY ALL)"""


def _segments_sql() -> str:
    """Centres c0 to c6 of each image, and the nearest of each value after each round."""
    near = lambda r: f"z{r} AS MATERIALIZED (SELECT h.img, a, any_value(n) AS n, min({{'d': abs(a - c), 'k': k}})['k'] AS k FROM h JOIN c{r} ON h.img = c{r}.img GROUP BY h.img, a)"
    parts = ["c0 AS (SELECT img, k, CASE WHEN min(a) = max(a) THEN min(a) ELSE min(a) + (max(a) - min(a)) * k // 3 END AS c, false AS done FROM h, range(4) AS r(k) GROUP BY img, k)", near(0)]
    for r in range(6):
        parts.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT img, k, CASE WHEN done THEN c ELSE m END AS c, done OR sum(abs(m - c)) OVER (PARTITION BY img) < 5 AS done
FROM (SELECT c.img, c.k, c.c, c.done, coalesce(z.m, c.c) AS m FROM c{r} AS c LEFT JOIN (SELECT img, k, CAST(sum(a * n) AS BIGINT) // CAST(sum(n) AS BIGINT) AS m FROM z{r} GROUP BY img, k) AS z ON z.img = c.img AND z.k = c.k))"""
        )
        parts.append(near(r + 1))
    parts.append("sg AS MATERIALIZED (SELECT img, a, CAST(dense_rank() OVER (PARTITION BY img ORDER BY k) - 1 AS INT) AS segment, CAST(sum(a * n) OVER (PARTITION BY img, k) AS BIGINT) // CAST(sum(n) OVER (PARTITION BY img, k) AS BIGINT) AS centre FROM z6)")
    parts.append("sm AS MATERIALIZED (SELECT ac.*, segment, centre FROM ac JOIN sg ON sg.img = ac.img AND sg.a = ac.activity)")
    return ", ".join(parts)


@query(f"""WITH {LUMA_SQL}, {_BLOCKS_SQL}, {_segments_sql()},
vt AS (SELECT a.img, a.mx, a.my, b.segment, count(*) AS n FROM sm AS a JOIN sm AS b ON a.img = b.img AND abs(a.mx - b.mx) <= 1 AND abs(a.my - b.my) <= 1 AND (a.mx <> b.mx OR a.my <> b.my) GROUP BY ALL),
vs AS (SELECT img, mx, my, sum(n) AS n, min(segment) FILTER (WHERE n >= 5) AS s FROM vt GROUP BY ALL)
SELECT sm.img, sm.mx, sm.my, activity, segment, centre, CASE WHEN n = 8 THEN coalesce(s, segment) ELSE segment END AS smooth FROM sm LEFT JOIN vs ON vs.img = sm.img AND vs.mx = sm.mx AND vs.my = sm.my""")
def segment_map(spark, sf_dir):
    return lossy.smoothed(lossy.segmented(lossy.macroblock_activity(luma_planes(spark, sf_dir)))).select("img", "mx", "my", "activity", "segment", "centre", "smooth")


def _levels_sql(levels: int) -> str:
    parts = [
        "h AS MATERIALIZED (SELECT img, v, count(*) AS n FROM lu GROUP BY ALL)",
        f"g AS (SELECT img, min(v) AS lo, max(v) AS hi FROM h GROUP BY img HAVING count(*) > {levels})",
        f"c0 AS (SELECT img, i, lo * 65536 + ((hi - lo) * i * 65536 + {levels - 1} // 2) // {levels - 1} AS c FROM g, range({levels}) AS r(i))",
    ]
    for r in range(6):
        parts.append(f"b{r} AS MATERIALIZED (SELECT img, c + lead(c) OVER (PARTITION BY img ORDER BY i) AS b FROM c{r})")
        parts.append(f"s{r} AS MATERIALIZED (SELECT h.img, v, any_value(n) AS n, count(*) FILTER (WHERE v * 131072 > b) AS i FROM h JOIN b{r} ON b{r}.img = h.img GROUP BY h.img, v)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.img, c.i, coalesce(m, c.c) AS c FROM c{r} AS c LEFT JOIN (SELECT img, i, (CAST(sum(v * n) AS BIGINT) * 65536 + CAST(sum(n) AS BIGINT) // 2) // CAST(sum(n) AS BIGINT) AS m FROM s{r} GROUP BY img, i) AS s ON s.img = c.img AND s.i = c.i)")
    return ", ".join(parts)


@query(f"WITH {LUMA_SQL}, {_levels_sql(12)}, t AS (SELECT s5.img, s5.v, least(255, greatest(0, (c + 32768) >> 16)) AS level FROM s5 JOIN c6 ON c6.img = s5.img AND c6.i = s5.i) SELECT lu.img, x, y, coalesce(level, lu.v) AS v FROM lu LEFT JOIN t ON t.img = lu.img AND t.v = lu.v")
def alpha_levels_chosen(spark, sf_dir):
    return lossy.quantised_alpha(luma_planes(spark, sf_dir), 12)


#: Axis by axis: what each source cell gives to target cells, then sums. Images are 8 x 8; tw and th are their new sizes.
_RESIZE_SQL = f"""sz AS (SELECT DISTINCT img, 1 + img % 13 AS tw, 1 + img // 13 % 11 AS th FROM px),
mt AS (SELECT img, x, y, a, {_MATTE} FROM px),
lg AS (SELECT img, x, y, unnest([0, 8, 16, 24]) AS s, unnest([b, g, r, a]) AS v FROM mt),
l1 AS (SELECT *, x * tw // 8 AS k, CASE WHEN ((x * tw // 8 + 1) * 8 + tw - 1) // tw - 1 = x THEN ((x * tw // 8 + 1) * 8 + tw - 1) // tw * tw - (x * tw // 8 + 1) * 8 ELSE 0 END AS o FROM lg JOIN sz USING (img) WHERE tw <= 8),
e1 AS (SELECT img, tw, th, k, greatest(0, (k * 7 + tw - 2) // (tw - 1) - 1) AS j FROM (SELECT *, unnest(range(tw)) AS k FROM sz WHERE tw > 8)),
f1 AS (SELECT img, tw, th, s, y, k, v * tw - v * o AS f FROM l1 UNION ALL SELECT img, tw, th, s, y, k + 1, ((v * o * (4294967296 // tw % 4294967296) + 2147483648) >> 32) * tw FROM l1 WHERE o > 0
  UNION ALL SELECT img, tw, th, s, y, k, v * ((tw - 1) * (j + 1) - k * 7) FROM e1 JOIN lg USING (img) WHERE lg.x = j UNION ALL SELECT img, tw, th, s, y, k, v * (tw - 1 - ((tw - 1) * (j + 1) - k * 7)) FROM e1 JOIN lg USING (img) WHERE lg.x = j + 1),
rw AS (SELECT img, tw, th, s, y, k AS x, CAST(sum(f) AS BIGINT) AS f FROM f1 WHERE k < tw GROUP BY ALL),
l2 AS (SELECT *, y * th // 8 AS k, CASE WHEN ((y * th // 8 + 1) * 8 + th - 1) // th - 1 = y THEN ((y * th // 8 + 1) * 8 + th - 1) // th * th - (y * th // 8 + 1) * 8 ELSE 0 END AS o FROM rw WHERE th <= 8),
e2 AS (SELECT img, th, k, q, q * (th - 1) - k * 7 AS o FROM (SELECT *, (k * 7 + th - 2) // (th - 1) AS q FROM (SELECT *, unnest(range(th)) AS k FROM sz WHERE th > 8))),
f2 AS (SELECT img, tw, th, s, x, k, f - ((f * (4294967296 // th * o % 4294967296)) >> 32) AS f FROM l2 UNION ALL SELECT img, tw, th, s, x, k + 1, (f * (4294967296 // th * o % 4294967296)) >> 32 FROM l2 WHERE o > 0
  UNION ALL SELECT rw.img, tw, rw.th, s, x, k, f * (4294967296 - 4294967296 * o // (rw.th - 1)) FROM e2 JOIN rw ON rw.img = e2.img AND rw.y = q UNION ALL SELECT rw.img, tw, rw.th, s, x, k, f * (4294967296 * o // (rw.th - 1)) FROM e2 JOIN rw ON rw.img = e2.img AND rw.y = q - 1 AND o > 0),
c2 AS (SELECT img, tw, th, s, x, k AS y, CAST(sum(f) AS BIGINT) AS f, CASE WHEN tw > 8 THEN tw - 1 ELSE 8 END AS w FROM f2 WHERE k < th GROUP BY ALL),
vl AS (SELECT img, x, y, s, least(255, CASE WHEN th > 8 THEN (((f + 2147483648) >> 32) * (4294967296 // w % 4294967296) + 2147483648) >> 32 ELSE (f * (th * 4294967296 // (w * 8)) + 2147483648) >> 32 END) AS v FROM c2),
rs AS (SELECT img, x, y, max(v) FILTER (WHERE s = 24) AS a, max(v) FILTER (WHERE s = 16) AS r, max(v) FILTER (WHERE s = 8) AS g, max(v) FILTER (WHERE s = 0) AS b FROM vl GROUP BY ALL)"""


@query(f"WITH {PX_SQL}, {_RESIZE_SQL} SELECT img, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CASE WHEN a = 255 THEN {ARGB} WHEN a = 0 THEN 0 ELSE (a << 24) | {_RESTORED} END AS argb FROM rs")
def resize_any_ratio(spark, sf_dir):
    px = embedding_pixels(spark, sf_dir)
    n = F.col("img")
    sizes = px.select("img").distinct().select("img", F.lit(8).alias("width"), F.lit(8).alias("height"), (1 + F.pmod(n, F.lit(13))).alias("to_width"), (1 + F.pmod(F.call_function("div", n, F.lit(13)), F.lit(11))).alias("to_height"))
    return pixels.resized(px, sizes)


_FANCY = "CASE WHEN rim THEN (3 * n.{0} + b.{0} + 2) >> 2 ELSE (((n.{0} + 3 * s.{0} + 3 * b.{0} + a.{0} + 8) >> 3) + n.{0}) >> 1 END AS {0}"


@query(f"""WITH {PX_SQL}, i AS (SELECT *, 7 + img % 2 AS w, 8 - img // 2 % 2 AS h FROM px), y1 AS (SELECT img, x, y, r AS yy, x = 0 OR (x = w - 1 AND x % 2 = 1) AS rim, (w - 1) // 2 AS mx, (h - 1) // 2 AS my FROM i WHERE x < w AND y < h),
c AS (SELECT img, x // 2 AS x, y // 2 AS y, g AS u, b AS v FROM i WHERE x < w AND y < h AND x % 2 = 0 AND y % 2 = 0),
p AS (SELECT *, x // 2 AS nx, y // 2 AS ny, least(mx, greatest(0, x // 2 + CASE WHEN x % 2 = 1 THEN 1 ELSE -1 END)) AS fx, least(my, greatest(0, y // 2 + CASE WHEN y % 2 = 1 THEN 1 ELSE -1 END)) AS fy FROM y1),
d AS (SELECT p.img, p.x, p.y, (yy * 19077) >> 8 AS k, {_FANCY.format('u')}, {_FANCY.format('v')} FROM p JOIN c n ON n.img = p.img AND n.x = nx AND n.y = ny JOIN c s ON s.img = p.img AND s.x = fx AND s.y = ny JOIN c b ON b.img = p.img AND b.x = nx AND b.y = fy JOIN c a ON a.img = p.img AND a.x = fx AND a.y = fy)
SELECT img, x, y, 4278190080 | (least(255, greatest(0, (k + ((v * 26149) >> 8) - 14234) >> 6)) << 16) | (least(255, greatest(0, (k - ((u * 6419) >> 8) - ((v * 13320) >> 8) + 8708) >> 6)) << 8) | least(255, greatest(0, (k + ((u * 33050) >> 8) - 17685) >> 6)) AS argb FROM d""")
def chroma_upsampling(spark, sf_dir):
    """Images of 7 or 8 columns and rows; chroma is that of every other pixel both ways."""
    px = embedding_pixels(spark, sf_dir)
    width, height = 7 + F.pmod("img", F.lit(2)), 8 - F.pmod(F.call_function("div", F.col("img"), F.lit(2)), F.lit(2))
    inside = px.where((F.col("x") < width) & (F.col("y") < height))
    luma = inside.select("img", "x", "y", argb.channel(F.col("argb"), "r").alias("v"))
    half = inside.where("x % 2 = 0 and y % 2 = 0").select("img", F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), argb.channel(F.col("argb"), "g").alias("u"), argb.channel(F.col("argb"), "b").alias("v"))
    return pixels.upsampled(luma, half)


@query(f"""WITH {PX_SQL}, p AS (SELECT img, min(x) AS z FROM px GROUP BY img)
SELECT img AS path, CASE WHEN img % 10 = 9 THEN NULL WHEN img % 10 IN (2, 7) THEN 'bmp' WHEN img % 10 = 4 THEN 'pam' WHEN img % 10 = 8 THEN 'raw' ELSE 'ppm' END AS format,
  CASE WHEN img % 10 IN (5, 8, 9) THEN NULL ELSE CAST(8 AS BIGINT) END AS width, CASE WHEN img % 10 IN (5, 8, 9) THEN NULL ELSE CAST(8 AS BIGINT) END AS height,
  CASE img % 10 WHEN 3 THEN 'truncated' WHEN 5 THEN 'bad_header' WHEN 6 THEN 'unsupported' WHEN 7 THEN 'unsupported' WHEN 8 THEN 'unknown_format' WHEN 9 THEN 'unknown_format' END AS error FROM p""")
def mixed_file_errors(spark, sf_dir):
    """What the readers say of files of several formats, good and bad."""
    return images.read_errors(_mixed_files(spark, sf_dir))


@query(f"WITH {PX_SQL}, {ARGB_SQL} SELECT img, x, y, CASE img % 10 WHEN 2 THEN argb WHEN 4 THEN argb ELSE argb | 4278190080 END AS argb FROM pa WHERE img % 10 IN (0, 1, 2, 4)")
def mixed_file_pixels(spark, sf_dir):
    """The pixels of those of the same files that can be read, whatever their format; three of ten images are BMP or PAM with alpha, the bad ones have no pixels."""
    return images.any_pixels(_mixed_files(spark, sf_dir))


def _mixed_files(spark, sf_dir):
    """(path, content): each image as PPM, BMP or PAM; of every ten, one is cut off, one has no size, one has 16 bits, one is packed, one is something else and one is null."""
    px = embedding_pixels(spark, sf_dir)
    n = F.pmod("path", F.lit(10))
    # A generator keeps a file's making apart from its reading, which names the content many times.
    of = lambda f: f(px).select(F.col("img").alias("path"), F.explode(F.array("content")).alias("content"))
    cut = lambda a, b: F.expr(f"substring(content, {a}, {b})")
    ppm = of(images.to_ppm).where(~n.isin(2, 4, 7)).withColumn("content", F.when(n == 3, cut(1, 100)).when(n == 5, F.lit(b"P6\n8 x\n255\n")).when(n == 6, F.concat(F.lit(b"P6\n8 8\n65535\n"), cut(12, 200), cut(12, 200))).when(n == 8, F.lit(b"something else")).when(n != 9, F.col("content")))
    bmp = of(images.to_bmp).where(n.isin(2, 7)).withColumn("content", F.when(n == 7, F.concat(cut(1, 30), F.lit(b"\1"), cut(32, 1000))).otherwise(F.col("content")))
    return ppm.union(bmp).union(of(images.to_pam).where(n == 4)).select("path", F.explode(F.array("content")).alias("content"))


@query(f"""WITH {PX_SQL}, {ARGB_SQL}, f AS (SELECT img // 10 AS img, CAST(img % 10 AS INT) AS frame_idx, x, y, argb FROM pa),
d AS (SELECT a.img, a.frame_idx, a.x, a.y, a.frame_idx % 4 = 0 AS k, a.frame_idx % 4 = 0 OR b.argb IS NULL OR a.argb <> b.argb AS c FROM f a LEFT JOIN f b ON b.img = a.img AND b.frame_idx = a.frame_idx - 1 AND b.x = a.x AND b.y = a.y),
bo AS (SELECT img, frame_idx, k, min(x) FILTER (WHERE c) AS x0, min(y) FILTER (WHERE c) AS y0, max(x) FILTER (WHERE c) AS x1, max(y) FILTER (WHERE c) AS y1 FROM d GROUP BY ALL)
SELECT img, frame_idx, CASE WHEN k THEN 'key' WHEN x0 IS NULL THEN 'keep' ELSE 'delta' END AS kind, CAST(coalesce(x0 - x0 % 2, 0) AS INT) AS x, CAST(coalesce(y0 - y0 % 2, 0) AS INT) AS y,
  CAST(coalesce(x1 - x0 + x0 % 2, 0) + 1 AS INT) AS width, CAST(coalesce(y1 - y0 + y0 % 2, 0) + 1 AS INT) AS height FROM bo""")
def frame_plans(spark, sf_dir):
    """Ten images make an animation; a key frame comes after three others at most."""
    frames = embedding_pixels(spark, sf_dir).select(F.call_function("div", "img", F.lit(10)).alias("img"), F.pmod("img", F.lit(10)).cast("int").alias("frame_idx"), "x", "y", "argb")
    return animation.frame_plan(frames, kmin=2, kmax=3)


#: All floors at once, each with its own tree: the state is a list of (weight, age, symbols), and every join adds a level to the symbols below it.
_TREES_SQL = """hi AS MATERIALIZED (SELECT channel, value, count(*) AS n FROM (SELECT unnest(['a', 'r', 'g', 'b']) AS channel, unnest([a, r, g, b]) AS value FROM px) GROUP BY ALL),
fl AS (SELECT CAST(1 << k AS BIGINT) AS floor FROM range(24) AS r(k)),
st AS (SELECT channel, floor, list({'w': greatest(n, floor), 'i': i, 's': [value]}) AS nodes, max(i) + 1 AS next FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY value) AS i FROM hi), fl GROUP BY ALL),
tr AS (WITH RECURSIVE t AS (SELECT channel, floor, list_sort(nodes) AS nodes, next, CAST([] AS BIGINT[]) AS joined FROM st
  UNION ALL SELECT channel, floor, list_sort(list_append(nodes[3:], {'w': nodes[1].w + nodes[2].w, 'i': next, 's': nodes[1].s || nodes[2].s})), next + 1, nodes[1].s || nodes[2].s FROM t WHERE len(nodes) > 1) SELECT channel, floor, joined FROM t),
dp AS (SELECT channel, floor, value, count(*) AS length FROM (SELECT channel, floor, unnest(joined) AS value FROM tr) GROUP BY ALL),
ok AS (SELECT channel, min(floor) AS floor FROM (SELECT channel, floor, max(length) AS deep FROM dp GROUP BY ALL) WHERE deep <= 8 GROUP BY channel)"""


@query(f"WITH {PX_SQL}, {_TREES_SQL} SELECT hi.channel AS img, hi.value AS symbol, hi.n, CAST(coalesce(dp.length, 1) AS INT) AS length FROM hi LEFT JOIN ok ON ok.channel = hi.channel LEFT JOIN dp ON dp.channel = hi.channel AND dp.value = hi.value AND dp.floor = ok.floor")
def limited_code_lengths(spark, sf_dir):
    """Codes of at most eight bits for the values of each channel over all images."""
    counts = pixels.histogram(embedding_pixels(spark, sf_dir))
    return transforms.code_lengths(counts.select(F.col("channel").alias("img"), F.col("value").alias("symbol"), "n"), 8)


@query("SELECT event_type AS kind, time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS end, count(*) AS files, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def arrivals_by_time(spark, sf_dir):
    """Events as files that arrive, by kind and six hours of event time."""
    files = table(spark, sf_dir, "events").select(F.col("ts").alias("modificationTime"), F.length("props").cast("long").alias("length"), F.col("event_type").alias("kind"))
    return arrivals.by_time(files, "6 hours", "1 hour", "modificationTime", "length", "kind")


@query(f"WITH {PAGES_SQL} SELECT path, idx, fourcc, payload_start, size FROM ck")
def chunks_by_sql(spark, sf_dir):
    """The chunks of files, asked for in SQL text."""
    sql.register(spark)
    return spark.sql("SELECT path, c.idx, c.fourcc, c.payload_start, c.size FROM {files}, LATERAL riff_chunks(content) AS c", files=page_files(spark, sf_dir))


@query(f"WITH {PAGES_SQL} SELECT path, CAST(w AS INT) AS width, CAST(h AS INT) AS height, 'lossless' AS codec, alpha AS has_alpha, CAST(NULL AS VARCHAR) AS error FROM pg")
def probe_by_sql(spark, sf_dir):
    """The probe of files, asked for in SQL text."""
    sql.register(spark)
    return spark.sql("SELECT path, p.width, p.height, p.codec, p.has_alpha, p.error FROM (SELECT path, webp_probe(content) AS p FROM {files})", files=page_files(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN p_size % 13 <= 2 THEN 'fast' WHEN p_size % 13 <= 7 THEN 'full' WHEN p_size % 13 <= 9 THEN 'best' WHEN p_partkey * 40000 <= 1048576 THEN 'best' WHEN p_partkey * 40000 <= 16777216 THEN 'full' ELSE 'fast' END AS tier FROM part")
def lossy_tiers(spark, sf_dir):
    """Levels of 0 to 9, else sizes of 40,000 pixels times the key."""
    level = F.pmod("p_size", F.lit(13))
    return table(spark, sf_dir, "part").select("p_partkey", batch.lossy_tier(F.when(level <= 9, level), F.col("p_partkey") * 40000).alias("tier"))


_FIELDS = ("", "none", "all", "exif", "icc, xmp", "none,exif", "exif,none", "all,none,EXIF", "gps")


@query(f"""WITH {PAGES_SQL} SELECT path, CAST(NULL AS BLOB) AS icc, CASE WHEN path % 9 IN (0, 2, 3, 5, 7) THEN encode(coalesce(url, '')) END AS exif, CAST(NULL AS BLOB) AS xmp, CASE WHEN path % 9 = 8 THEN 'unknown_field' END AS error FROM pg JOIN pages ON page_id = path""")
def metadata_options(spark, sf_dir):
    """What lists of names keep of each file's sidecars; the files have EXIF only."""
    fields = F.get(F.array(*map(F.lit, _FIELDS)), F.pmod("path", F.lit(len(_FIELDS))).cast("int"))
    return container.selected(page_files(spark, sf_dir), fields)
