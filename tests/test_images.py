"""Image operators: every query against its SQL, formula images against known hashes, and corner cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from rastra.functions import argb, riff
from rastra.operators import animation, container, pixels, transforms
from rastra.plans.queries import ORACLE_SQL, QUERIES
from rastra.sources import images
from rastra.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return bytes(v).hex() if isinstance(v, bytearray | bytes) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def band(i):
    return (f"16 * ({i}) + 8", f"53 * ({i}) + 17", f"101 * ({i}) + 29", "255")


#: Size, formulas and the FNV-1a hash of the RGBA bytes; fixed values.
FORMULAS = {
    "palette_2color": (32, 8, ("if(x < 16, 10, 200)", "if(x < 16, 20, 100)", "if(x < 16, 30, 50)", "255")),
    "palette_4color": (32, 8, band("4 * x div 32")),
    "palette_16color": (32, 32, band("16 * x div 32")),
    "palette_256color": (256, 16, ("x", "7 * x", "13 * x", "255")),
    "gradient_rgb": (64, 64, ("4 * x", "4 * y", "2 * (x + y)", "255")),
    "cross_color_corr": (64, 64, ("4 * x + y", "4 * x", "4 * x + 2 * y", "255")),
    "alpha_gradient": (32, 32, ("8 * x", "8 * y", "128", "8 * (x + y)")),
    "all_transparent": (8, 8, ("123", "45", "67", "0")),
    "single_pixel_1x1": (1, 1, ("17", "34", "51", "255")),
    "color_cache_scatter": (32, 32, band("(5 * x + 11 * y) % 12")),
}


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def test_formula_images_have_their_known_hash(spark):
    w, h, formula = FORMULAS["gradient_rgb"]
    px = images.formula_pixels(spark, "gradient_rgb", w, h, formula)
    assert int(images.to_raw(px).select(images.fnv1a(F.col("content"))).first()[0]) == 13432808325684651301


def test_raw_ppm_bmp_yuv_round_trips(spark):
    w, h, formula = FORMULAS["alpha_gradient"]
    px = images.formula_pixels(spark, "a", w, h, formula)
    key = lambda df: sorted(tuple(r) for r in df.select("img", "x", "y", "argb").collect())
    for layout in argb.LAYOUTS:
        raw = images.to_raw(px, layout).withColumnRenamed("img", "path")
        assert key(images.raw_pixels(raw, layout)) == key(px)
        assert images.raw_pixels(raw.withColumn("width", F.col("width") + 1), layout).count() == 0
    ppm = images.to_ppm(px).withColumnRenamed("img", "path")
    assert key(images.ppm_pixels(ppm)) == key(px.withColumn("argb", argb.opaque(F.col("argb"))))
    commented = ppm.withColumn("content", F.concat(F.lit(b"P6\n# a comment\n32 32\n255\n"), F.expr("substring(content, 14)")))
    assert images.ppm_pixels(commented).count() == w * h
    found = {r["format"]: (r["width"], r["height"]) for t in (images.to_ppm(px), images.to_pam(px), images.to_bmp(px)) for r in images.sizes(t.withColumnRenamed("img", "path")).collect()}
    assert found["ppm"] == found["pam"] == (32, 32) and found["bmp"][0] == 32
    assert len(images.to_planar_yuv(px).first()["content"]) == w * h * 3 // 2


def test_bad_files_give_errors_not_failures(spark):
    good = b"RIFF" + (18).to_bytes(4, "little") + b"WEBP" + b"VP8L" + (5).to_bytes(4, "little") + b"\x2f\x04\x00\x01\x10" + b"\0"
    rows = [("good", good), ("cut", good[:23]), ("short", b"RIFF"), ("other", b"RIFX" + good[4:]), ("none", None), ("frames", good[:12] + b"ANMF" + (0).to_bytes(4, "little")), ("empty", good[:12])]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in container.images(files).collect()}
    assert {p: r["error"] for p, r in got.items()} == {"good": None, "cut": "truncated", "short": "truncated", "other": "not_webp", "none": "truncated", "frames": "invalid_container", "empty": "missing_image"}
    assert (got["good"]["width"], got["good"]["height"], got["good"]["has_alpha"]) == (5, 5, True)
    assert [r["path"] for r in container.chunks(files).where("fourcc = 'VP8L'").collect()] == ["good"]
    again = container.with_metadata(files.where("path = 'good'"), *[F.lit(None).cast("binary")] * 3, F.lit(5), F.lit(5))
    assert bytes(again.first()["content"]) == good
    set_one = container.with_metadata(files.where("path = 'good'"), F.lit(None).cast("binary"), F.lit(b"odd"), F.lit(None).cast("binary"), F.lit(5), F.lit(5))
    assert bytes(container.metadata(set_one).first()["exif"]) == b"odd"
    assert container.images(files.limit(0)).count() == 0


def test_first_of_repeated_sidecars_counts(spark):
    body = F.concat(riff.chunk("EXIF", F.lit(b"one")), riff.chunk("EXIF", F.lit(b"two")))
    files = spark.range(1).select(F.lit("p").alias("path"), riff.envelope(body).alias("content"))
    assert bytes(container.metadata(files).first()["exif"]) == b"one"


def frame(i, x, y, w, h, argb_, blend="blend", dispose="keep", alpha=True):
    return ("p", i, x, y, w, h, 2, 2, 10, blend, dispose, alpha, argb_)


def test_compositing_rules(spark):
    red, half = 0xFFFF0000, 0x80123457
    rows = [
        frame(0, 0, 0, 2, 2, [half] * 4, dispose="background"),  # a key frame: taken as it is
        frame(1, 0, 0, 1, 1, [half]),  # after a full frame that was disposed: a key frame again
        frame(2, 0, 0, 1, 2, [0, red], dispose="background"),  # transparent keeps, opaque covers
        frame(3, 0, 0, 2, 1, [half, half]),  # raw where the last frame was cleared
    ]
    table = spark.createDataFrame(rows, "path string, frame_idx int, x int, y int, width int, height int, canvas_w int, canvas_h int, duration_ms int, blend string, dispose string, has_alpha boolean, argb array<long>")
    got = [r["argb"] for r in animation.composited(table).orderBy("frame_idx").collect()]
    over = spark.range(1).select(argb.over(F.lit(half), F.lit(0).cast("long"))).first()[0]
    assert got == [[half] * 4, [half, 0, 0, 0], [half, 0, red, 0], [half, over, 0, 0]]


def test_all_predictors_are_within_a_byte_and_undone(spark):
    w, h, formula = FORMULAS["alpha_gradient"]
    px = images.formula_pixels(spark, "a", 6, 5, formula)
    source = {(r["x"], r["y"]): r["argb"] for r in px.collect()}
    for mode in range(14):
        left = {(r["x"], r["y"]): r["argb"] for r in transforms.residuals(px, mode).collect()}
        assert left.keys() == source.keys() and left[0, 0] == (source[0, 0] & 0xFFFFFF) | ((source[0, 0] >> 24) - 255 & 255) << 24
    del w, h
    assert transforms.near_lossless_bits(100) == 0 and transforms.near_lossless_bits(0) == 5 and transforms.near_lossless_bits(80) == 1
    assert transforms.near_lossless_passes(px, 60).count() == 30


def test_size_mismatch_is_an_error(spark):
    a = images.formula_pixels(spark, "a", 4, 4, ("x", "y", "0", "255"))
    b = images.formula_pixels(spark, "a", 5, 4, ("x", "y", "0", "255"))
    assert pixels.compare(a, b).first()["error"] == "size_mismatch"
    same = pixels.compare(a, a).first()
    assert same["psnr"] is None and same["max_delta"] == 0


def test_pieces_do_not_change_the_events():
    body = b"".join(n + len(p).to_bytes(4, "little") + p + b"\0" * (len(p) % 2) for n, p in ((b"VP8X", b"x" * 10), (b"VP8L", b"y" * 33), (b"EXIF", b"")))
    data = b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body
    whole = incremental.advance(None, [data])[1]
    assert [e[0] for e in whole] == ["header", "chunk", "chunk", "chunk", "finished"]
    for step in (1, 3, 7, 20):
        state, events = None, []
        for i in range(0, len(data), step):
            state, new = incremental.advance(state, [data[i : i + step]])
            events += new
            assert len(state[0]) < 12
        assert events == whole
    assert incremental.advance(None, [b"no such file"])[1][0][0] == "error"


def test_streamed_files(spark, tmp_path):
    body = b"VP8L" + (6).to_bytes(4, "little") + b"\x2f\x04\x00\x01\x10\x00"
    data = b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body
    for n, part in enumerate((data[:9], data[9:21], data[21:])):
        spark.createDataFrame([("p", n, part)], "path string, seq int, bytes binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pieces = spark.readStream.schema("path string, seq int, bytes binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.chunk_events(pieces).writeStream.format("memory").queryName("chunk_events").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["event"] for r in spark.table("chunk_events").collect()) == ["chunk", "finished", "header"]


def test_written_files(spark, tmp_path):
    px = images.formula_pixels(spark, "a", 4, 4, ("x", "y", "0", "255"))
    files = images.to_ppm(px).select(F.lit("a.ppm").alias("name"), "content")
    assert images.write_files(files, str(tmp_path)).first()["outcome"] == "converted"
    assert images.write_files(files, str(tmp_path)).first()["outcome"] == "failed"
    assert images.write_files(files, str(tmp_path), "skip").first()["outcome"] == "skipped"
    assert os.listdir(tmp_path) == ["a.ppm"]
    assert images.read_files(spark, str(tmp_path), "*.ppm").count() == 1


def test_shrink_takes_every_image_with_its_alpha(spark):
    images = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = QUERIES["shrink"](spark, SF).collect()
    assert len(got) == 16 * images and any(0 < r["argb"] >> 24 < 255 for r in got)


def test_a_bad_frame_ends_its_animation_only(spark):
    schema = "path string, frame_idx int, x int, y int, width int, height int, canvas_w int, canvas_h int, duration_ms int, blend string, dispose string, has_alpha boolean, argb array<long>"
    rows = [frame(0, 0, 0, 2, 1, [1, 2]), frame(1, 1, 0, 2, 1, [3, 4]), frame(2, 0, 0, 2, 1, [5, 6])]
    rows += [("other", *r[1:]) for r in (rows[0], rows[2])] + [("short", *frame(0, 0, 0, 2, 1, [7])[1:]), ("null", *frame(0, 0, 0, 2, 1, None)[1:])]
    got = {(r["path"], r["frame_idx"], r["error"]) for r in animation.composited(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("p", 0, None), ("p", 1, "invalid_container"), ("other", 0, None), ("other", 2, None), ("short", 0, "invalid_container"), ("null", 0, "invalid_container")}


def test_near_lossless_leaves_small_images_alone(spark):
    px = spark.range(6 * 63).selectExpr("'s' AS img", "cast(id % 6 as int) AS x", "cast(id div 6 as int) AS y", "cast(4278190080 + pmod(id * 7919 * 7919, 16777216) as bigint) AS argb")
    wide = spark.range(6 * 64).selectExpr("'w' AS img", "cast(id % 64 as int) AS x", "cast(id div 64 as int) AS y", "cast(4278190080 + pmod(id * 7919 * 7919, 16777216) as bigint) AS argb")
    before = {tuple(r) for r in px.union(wide).collect()}
    after = {tuple(r) for r in transforms.near_lossless_passes(px.union(wide), 0).collect()}
    assert {r for r in before - after if r[0] == "s"} == set() and {r for r in before - after if r[0] == "w"} != set()


def test_bmp_from_below_and_pam_of_three_channels(spark):
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\1\0" + (24).to_bytes(2, "little") + bytes(24)
    below, above = bytes(range(1, 10)), bytes(range(11, 20))
    bmp = head + below + b"\0" * 3 + above + b"\0" * 3
    pam = b"P7\n# WIDTH 9\nWIDTH 3\nHEIGHT 1\nDEPTH 3\nMAXVAL 255\nENDHDR\n" + below
    files = spark.createDataFrame([("b", bmp), ("cut", bmp[:-1]), ("p", pam), ("short", pam[:-1]), ("none", None), ("empty", b"")], "path string, content binary").withColumns({"skip": F.lit("clash"), "depth": F.lit(7)})
    got = {(r["x"], r["y"]): r["argb"] for r in images.bmp_pixels(files).collect() if r["img"] == "b"}
    assert len(got) == 6 and got[0, 0] == 0xFF0D0C0B and got[2, 1] == 0xFF090807
    assert {r["img"] for r in images.bmp_pixels(files).collect()} == {"b"}
    assert {(r["img"], r["x"], r["argb"]) for r in images.pam_pixels(files).collect()} == {("p", 0, 0xFF010203), ("p", 1, 0xFF040506), ("p", 2, 0xFF070809)}
    assert images.bmp_pixels(files.limit(0)).count() == images.pam_pixels(files.limit(0)).count() == 0


def test_image_source_pixels(spark, tmp_path):
    px = images.formula_pixels(spark, "a", 5, 3, ("40 * x", "70 * y", "9 * (x + y)", "255"))
    (tmp_path / "a.bmp").write_bytes(images.to_bmp(px).first()["content"])
    ours = {(r["x"], r["y"], r["argb"]) for r in px.collect()}
    assert {(r["x"], r["y"], r["argb"]) for r in images.image_pixels(spark.read.format("image").load(str(tmp_path))).collect()} == ours
    gray = spark.createDataFrame([(("g", 1, 2, 1, 0, b"\x05\xff"),), (("bad", -1, -1, -1, -1, b""),)], "image struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    assert [r["argb"] for r in images.image_pixels(gray).orderBy("x").collect()] == [0xFF050505, 0xFFFFFFFF]


def test_written_names_keep_their_folders(spark, tmp_path):
    rows = [("a/x.bin", b"1"), ("b/x.bin", b"2"), ("../out.bin", b"3"), ("/etc/none", b"4"), (None, b"5"), ("n", None), ("twice", b"6"), ("twice", b"7")]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    got = sorted((str(r["name"]), r["outcome"]) for r in images.write_files(files, str(tmp_path / "in")).collect())
    assert got == [("../out.bin", "failed"), ("/etc/none", "failed"), ("None", "failed"), ("a/x.bin", "converted"), ("b/x.bin", "converted"), ("n", "failed"), ("twice", "converted"), ("twice", "failed")]
    assert (tmp_path / "in/a/x.bin").read_bytes() == b"1" and (tmp_path / "in/b/x.bin").read_bytes() == b"2" and not (tmp_path / "out.bin").exists()


def test_raw_limit_can_be_lifted(spark):
    raw = images.to_raw(images.formula_pixels(spark, "a", 4, 4, ("x", "y", "0", "255"))).withColumnRenamed("img", "path")
    assert images.raw_pixels(raw, max_pixels=15).count() == 0 and images.raw_pixels(raw, max_pixels=None).count() == 16


def test_idle_files_are_abandoned(spark, tmp_path):
    schema, data = "path string, seq int, bytes binary", b"RIFF" + (50).to_bytes(4, "little") + b"WEBP"
    add = lambda name, piece: spark.createDataFrame([(name, 0, piece)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add("slow", data)
    stream = incremental.chunk_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), idle="100 ms")
    start = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    start()
    add("other", b"no such file")
    start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r["path"], r["event"], r["size"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {("slow", "header", 58), ("slow", "abandoned", 12), ("other", "error", None)} <= got


def test_alpha_flag_of_animations_survives_new_metadata(spark):
    rows = spark.createDataFrame([("p", 0, 0, 0, 4, 4, 10, "blend", "keep", b"")], "path string, frame_idx int, x long, y long, width long, height long, duration_ms long, blend string, dispose string, payload binary")
    null = F.lit(None).cast("binary")
    for alpha in (True, False):
        edited = container.with_metadata(animation.write(rows, alpha=alpha), null, F.lit(b"e"), null, F.lit(4), F.lit(4))
        head = container.chunks(edited).where("fourcc = 'VP8X'").select(riff.read_vp8x(F.col("payload")).alias("x")).first()["x"]
        assert (head["has_alpha"], head["has_exif"], head["is_animated"]) == (alpha, True, True)
