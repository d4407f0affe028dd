"""Image files as tables and back: scans, formats of plain pixels, and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.functions import argb
from rastra.functions.bits import ascii_text, be_uint, le_bytes, le_uint
from rastra.operators.batch import format_by_content

#: Pixels of an image that are decoded at most, unless another limit is asked for.
MAX_PIXELS = 100_000_000


def read_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files under the paths; patterns and folders as Spark's binaryFile source takes them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths if isinstance(paths, str) else list(paths))


def sizes(files: DataFrame) -> DataFrame:
    """``files`` with format, width and height from the first bytes alone: PNG, BMP, GIF, PPM and PAM; null for others."""
    content, kind = F.col("content"), format_by_content(F.col("content"))
    head = ascii_text(F.when(kind.isin("ppm", "pam"), content).otherwise(F.substring(content, 1, 1)))  # comments may be of any length
    plain = F.regexp_replace(head, r"#[^\n]*\n", " ")
    ppm = lambda i: F.regexp_extract(plain, r"^P6\s+(\d+)\s+(\d+)\s", i)
    pam = lambda name: F.regexp_extract(plain, rf"\n{name}\s+(\d+)", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    pick = lambda png, bmp, gif, p6, p7: F.when(kind == "png", png).when(kind == "bmp", bmp).when(kind == "gif", gif).when(kind == "ppm", p6).when(kind == "pam", p7)
    width = pick(be_uint(content, 16, 4), le_uint(content, 18, 4), le_uint(content, 6, 2), number(ppm(1)), number(pam("WIDTH")))
    rows = F.abs(F.pmod(le_uint(content, 22, 4) + (1 << 31), F.lit(1 << 32)) - (1 << 31))  # BMP rows from the top have a negative height
    height = pick(be_uint(content, 20, 4), rows, le_uint(content, 8, 2), number(ppm(2)), number(pam("HEIGHT")))
    return files.withColumns({"format": kind, "width": width, "height": height})


def raw_errors(content: Column, width: Column, height: Column, max_pixels: int | None = MAX_PIXELS) -> Column:
    """invalid_dimensions, limit_exceeded, pixel_buffer_mismatch or null for raw pixels of four bytes each."""
    n = width.cast("long") * height
    out = F.when((width < 1) | (height < 1) | (width > 16384) | (height > 16384), "invalid_dimensions")
    out = out.when(n > max_pixels, "limit_exceeded") if max_pixels is not None else out
    return out.when(F.octet_length(content) != 4 * n, "pixel_buffer_mismatch")


def _exploded(images: DataFrame, skip: Column, size: Column | int, stride: Column | None = None, from_below: Column | None = None) -> DataFrame:
    """(img, x, y, digits): a row for each pixel of ``size`` bytes of images (img, width, height, content), as hex digits.

    Rows start every ``stride`` bytes (no gaps if none is given), the last one first where from_below holds. An image is cut into its rows,
    then a row into its pixels, so that no row of the result's making carries more than a row of pixels.
    """
    size = size if isinstance(size, Column) else F.lit(size)
    layout = images.withColumns({"_skip": skip.cast("long"), "_size": size.cast("int"), "_below": F.lit(False) if from_below is None else from_below})
    layout = layout.withColumn("_stride", (F.col("width") * F.col("_size") if stride is None else stride).cast("long"))
    place = lambda y: F.col("_skip") + F.when(F.col("_below"), F.col("height") - 1 - y).otherwise(y) * F.col("_stride")
    cut = lambda y: F.struct(y.alias("y"), F.hex(F.substring(F.col("content"), (place(y) + 1).cast("int"), (F.col("width") * F.col("_size")).cast("int"))).alias("line"))
    rows = layout.select("img", "width", "_size", F.explode(F.transform(F.sequence(F.lit(0), F.col("height").cast("int") - 1), cut)).alias("r")).select("img", "width", "_size", "r.*")
    cell = lambda x: F.struct(x.alias("x"), F.substring(F.col("line"), x * 2 * F.col("_size") + 1, 2 * F.col("_size")).alias("digits"))
    return rows.select("img", "y", F.explode(F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), cell)).alias("c")).select("img", "c.x", "y", "c.digits")


def raw_pixels(files: DataFrame, layout: str = "rgba8", max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """(img, x, y, argb) of raw files (path, width, height, content), four bytes for each pixel, row by row.

    Files for which ``raw_errors`` with the same limit gives an error have no pixels; a limit of None lifts it.
    """
    fine = files.where(raw_errors(F.col("content"), F.col("width"), F.col("height"), max_pixels).isNull()).withColumn("img", F.col("path"))
    return _exploded(fine, F.lit(0), 4).select("img", "x", "y", argb.from_layout(F.col("digits"), layout).alias("argb"))


def _checked(read_in: DataFrame, wrong: Column, bytes_needed: Column, max_pixels: int | None) -> DataFrame:
    """``read_in`` (path, content, width, height, ...) with img and error: bad_header, unsupported (``wrong``), invalid_dimensions, limit_exceeded, truncated or null."""
    n = F.col("width") * F.col("height")
    error = F.when(F.col("width").isNull() | F.col("height").isNull(), "bad_header").when(F.coalesce(wrong, F.lit(True)), "unsupported").when((F.col("width") < 1) | (F.col("height") < 1), "invalid_dimensions")
    error = error.when(n > max_pixels, "limit_exceeded") if max_pixels is not None else error
    error = error.when(F.coalesce(F.octet_length("content") < bytes_needed, F.lit(True)), "truncated")
    return read_in.select("*", F.col("path").alias("img"), F.explode(F.array(error)).alias("error"))


def _ppm(files: DataFrame, max_pixels: int | None) -> DataFrame:
    """PPM and PGM files with where their pixels start, their size, largest value, channels and error."""
    gap = r"(?:\s+#[^\n]*\n|\s+)+"
    head = F.regexp_extract(ascii_text(F.col("content")), rf"^(P[56]{gap}\d{{1,9}}{gap}\d{{1,9}}{gap}\d{{1,5}}\s)", 1)
    numbers = lambda i: F.regexp_extract(F.regexp_replace(F.col("head"), r"#[^\n]*\n", " "), r"^P([56])\s+(\d+)\s+(\d+)\s+(\d+)\s", i).try_cast("long")
    names = dict(kind=1, width=2, height=3, most=4)
    fields = F.struct(F.length("head").alias("skip"), *[numbers(i).alias(n) for n, i in names.items()])
    read_in = files.select("path", "content", F.explode(F.array(head)).alias("head")).select("path", "content", F.inline(F.array(fields)))
    read_in = read_in.withColumn("depth", F.when(F.col("kind") == 5, 1).otherwise(3))
    return _checked(read_in, F.col("most") != 255, F.col("skip") + F.col("depth") * F.col("width") * F.col("height"), max_pixels)


def _pam(files: DataFrame, max_pixels: int | None) -> DataFrame:
    """PAM files with where their pixels start, their size, channels and error."""
    head = F.regexp_extract(ascii_text(F.col("content")), r"^(P7\n(?s:.*?)ENDHDR\n)", 1)
    field = lambda name: F.regexp_extract(F.col("head"), rf"\n{name}\s+(\d{{1,9}})\s", 1).try_cast("long").alias(name.lower())
    fields = F.struct(F.length("head").alias("skip"), *[field(n) for n in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL")])
    read_in = files.select("path", "content", F.explode(F.array(head)).alias("head")).select("path", "content", F.inline(F.array(fields)))
    return _checked(read_in, ~F.col("depth").isin(3, 4) | (F.col("maxval") != 255), F.col("skip") + F.col("depth") * F.col("width") * F.col("height"), max_pixels)


def _bmp(files: DataFrame, max_pixels: int | None) -> DataFrame:
    """BMP files with where their rows start and how long they are, their size, direction, channels and error."""
    at = {"skip": (10, 4), "width": (18, 4), "rows": (22, 4), "bits": (28, 2), "packed": (30, 4)}
    # Bound in a lambda and made columns by a generator, so that plans stay small: each number names the header's bytes many times.
    read = lambda h: F.struct(*[le_uint(h, *place).alias(name) for name, place in at.items()])
    head = F.transform(F.array(F.when(F.octet_length("content") >= 34, F.substring("content", 1, 34))), read)
    read_in = files.select("path", "content", F.inline(head))
    read_in = read_in.withColumns({"below": F.col("rows") < 1 << 31, "depth": F.shiftright("bits", 3)})
    shape = F.struct(F.when(F.col("below"), F.col("rows")).otherwise(F.lit(1 << 32) - F.col("rows")).alias("height"), (F.call_function("div", F.col("width") * F.col("depth") + 3, F.lit(4)) * 4).alias("stride"))
    sized = read_in.select("*", F.inline(F.array(shape)))
    return _checked(sized, ~F.col("bits").isin(24, 32) | (F.col("packed") != 0), F.col("skip") + F.col("stride") * F.col("height"), max_pixels)


def ppm_pixels(files: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """(img, x, y, argb) of PPM and PGM files (P6 and P5, 255 as largest value, comments allowed); files with an error (``read_errors``) have none."""
    fine = _ppm(files, max_pixels).where("error is null")
    digits = F.when(F.length("digits") == 2, F.repeat("digits", F.lit(3))).otherwise(F.col("digits"))
    return _exploded(fine, F.col("skip"), F.col("depth")).select("img", "x", "y", argb.from_layout(F.concat(digits, F.lit("FF")), "rgba8").alias("argb"))


def pam_pixels(files: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """(img, x, y, argb) of PAM files (three or four channels, 255 as largest value); files with an error (``read_errors``) have none."""
    fine = _pam(files, max_pixels).where("error is null")
    return _exploded(fine, F.col("skip"), F.col("depth")).select("img", "x", "y", argb.from_layout(F.rpad("digits", 8, "FF"), "rgba8").alias("argb"))


def bmp_pixels(files: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """(img, x, y, argb) of BMP files with 24 or 32 bits a pixel and no compression, rows from the top or from below; files with an error have none.

    The fourth byte of 32 bits is alpha, as ``to_bmp`` writes it, unless it is 0 in all pixels of a file: then it is no alpha, and the image is opaque.
    """
    fine = _bmp(files, max_pixels).where("error is null")
    body = F.hex(F.substring(F.col("content"), (F.col("skip") + 1).cast("int"), (F.col("stride") * F.col("height")).cast("int")))
    fine = fine.withColumn("clear", (F.col("depth") == 4) & (F.length(F.rtrim(F.regexp_replace(body, ".{6}(..)", "$1"), F.lit("0"))) == 0))
    # The mark goes along in the name, which rows keep.
    marked = fine.withColumn("img", F.struct(F.col("path").alias("path"), "clear"))
    pixel = argb.from_layout(F.rpad("digits", 8, "FF"), "bgra8")
    return _exploded(marked, F.col("skip"), F.col("depth"), F.col("stride"), F.col("below")).select(F.col("img.path").alias("img"), "x", "y", F.when(F.col("img.clear"), argb.opaque(pixel)).otherwise(pixel).alias("argb"))


#: The formats that any_pixels() reads, each with its header reader and its pixel reader.
_READERS = {"ppm": (_ppm, ppm_pixels), "pam": (_pam, pam_pixels), "bmp": (_bmp, bmp_pixels)}


def _told(files: DataFrame) -> DataFrame:
    """Files with their format; PGM is read as PPM is."""
    gray = F.substring("content", 1, 2) == F.lit(b"P5")
    return files.select("path", "content", F.when(gray, "ppm").when(F.col("content").isNotNull(), format_by_content(F.col("content"))).alias("format"))


def read_errors(files: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """(path, format, width, height, error), one row for each file: what any_pixels() would do with it.

    error is unknown_format (no reader here), bad_header, unsupported (bits, channels or packing), invalid_dimensions, limit_exceeded, truncated, or null.
    A null content has no format. Only headers are read; nothing is shuffled.
    """
    told = _told(files)
    columns = ["path", "format", "width", "height", "error"]
    out = told.where(~F.coalesce(F.col("format").isin(*_READERS), F.lit(False))).select("path", "format", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit("unknown_format").alias("error"))
    for name, (header, _) in _READERS.items():
        out = out.union(header(told.where(F.col("format") == name), max_pixels).withColumn("format", F.lit(name)).select(columns))
    return out


def any_pixels(files: DataFrame, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """(img, x, y, argb) of files of any format that has a reader here, told by content; files with an error (``read_errors``) have no pixels."""
    told, parts = _told(files), []
    for name, (_, reader) in _READERS.items():
        parts.append(reader(told.where(F.col("format") == name), max_pixels))
    return reduce(DataFrame.union, parts)


#: Spark's image source: the modes of one, three and four bytes a pixel; fixed values.
IMAGE_MODES = {1: 0, 3: 16, 4: 24}


def image_pixels(rows: DataFrame) -> DataFrame:
    """(img, x, y, argb) of the rows (image) that Spark's ``image`` source reads: gray, BGR or BGRA; what it could not read has none."""
    flat = rows.select(F.col("image.origin").alias("path"), F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("content"))
    whole = _checked(flat, ~F.col("n").isin(*IMAGE_MODES), F.col("n") * F.col("width") * F.col("height"), None).where("error is null")
    cells = _exploded(whole, F.lit(0), F.col("n"))
    digits = F.when(F.length("digits") == 2, F.repeat("digits", F.lit(3))).otherwise(F.col("digits"))
    return cells.select("img", "x", "y", argb.from_layout(F.rpad(digits, 8, "FF"), "bgra8").alias("argb"))


def to_image_rows(pixels: DataFrame) -> DataFrame:
    """(image): complete images as rows of the schema of Spark's ``image`` source, with four channels."""
    whole = _lines(pixels, argb.to_layout(F.col("argb"), "bgra8"))
    return whole.select(F.struct(F.col("img").cast("string").alias("origin"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.lit(4).alias("nChannels"), F.lit(IMAGE_MODES[4]).alias("mode"), F.col("body").alias("data")).alias("image"))


def _lines(pixels: DataFrame, digits: Column) -> DataFrame:
    """(img, width, height, body): pixels' bytes row by row. An image is put together from its rows, each from its pixels."""
    rows = pixels.groupBy("img", "y").agg(F.count("*").alias("w"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", digits.alias("d")))), lambda p: p["d"]), "").alias("line"))
    whole = rows.groupBy("img").agg(F.max("w").alias("width"), F.count("*").alias("height"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]), "").alias("digits"))
    return whole.select("img", "width", "height", F.unhex("digits").alias("body"))


def to_raw(pixels: DataFrame, layout: str = "rgba8") -> DataFrame:
    """(img, width, height, content): complete images as raw bytes in a layout."""
    return _lines(pixels, argb.to_layout(F.col("argb"), layout)).withColumnRenamed("body", "content")


def to_ppm(pixels: DataFrame) -> DataFrame:
    """(img, content): PPM files; alpha is left out."""
    head = F.format_string("P6\n%d %d\n255\n", "width", "height").cast("binary")
    return _lines(pixels, F.substring(argb.to_layout(F.col("argb"), "rgba8"), 1, 6)).select("img", F.concat(head, "body").alias("content"))


def to_pam(pixels: DataFrame) -> DataFrame:
    """(img, content): PAM files with alpha."""
    head = F.format_string("P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n", "width", "height").cast("binary")
    return _lines(pixels, argb.to_layout(F.col("argb"), "rgba8")).select("img", F.concat(head, "body").alias("content"))


def to_bmp(pixels: DataFrame) -> DataFrame:
    """(img, content): BMP files of 32 bits a pixel, rows from the top (a negative height)."""
    whole = _lines(pixels, argb.to_layout(F.col("argb"), "bgra8"))
    size = F.octet_length("body")
    four = lambda c: le_bytes(c, 4)
    negative = F.lit(1 << 32) - F.col("height")
    head = F.concat(F.lit(b"BM"), four(size + 54), four(F.lit(0)), four(F.lit(54)), four(F.lit(40)), four(F.col("width")), four(negative), le_bytes(F.lit(1), 2), le_bytes(F.lit(32), 2), four(F.lit(0)), four(size), four(F.lit(2835)), four(F.lit(2835)), four(F.lit(0)), four(F.lit(0)))
    return whole.select("img", F.concat(head, "body").alias("content"))


def to_planar_yuv(pixels: DataFrame) -> DataFrame:
    """(img, content): Y, then U and V at half size, one byte for each."""
    from rastra.operators.pixels import chroma_planes

    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    y = _lines(pixels.withColumn("v", argb.luma(F.col("argb"))), byte(F.col("v"))).select("img", F.col("body").alias("y"))
    planes = chroma_planes(pixels)
    u = _lines(planes, byte(F.col("u"))).select("img", F.col("body").alias("u"))
    v = _lines(planes, byte(F.col("v"))).select("img", F.col("body").alias("v"))
    return y.join(u, "img").join(v, "img").select("img", F.concat("y", "u", "v").alias("content"))


def fnv1a(content: Column) -> Column:
    """The 64-bit FNV-1a hash of bytes, unsigned, as decimal(20,0); a small Arrow helper, since Spark's numbers don't wrap.

    Each byte is a step in Python: meant for addresses and names, not for pixels.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for value in values:
            data = value.as_py()
            h = 0xCBF29CE484222325
            for byte in data or b"":
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            out.append(None if data is None else str(h))
        return pa.array(out, pa.string())

    return run(content).cast("decimal(20,0)")


def formula_pixels(spark: SparkSession, name: str, width: int, height: int, formula: tuple[str, str, str, str]) -> DataFrame:
    """(img, x, y, argb): an image of SQL formulas over x and y for red, green, blue and alpha, each taken modulo 256."""
    at = spark.range(width * height).selectExpr(f"cast(id % {width} as int) as x", f"cast(id div {width} as int) as y")
    channel = [F.expr(f).cast("long").bitwiseAND(F.lit(255)) for f in formula]
    return at.select(F.lit(name).alias("img"), "x", "y", argb.pack(channel[3], *channel[:3]).alias("argb"))


def write_files(files: DataFrame, folder: str, overwrite: str = "error") -> DataFrame:
    """Write (name, content) as one file each and return (name, outcome, out_bytes).

    Tasks write beside the target and rename, so a lost or repeated task leaves no half file. ``folder`` is a path that every executor
    mounts; a name may have folders of its own in it. Names that are null, absolute or lead out of the folder fail, and so do null
    contents. overwrite: error (existing files fail), skip or replace; it also decides between rows of one name, of which one is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for batch in batches:
            outcome, size = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside = os.path.normpath(name or ".")
                target = os.path.join(folder, inside)
                if inside.split(os.sep)[0] in ("", ".", "..") or content is None:
                    outcome.append("failed")
                elif os.path.exists(target) and overwrite != "replace":
                    outcome.append("skipped" if overwrite == "skip" else "failed")
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as file:
                        file.write(content)
                    outcome.append("converted")
                    try:
                        if overwrite == "replace":
                            os.replace(part, target)
                        else:
                            os.link(part, target)  # fails if another task wrote the name in the meantime
                            os.remove(part)
                    except FileExistsError:
                        os.remove(part)
                        outcome[-1] = "skipped" if overwrite == "skip" else "failed"
                    except OSError:  # no hard links here
                        os.replace(part, target)
                size.append(len(content or b"") if outcome[-1] == "converted" else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outcome), pa.array(size, pa.int64())], names=["name", "outcome", "out_bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, outcome string, out_bytes long")


