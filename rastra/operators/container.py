"""Files as relations: chunks, images, metadata, and files rebuilt from them.

``files`` has path and content (the columns of Spark's binaryFile source). A bad file never fails the job: it has
no chunks, and an error code in ``images``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.functions import riff
from rastra.functions.bits import le_uint

SIDECARS = {"icc": "ICCP", "exif": "EXIF", "xmp": "XMP "}


def chunks(files: DataFrame, lenient: bool = False) -> DataFrame:
    """(path, idx, fourcc, payload_start, size, truncated, payload), one row for each chunk of each file."""
    found = files.select("path", "content", F.explode(riff.places(F.col("content"), lenient=lenient)).alias("c")).select("path", "content", "c.*")
    payload = F.substring(F.col("content"), (F.col("payload_start") + 1).cast("int"), F.col("size").cast("int"))
    return found.withColumn("payload", payload).drop("content")


def nested_chunks(files: DataFrame) -> DataFrame:
    """(path, parent_idx, idx, fourcc, payload_start, size): every chunk, and the chunks inside frames, whose parent_idx is their frame's idx.

    Places count from the start of the file. A frame shorter than its header has no chunks inside; nothing is shuffled.
    """
    top = chunks(files)
    inner = riff.places(F.when(F.col("fourcc") == "ANMF", F.col("payload")), start=riff.FRAME_HEADER)
    row = lambda parent, c, base: F.struct(parent.cast("int").alias("parent_idx"), c["idx"].alias("idx"), c["fourcc"].alias("fourcc"), (base + c["payload_start"]).alias("payload_start"), c["size"].alias("size"))
    own = F.struct(*[F.col(c) for c in ("idx", "fourcc", "payload_start", "size")])
    listed = top.select("path", "idx", "payload_start", own.alias("own"), inner.alias("inner"))
    return listed.select("path", F.inline(F.concat(F.array(row(F.lit(None), F.col("own"), F.lit(0))), F.coalesce(F.transform("inner", lambda c: row(F.col("idx"), c, F.col("payload_start"))), F.array()))))


def completeness(files: DataFrame) -> DataFrame:
    """(path, declared_length, is_complete): what the header promises against what is there; null length if it is no such file."""
    content = F.col("content")
    header = (F.octet_length(content) >= 12) & (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    declared = F.when(header, le_uint(content, 4, 4) + 8)
    return files.select("path", declared.alias("declared_length"), F.coalesce(F.octet_length(content) >= declared, F.lit(False)).alias("is_complete"))


def first_chunk(name: str) -> Column:
    """The first chunk of a name in column places; null if there is none."""
    return F.get(F.filter("places", lambda c: c["fourcc"] == name), F.lit(0))


def chunk_bytes(place: Column, most: int | None = None) -> Column:
    """The bytes (of which at most so many) of a chunk of column content; null without a chunk."""
    size = place["size"] if most is None else F.least(place["size"], F.lit(most))
    return F.when(place.isNotNull(), F.substring(F.col("content"), (place["payload_start"] + 1).cast("int"), size.cast("int")))


def has_chunk(*names: str) -> Column:
    return F.coalesce(F.exists("places", lambda c: c["fourcc"].isin(*names)), F.lit(False))


def described(files: DataFrame, carried: Sequence[str] = (), parts: Mapping[str, Column] | None = None) -> DataFrame:
    """The columns of images(), places, columns of ``files`` that are carried along, and parts: expressions over path, content and places.

    Each file is looked at alone, in its row.
    """
    parts = parts or {}
    content = F.col("content")
    walked = files.select("path", "content", *carried, riff.places(content, lenient=True).alias("places"))
    magic = (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    cut = F.coalesce(F.exists("places", lambda c: c["fourcc"].isin("VP8L", "VP8 ") & c["truncated"]), F.lit(False))
    heads = walked.select(
        "path", "places", *carried, *[c.alias(name) for name, c in parts.items()], (content.isNull() | (F.octet_length(content) < 12)).alias("short"), F.coalesce(magic, F.lit(False)).alias("magic"), cut.alias("cut"), has_chunk("ALPH").alias("alph"),
        has_chunk(*SIDECARS.values()).alias("has_metadata"), has_chunk("ANIM", "ANMF").alias("frames"), *[chunk_bytes(first_chunk(fourcc), 32).alias(name) for name, fourcc in (("x", "VP8X"), ("l", "VP8L"), ("v", "VP8 "))],
    )
    read = heads.withColumns({"x": riff.read_vp8x(F.col("x")), "l": riff.read_vp8l_header(F.col("l")), "v": riff.read_vp8_header(F.col("v"))})
    size = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"l.{c}"), F.col(f"v.{c}")).cast("int")
    animated = F.coalesce(F.col("x.is_animated"), F.lit(False))
    alpha = F.when(animated, F.col("x.has_alpha")).otherwise(F.coalesce(F.col("l.has_alpha"), F.col("alph")))
    codec = F.when(~animated, F.when(F.col("l").isNotNull(), "lossless").when(F.col("v").isNotNull(), "lossy"))
    error = F.when(F.col("short"), "truncated").when(~F.col("magic"), "not_webp").when(F.col("frames") & ~animated, "invalid_container").when(size("width").isNull() & F.col("cut"), "truncated").when(size("width").isNull(), "missing_image")
    # A file that is no container has neither an alpha flag nor another.
    known = lambda c: F.when(F.size("places") > 0, c)
    return read.select("path", "places", *carried, *parts, size("width").alias("width"), size("height").alias("height"), codec.alias("codec"), known(alpha).alias("has_alpha"), "has_metadata", known(animated).alias("is_animated"), error.alias("error"))


def images(files: DataFrame) -> DataFrame:
    """(path, width, height, codec, has_alpha, has_metadata, is_animated, error), one row for each file, from headers alone.

    Of repeated chunks the first counts. error is not_webp, truncated (shorter than a file header, or cut off in the image's header), invalid_container (frames without an
    animation header), missing_image, or null. Nothing is shuffled; repeated paths are files of their own.
    """
    return described(files).drop("places")


def metadata(files: DataFrame) -> DataFrame:
    """(path, icc, exif, xmp): each sidecar's first chunk, else null; files without chunks have no row."""
    walked = files.select("path", "content", riff.places(F.col("content")).alias("places")).where("size(places) > 0")
    return walked.select("path", *[chunk_bytes(first_chunk(fourcc)).alias(name) for name, fourcc in SIDECARS.items()])


def resolved(old: Column, new: Column, keep: Column) -> Column:
    """A sidecar after an edit: the new one if there is one, else the old one if it may stay."""
    return F.coalesce(new, F.when(keep, old))


def selection(fields: Column) -> Column:
    """struct(icc, exif, xmp, error): what a list such as "none,exif" keeps: names add up from the left, all and none begin anew; null and empty lists keep all.

    A name that is none of all, none, icc, exif and xmp (case and blanks aside) is the error unknown_field, and nothing is kept.
    """
    names = F.filter(F.transform(F.split(F.coalesce(fields, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    build = lambda values: F.struct(*[v.alias(n) for n, v in zip(SIDECARS, values, strict=True)])
    step = lambda s, t: build([F.when(t == "all", True).when(t == "none", False).otherwise(s[n] | (t == n)) for n in SIDECARS])
    kept = F.aggregate(names, build([F.size(names) == 0] * len(SIDECARS)), step)
    wrong = F.exists(names, lambda t: ~t.isin("all", "none", *SIDECARS))
    return F.struct(*[(kept[n] & ~wrong).alias(n) for n in SIDECARS], F.when(wrong, "unknown_field").alias("error"))


def selected(files: DataFrame, fields: Column) -> DataFrame:
    """(path, icc, exif, xmp, error): each file's sidecars (as ``metadata``) that a list of names over ``files`` keeps."""
    walked = files.select("path", "content", selection(fields).alias("keep"), riff.places(F.col("content")).alias("places")).where("size(places) > 0")
    return walked.select("path", *[F.when(F.col(f"keep.{n}"), chunk_bytes(first_chunk(fourcc))).alias(n) for n, fourcc in SIDECARS.items()], F.col("keep.error").alias("error"))


def with_metadata(files: DataFrame, icc: Column, exif: Column, xmp: Column, width: Column, height: Column) -> DataFrame:
    """(path, content): files whose sidecars are replaced (null: none). Other chunks keep their bytes and order.

    The order is VP8X, ICCP, the rest, EXIF, XMP; VP8X is written only for a sidecar, separate alpha or an animation. Its alpha flag is
    an animation's old one, else that of the image.
    ``icc``, ``exif``, ``xmp`` are binary expressions over ``files``, the sizes are the canvas's.
    """
    edits = files.select("path", "content", icc.alias("icc"), exif.alias("exif"), xmp.alias("xmp"), width.alias("w"), height.alias("h"), riff.places(F.col("content")).alias("places"))
    rest = F.filter("places", lambda c: ~c["fourcc"].isin("VP8X", *SIDECARS.values()))
    kept = edits.withColumn("rest", rest).where("size(rest) > 0")
    # As hex digits, because those are joined in one go; a fold over bytes would copy the growing body for each chunk.
    digits = lambda c: F.concat(F.hex(F.substring(F.col("content"), (c["payload_start"] - 7).cast("int"), (c["size"] + 8).cast("int"))), F.when(c["size"] % 2 == 1, "00").otherwise(""))
    bodies = kept.select("path", "icc", "exif", "xmp", "w", "h", has_chunk("ALPH").alias("apart"), has_chunk("ANIM", "ANMF").alias("animated"), *[chunk_bytes(first_chunk(fourcc), 32).alias(name) for name, fourcc in (("x", "VP8X"), ("l", "VP8L"))], F.unhex(F.array_join(F.transform("rest", digits), "")).alias("body"))
    has = [F.col(c).isNotNull() for c in ("icc", "exif", "xmp")]
    alpha = F.when(F.col("animated"), riff.read_vp8x(F.col("x"))["has_alpha"]).otherwise(F.col("apart") | F.coalesce(riff.read_vp8l_header(F.col("l"))["has_alpha"], F.lit(False)))
    flags = riff.vp8x_flags(has[0], alpha, has[1], has[2], F.col("animated"))
    needed = has[0] | has[1] | has[2] | F.col("apart") | F.col("animated")
    head = F.when(needed, riff.chunk("VP8X", riff.vp8x(flags, F.col("w"), F.col("h")))).otherwise(F.lit(b""))
    body = F.concat(head, riff.chunk("ICCP", F.col("icc")), F.col("body"), riff.chunk("EXIF", F.col("exif")), riff.chunk("XMP ", F.col("xmp")))
    return bodies.select("path", body.alias("body")).select("path", riff.envelope(F.col("body")).alias("content"))


def report(files: DataFrame) -> DataFrame:
    """(path, container, json): the class of the container and a report of the image and its chunks as JSON; files without chunks have no row."""
    kind = F.when(has_chunk("ANIM", "ANMF"), "animation").when(has_chunk("VP8X"), "extended").otherwise("simple")
    listed = described(files).where("size(places) > 0").withColumns({"container": kind, "chunks": F.col("places")})
    return listed.select("path", "container", F.to_json(F.struct("width", "height", "codec", "has_alpha", "has_metadata", "is_animated", "container", "chunks")).alias("json"))
