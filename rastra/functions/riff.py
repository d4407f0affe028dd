"""The RIFF container of WebP files: building and reading chunks with Spark expressions.

Only the walk over a file's chunk headers, where each place depends on the last size, is a small Arrow helper;
it returns places and sizes, and Spark cuts the payloads out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rastra.functions.bits import bit, byte_at, le_bytes, le_uint

#: Flags of the VP8X chunk's first byte.
ICC, ALPHA, EXIF, XMP, ANIMATION = 0x20, 0x10, 0x08, 0x04, 0x02
#: Bytes before the first chunk, of a chunk's header, of a frame's header.
FILE_HEADER, CHUNK_HEADER, FRAME_HEADER = 12, 8, 16


def text_bytes(text: str) -> Column:
    return F.lit(text).cast("binary")


def chunk(fourcc: str, payload: Column) -> Column:
    """A chunk: its name, its payload's length, the payload and a zero byte after an odd one. A null payload gives no bytes."""
    body = F.concat(text_bytes(fourcc), le_bytes(F.octet_length(payload), 4), payload, F.when(F.octet_length(payload) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    return F.when(payload.isNull(), F.lit(b"")).otherwise(body)


def envelope(body: Column) -> Column:
    """A file around the bytes of its chunks."""
    return F.concat(text_bytes("RIFF"), le_bytes(F.octet_length(body) + 4, 4), text_bytes("WEBP"), body)


def vp8x(flags: Column, width: Column, height: Column) -> Column:
    """The payload of a VP8X chunk."""
    return F.concat(le_bytes(flags, 4), le_bytes(width - 1, 3), le_bytes(height - 1, 3))


def vp8x_flags(icc: Column, alpha: Column, exif: Column, xmp: Column, animation: Column) -> Column:
    """The flags for what a file has."""
    total = F.lit(0)
    for has, flag in ((icc, ICC), (alpha, ALPHA), (exif, EXIF), (xmp, XMP), (animation, ANIMATION)):
        total = total + F.when(has, F.lit(flag)).otherwise(F.lit(0))
    return total


def anim(background: Column, loop_count: Column) -> Column:
    return F.concat(le_bytes(background, 4), le_bytes(loop_count, 2))


def anmf(x: Column, y: Column, width: Column, height: Column, duration: Column, blend: Column, dispose: Column, payload: Column) -> Column:
    """The payload of an ANMF chunk: offsets are stored halved, so odd ones lose their last bit; blend and dispose are booleans."""
    flags = F.when(blend, F.lit(0)).otherwise(F.lit(2)) + F.when(dispose, F.lit(1)).otherwise(F.lit(0))
    half = lambda c: F.shiftright(c, 1)
    return F.concat(*[le_bytes(c, 3) for c in (half(x), half(y), width - 1, height - 1, duration)], le_bytes(flags, 1), payload)


def read_vp8x(payload: Column) -> Column:
    """struct(width, height, has_icc, has_alpha, has_exif, has_xmp, is_animated) of a VP8X payload; null unless it has exactly 10 bytes."""
    flags = byte_at(payload, 0)
    has = [bit(flags, mask).alias(name) for name, mask in (("has_icc", ICC), ("has_alpha", ALPHA), ("has_exif", EXIF), ("has_xmp", XMP), ("is_animated", ANIMATION))]
    return F.when(F.octet_length(payload) == 10, F.struct((le_uint(payload, 4, 3) + 1).alias("width"), (le_uint(payload, 7, 3) + 1).alias("height"), *has))


def read_anim(payload: Column) -> Column:
    """struct(background, loop_count); null if the payload is too short."""
    return F.when(F.octet_length(payload) >= 6, F.struct(le_uint(payload, 0, 4).alias("background"), le_uint(payload, 4, 2).alias("loop_count")))


def read_anmf(payload: Column) -> Column:
    """struct(x, y, width, height, duration_ms, blend, dispose); null if the header is cut off."""
    u24 = lambda at: le_uint(payload, at, 3)
    flags = byte_at(payload, 15)
    return F.when(
        F.octet_length(payload) >= FRAME_HEADER,
        F.struct((u24(0) * 2).alias("x"), (u24(3) * 2).alias("y"), (u24(6) + 1).alias("width"), (u24(9) + 1).alias("height"), u24(12).alias("duration_ms"), F.when(bit(flags, 2), "overwrite").otherwise("blend").alias("blend"), F.when(bit(flags, 1), "background").otherwise("keep").alias("dispose")),
    )


def read_vp8l_header(payload: Column) -> Column:
    """struct(width, height, has_alpha) of a lossless image's first five bytes; null if signature or version are wrong."""
    n = le_uint(payload, 1, 4)
    fine = (byte_at(payload, 0) == 0x2F) & (F.shiftright(n, 29) == 0)
    return F.when(fine, F.struct((n.bitwiseAND(F.lit(0x3FFF)) + 1).alias("width"), (F.shiftright(n, 14).bitwiseAND(F.lit(0x3FFF)) + 1).alias("height"), bit(n, 1 << 28).alias("has_alpha")))


def vp8l_header(width: Column, height: Column, has_alpha: Column) -> Column:
    """The first five bytes of a lossless image."""
    n = (width - 1) + (height - 1) * F.lit(1 << 14) + F.when(has_alpha, F.lit(1 << 28)).otherwise(F.lit(0))
    return F.concat(F.lit(b"\x2f"), le_bytes(n, 4))


def read_vp8_header(payload: Column) -> Column:
    """struct(width, height, x_scale, y_scale, first_partition) of a lossy key frame's ten bytes; null for other frames."""
    tag = le_uint(payload, 0, 3)
    fine = ~bit(tag, 1) & (le_uint(payload, 3, 3) == 0x2A019D) & (F.octet_length(payload) >= 10)
    size = lambda at: le_uint(payload, at, 2)
    return F.when(fine, F.struct(size(6).bitwiseAND(F.lit(0x3FFF)).alias("width"), size(8).bitwiseAND(F.lit(0x3FFF)).alias("height"), F.shiftright(size(6), 14).alias("x_scale"), F.shiftright(size(8), 14).alias("y_scale"), F.shiftright(tag, 5).alias("first_partition")))


def vp8_header(width: Column, height: Column, first_partition: Column) -> Column:
    """The ten bytes that a shown lossy key frame starts with."""
    return F.concat(le_bytes(F.shiftleft(first_partition, 5).bitwiseOR(F.lit(0x10)), 3), F.lit(b"\x9d\x01\x2a"), le_bytes(width, 2), le_bytes(height, 2))


def read_alph_header(payload: Column) -> Column:
    """struct(method, filter, preprocessing) of an ALPH chunk's first byte; null if reserved bits are set."""
    n = byte_at(payload, 0)
    two = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(3))
    return F.when(two(6) == 0, F.struct(two(0).alias("method"), two(2).alias("filter"), two(4).alias("preprocessing")))


PLACES = "array<struct<idx int, fourcc string, payload_start long, size long, truncated boolean>>"


def walk(data: bytes | None, start: int, lenient: bool) -> list[dict] | None:
    """The chunk headers from a place on; strict walks end before the first chunk that is cut off, lenient ones list it as truncated."""
    if data is None:
        return None
    end, at, found = len(data), start, []
    if start == FILE_HEADER:
        if end < FILE_HEADER or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            return None
        if not lenient:
            end = min(end, 8 + int.from_bytes(data[4:8], "little"))
    while at + CHUNK_HEADER <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        cut = at + CHUNK_HEADER + size > end
        if cut and not lenient:
            break
        found.append({"idx": len(found), "fourcc": data[at : at + 4].decode("latin-1"), "payload_start": at + CHUNK_HEADER, "size": size, "truncated": cut})
        at += CHUNK_HEADER + size + size % 2
    return found


def places(content: Column, start: int = FILE_HEADER, lenient: bool = False) -> Column:
    """array<struct(idx, fourcc, payload_start, size, truncated)> of a file's chunks; null if it is no WebP file (or null).

    ``start`` 12 reads a file, 16 the chunks inside a frame's payload.
    """

    @arrow_udf(PLACES)
    def run(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("idx", pa.int32()), ("fourcc", pa.string()), ("payload_start", pa.int64()), ("size", pa.int64()), ("truncated", pa.bool_())]))
        return pa.array([walk(v.as_py(), start, lenient) for v in values], kind)

    return run(content)
