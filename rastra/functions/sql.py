"""Names for SQL text: a probe of a file's bytes, its chunks as a table function, and a data source of chunk headers.

    register(spark)
    SELECT path, webp_probe(content).width FROM files
    SELECT path, c.* FROM files, LATERAL riff_chunks(content) AS c
    spark.read.format("riff_headers").load("/mounted/folder")

Everything here agrees with ``operators.container``, which is what DataFrame code should use.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.functions import arrow_udf, udtf

from rastra.functions.riff import ANIMATION, ALPHA, CHUNK_HEADER, FILE_HEADER, walk

PROBE = "struct<width int, height int, codec string, has_alpha boolean, has_metadata boolean, is_animated boolean, error string>"
CHUNK = "idx int, fourcc string, payload_start long, size long, truncated boolean"
#: Bytes of a chunk that a probe looks at.
_HEAD = 32


def _sizes(fourcc: str, head: bytes) -> tuple[int, int, bool | None, bool] | None:
    """(width, height, alpha, animated) that a chunk's first bytes tell; None if they are not well formed."""
    n = lambda at, size: int.from_bytes(head[at : at + size], "little")
    if fourcc == "VP8X" and len(head) == 10:
        return n(4, 3) + 1, n(7, 3) + 1, bool(head[0] & ALPHA), bool(head[0] & ANIMATION)
    if fourcc == "VP8L" and len(head) >= 5 and head[0] == 0x2F and n(1, 4) >> 29 == 0:
        return (n(1, 4) & 0x3FFF) + 1, (n(1, 4) >> 14 & 0x3FFF) + 1, bool(n(1, 4) >> 28 & 1), False
    if fourcc == "VP8 " and len(head) >= 10 and not head[0] & 1 and head[3:6] == b"\x9d\x01\x2a":
        return n(6, 2) & 0x3FFF, n(8, 2) & 0x3FFF, None, False
    return None


def probe(data: bytes | None) -> dict:
    """What ``container.images`` tells of a file, from its bytes."""
    places = walk(data, FILE_HEADER, True) or []
    first = {p["fourcc"]: p for p in reversed(places)}
    told = {}
    for fourcc in ("VP8X", "VP8L", "VP8 "):
        if fourcc in first:
            at = first[fourcc]["payload_start"]
            told[fourcc] = _sizes(fourcc, data[at : at + min(first[fourcc]["size"], _HEAD)])
    canvas, lossless, lossy = (told.get(c) for c in ("VP8X", "VP8L", "VP8 "))
    size = canvas or lossless or lossy
    animated = bool(canvas and canvas[3])
    if data is None or len(data) < FILE_HEADER:
        error = "truncated"
    elif data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        error = "not_webp"
    elif ("ANIM" in first or "ANMF" in first) and not animated:
        error = "invalid_container"
    elif size is None:
        error = "truncated" if any(p["truncated"] and p["fourcc"] in ("VP8L", "VP8 ") for p in places) else "missing_image"
    else:
        error = None
    alpha = canvas[2] if animated else lossless[2] if lossless else "ALPH" in first
    codec = None if animated else "lossless" if lossless else "lossy" if lossy else None
    return {
        "width": size and size[0], "height": size and size[1], "codec": codec, "has_alpha": alpha if places else None,
        "has_metadata": any(c in first for c in ("ICCP", "EXIF", "XMP ")), "is_animated": animated if places else None, "error": error,
    }


def _probes(content: pa.Array) -> pa.Array:
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("codec", pa.string()), ("has_alpha", pa.bool_()), ("has_metadata", pa.bool_()), ("is_animated", pa.bool_()), ("error", pa.string())])
    return pa.array([probe(c.as_py()) for c in content], kind)


class RiffChunks:
    """The chunks of one file, up to the first that is cut off; none for null and for files that are no WebP."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for c in walk(content, FILE_HEADER, False) or ():
            yield c["idx"], c["fourcc"], c["payload_start"], c["size"], c["truncated"]


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    """Reads the headers of chunks only: it seeks over every payload."""

    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"].removeprefix("file://"), options.get("suffix", ".webp")
        self.per_task, self.fourcc = int(options.get("filesPerTask", "64")), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("fourcc",):
                self.fourcc = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        paths = sorted(os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.endswith(self.suffix))
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Files([])]  # Spark reads a source without partitions as one

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as file:
                head = file.read(FILE_HEADER)
                if len(head) < FILE_HEADER or head[:4] != b"RIFF" or head[8:] != b"WEBP":
                    continue
                end, at, idx = min(os.fstat(file.fileno()).st_size, 8 + int.from_bytes(head[4:8], "little")), FILE_HEADER, 0
                while at + CHUNK_HEADER <= end:
                    file.seek(at)
                    header = file.read(CHUNK_HEADER)
                    size = int.from_bytes(header[4:], "little")
                    if at + CHUNK_HEADER + size > end:
                        break
                    fourcc = header[:4].decode("latin-1")
                    if self.fourcc is None or fourcc == self.fourcc:
                        yield path, idx, fourcc, at + CHUNK_HEADER, size
                    at, idx = at + CHUNK_HEADER + size + size % 2, idx + 1


class RiffHeaders(DataSource):
    """The chunks of the files in a folder that every executor mounts: path, idx, fourcc, payload_start, size. Payloads are never read.

    Options: path, suffix (".webp"), filesPerTask (64). A condition fourcc = '...' is decided while reading.
    """

    @classmethod
    def name(cls) -> str:
        return "riff_headers"

    def schema(self) -> str:
        return "path string, idx int, fourcc string, payload_start long, size long"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    """Make webp_probe, riff_chunks and riff_headers known to a session, and let it push conditions down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.udf.register("webp_probe", arrow_udf(_probes, PROBE))
    spark.udtf.register("riff_chunks", udtf(RiffChunks, returnType=CHUNK))
    spark.dataSource.register(RiffHeaders)
