"""WARC archives in Zstandard, with a dictionary.

An archive starts with a skippable frame that holds the dictionary; then comes one frame for each record, so
that a record can be read without the ones before it. The reader takes archives from Spark's
``binaryFile`` source; the writer hands its bytes to Spark's ``text`` sink, so both work on any file system
that Spark reaches, and a lost task is simply written again. That sink ends each row with a line
break: every row therefore ends in the header of a skippable frame of one byte, and the break is that byte.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers, as in the Zstandard and the WARC dictionary specifications.
FRAME, DICTIONARY, SKIPPABLE, SKIPPABLE_MASK = 0xFD2FB528, 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0
DICTIONARY_BYTES = 64 << 10
#: Pages and bytes of each that a dictionary is trained on at most.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 32 << 10
#: Payloads below this many bytes are never revisits.
#: Bytes after which a partition's next archive begins.
ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
_FILLER = struct.pack("<II", SKIPPABLE, 1)
RECORDS = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary for such payloads; too few or too short samples give one of raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) + b"WARC/1.1\r\nWARC-Type: response\r\nHTTP/1.1 200 OK\r\n")[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def record(record_id: str, uri: str, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", uri))] if uri else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, dictionary: bytes, most: int = ARCHIVE_BYTES) -> None:
    """Write archives of ``records``: columns record_id, uri, payload (binary), size, digest, refers_to (strings); other columns are not written.

    Each partition has an archive of its own, and another one whenever one has ``most`` bytes (a single longer record excepted), below
    ``path``/roll=0, roll=1 and so on: readers take no file of 2 GB or more. A null payload is empty, a null refers_to makes a
    response; record_id, uri, size and digest must not be null. An empty partition leaves an archive without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
        head = struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary + _FILLER
        rows, rolls, roll, written, done = [head], [0], 0, len(head), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rolls, pa.int32()), pa.array(range(done, done + len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["roll", "nth", "bytes"])

        for batch in batches:
            for r in batch.to_pylist():
                frame = packer.compress(record(**r)) + _FILLER
                if written + len(frame) > most and written > len(head):
                    roll, written = roll + 1, len(head)
                    rows.append(head)
                    rolls.append(roll)
                rows.append(frame)
                rolls.append(roll)
                written += len(frame) + 1
            yield out()
            done, rows, rolls = done + len(rows), [], []
        if rows:
            yield out()

    packed = records.select("record_id", "uri", "payload", "size", "digest", "refers_to").mapInArrow(run, "roll int, nth long, bytes binary")
    packed.sortWithinPartitions("roll", "nth").select("roll", F.col("bytes").cast("string")).write.partitionBy("roll").option("lineSep", "\n").text(path)


def frame_end(data: bytes | memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its header and its blocks' lengths."""
    head = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * head.has_checksum
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def parsed(raw: bytes) -> dict:
    """The fields of one decoded record; ValueError if its header, lengths or digest don't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    kind, size = fields.get("warc-type"), fields.get("content-length", "")
    if not size.isdigit() or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("the content length doesn't hold")
    http, gap, payload = rest[: int(size)].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not gap or not length:
        raise ValueError("no HTTP header with a length")
    digest, n = fields.get("warc-payload-digest", "").removeprefix("sha256:"), int(length[1])
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest doesn't hold")
    if kind not in ("response", "revisit") or kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("no proper response or revisit")
    name = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return {"record_type": kind, "record_id": name(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": name(fields.get("warc-refers-to")), "payload_bytes": n, "payload_digest": digest, "payload": payload if kind == "response" else None}


def archive_records(content: bytes) -> Iterator[tuple[int, dict]]:
    """(offset, fields or error) of every record of an archive, in order.

    A damaged record is one row with an error; a damaged frame length ends the archive, as nothing after it can be found.
    """
    data, at, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        begin = at
        try:
            magic = int.from_bytes(data[at : at + 4], "little")
            if magic & SKIPPABLE_MASK == SKIPPABLE:
                end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if end > len(data):
                    raise ValueError("a skippable frame is cut off")
                if at == 0 and magic == DICTIONARY:
                    found = bytes(data[8:end])
                    plain = zstandard.ZstdDecompressor().decompress(found) if found[:4] == struct.pack("<I", FRAME) else found
                    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(plain))
                at = end
                continue
            if magic != FRAME:
                raise ValueError("neither a frame nor a skippable frame")
            at = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as error:
            yield begin, {"error": str(error)}
            return
        try:
            yield begin, parsed(reader.decompress(data[begin:at], max_output_size=1 << 31))
        except (ValueError, zstandard.ZstdError) as error:
            yield begin, {"error": str(error)}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``, in the columns of RECORDS.

    Broken records have an error and nulls. Without ``with_payload`` payloads are checked but not handed on. Archives are
    files of a size that a task can hold; the writer sees to it.
    """
    schema = [f.strip().split(" ")[0] for f in RECORDS.split(",")]
    types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types.get(c, pa.string())) for c in schema], names=schema)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, fields in archive_records(content.as_py()):
                    rows.append({"archive": name, "offset": offset} | fields | ({} if with_payload else {"payload": None}))
                    if len(rows) == 256:
                        yield out(rows)
                        rows = []
                yield out(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def revisits(pages: DataFrame, key: str, digest: str, size: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(key, digest, refers_to): the pages whose payload another page with a smaller key has, refers_to being the smallest.

    Works on keys and digests alone, pre-aggregated by digest. Rows with a null key are never revisits; of rows that share the smallest key, all are responses.
    """
    sizeable = pages.select(key, digest).where((F.col(size) >= least) & F.col(key).isNotNull())
    first = sizeable.groupBy(digest).agg(F.min(key).alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return sizeable.join(first, digest).where(F.col(key) > F.col("refers_to")).select(key, digest, "refers_to").distinct()


def payload(html: Column) -> Column:
    """A text's UTF-8 bytes; null: none."""
    return F.coalesce(html.cast("string").cast("binary"), F.lit(b""))
