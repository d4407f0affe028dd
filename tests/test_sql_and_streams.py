"""SQL names, the data source, event time and expiring state."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from rastra.functions import riff, sql
from rastra.operators import container
from rastra.streaming import arrivals, incremental


def chunk(fourcc, payload):
    return fourcc + len(payload).to_bytes(4, "little") + payload + b"\0" * (len(payload) % 2)


def file(*chunks):
    body = b"".join(chunks)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


VP8L = b"\x2f" + ((9 - 1) | (7 - 1) << 14 | 1 << 28).to_bytes(4, "little")
VP8 = b"\x10\0\0\x9d\x01\x2a" + (33).to_bytes(2, "little") + (44).to_bytes(2, "little")
VP8X = lambda flags: bytes([flags, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
FILES = {
    "lossless": file(chunk(b"VP8L", VP8L + b"xyz")), "lossy": file(chunk(b"VP8 ", VP8 + b"z" * 9)), "alpha": file(chunk(b"VP8X", VP8X(16)), chunk(b"ALPH", b"\0"), chunk(b"VP8 ", VP8)), "moving": file(chunk(b"VP8X", VP8X(2 | 16)), chunk(b"ANIM", bytes(6)), chunk(b"ANMF", bytes(30))),
    "stray": file(chunk(b"VP8L", VP8L), chunk(b"ANMF", bytes(20))), "meta": file(chunk(b"VP8X", VP8X(8)), chunk(b"VP8L", VP8L), chunk(b"EXIF", b"e"), chunk(b"EXIF", b"second")), "cut": file(chunk(b"VP8 ", VP8 + bytes(50)))[:24], "late cut": file(chunk(b"VP8L", VP8L + bytes(90)))[:40],
    "none": file(chunk(b"ABCD", b"1")), "other": b"RIFF1234WAVE" + bytes(20), "short": b"RIFF", "empty": b"", "null": None, "bad": file(chunk(b"VP8L", b"\0" * 9)), "wide": file(chunk(b"VP8X", VP8X(0) + b"\0"), chunk(b"VP8L", VP8L)),
}


def test_sql_text_equals_data_frames(spark):
    sql.register(spark)
    files = spark.createDataFrame(list(FILES.items()), "path string, content binary")
    want = {r["path"]: tuple(r)[1:] for r in container.images(files).collect()}
    got = {r["path"]: tuple(r["p"]) for r in spark.sql("SELECT path, webp_probe(content) AS p FROM {files}", files=files).collect()}
    assert got == want and {w[-1] for w in want.values()} == {None, "truncated", "not_webp", "invalid_container", "missing_image"}
    rows = spark.sql("SELECT path, c.* FROM {files}, LATERAL riff_chunks(content) AS c", files=files)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, container.chunks(files).drop("payload").select("path", "idx", "fourcc", "payload_start", "size", "truncated").collect()))


def test_header_source_reads_headers_only(spark, tmp_path):
    sql.register(spark)
    whole = {n: c for n, c in FILES.items() if c is not None} | {"large": file(chunk(b"VP8L", VP8L + bytes(3_000_000)), chunk(b"XMP ", b"<x/>"))}
    (tmp_path / "deep").mkdir()
    for name, content in whole.items():
        (tmp_path / "deep" / f"{name}.webp").write_bytes(content)
    (tmp_path / "note.txt").write_text("no")
    read = spark.read.format("riff_headers").option("filesPerTask", "3").load(str(tmp_path))
    files = spark.createDataFrame([(str(tmp_path / "deep" / f"{n}.webp"), c) for n, c in whole.items()], "path string, content binary")
    columns = ["path", "idx", "fourcc", "payload_start", "size"]
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, container.chunks(files).select(columns).collect()))
    images = spark.read.format("riff_headers").load(str(tmp_path)).where("fourcc = 'VP8L'").select("path", "size")
    assert sorted(map(tuple, images.collect())) == sorted(map(tuple, container.chunks(files).where("fourcc = 'VP8L'").select("path", "size").collect()))
    assert spark.read.format("riff_headers").load(f"{tmp_path}/deep/nothing").count() == 0


def test_late_files_are_dropped_and_counted(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [[("a", at(1), 5), ("b", at(1, 30), 7), ("x", None, 1)], [("c", at(9), 1)], [("f", at(9, 1), 4)], [("late", at(1, 10), 100), ("d", at(9, 5), 2)], [("e", at(23), 3)]]
    schema = "path string, modificationTime timestamp, length long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files of a stream are taken in the order of their times
    late = arrivals.LateFiles()
    spark.streams.addListener(late)
    counts = arrivals.by_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "2 hours", "1 hour")
    query = counts.writeStream.format("memory").queryName("arrivals").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["start"].hour, r["files"], r["bytes"]) for r in spark.table("arrivals").collect())
    assert got == [(0, 2, 12), (8, 3, 7)]
    for _ in range(50):
        if late.dropped.get(str(query.id)):
            break
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert late.dropped[str(query.id)] == 1
    table = spark.createDataFrame([r for rows in batches for r in rows], schema)
    assert sorted((r["start"].hour, r["files"], r["bytes"]) for r in arrivals.by_time(table, "2 hours", "1 hour").collect()) == [(0, 3, 112), (8, 3, 7), (22, 1, 3)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)



def test_state_variables_give_the_same_events_under_any_split(spark, rocks, tmp_path):
    rng = random.Random(1)
    add = lambda rows: spark.createDataFrame(rows, "path string, seq int, bytes binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    names, parts = ["lossless", "meta", "moving", "other"], {}
    for n in names:
        cuts = sorted(rng.sample(range(1, len(FILES[n])), 2))
        parts[n] = [FILES[n][a:b] for a, b in zip([0, *cuts], [*cuts, len(FILES[n])], strict=True)]
    for i in range(3):
        add([(n, i, parts[n][i]) for n in names])
        time.sleep(1.1)
    whole = spark.createDataFrame([(n, 0, FILES[n]) for n in names], "path string, seq int, bytes binary")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((r["path"], r["event"], r["idx"], r["fourcc"], r["payload_start"], r["size"]) for r in incremental.whole_events(whole).collect()), key=key)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    pieces = spark.readStream.schema("path string, seq int, bytes binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.chunk_events_with_ttl(pieces, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(((r["path"], r["event"], r["idx"], r["fourcc"], r["payload_start"], r["size"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=key) == want


def test_state_is_gone_after_its_time(spark, rocks, tmp_path):
    data = FILES["meta"]
    add = lambda name, piece: spark.createDataFrame([(name, 0, piece)], "path string, seq int, bytes binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = lambda: sorted((r["path"], r["event"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    start = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    add("slow", data[:25])
    stream = incremental.chunk_events_with_ttl(spark.readStream.schema("path string, seq int, bytes binary").parquet(f"{tmp_path}/in"), "2 seconds")
    start()
    assert events() == [("slow", "chunk"), ("slow", "header")]
    time.sleep(2.5)
    add("other", b"no such file")
    start()
    assert ("slow", "abandoned") in events() and ("other", "error") in events()
    add("slow", data)  # anew, not from where it was
    start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert events().count(("slow", "header")) == 2 and ("slow", "finished") in events()
