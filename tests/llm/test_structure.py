"""Mixing, WARC archives, chat linking and the pipeline."""

import hashlib
import json
import os
import random
import struct
import sys
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from rastra.llm import chat, decontam, mixing, near, secret_scan, simhash, warc

SF = "/root/testdata/sf0.001"


def test_period_keeps_every_window():
    rng = random.Random(1)
    for _ in range(60):
        weights = {f"s{i}": rng.random() + 0.001 for i in range(rng.randint(1, 12))}
        shares = mixing.rounded(weights, rng.choice([12, 50, 200]))
        size, slots = sum(shares.values()), mixing.period_slots(shares)
        assert sorted(x for xs in slots.values() for x in xs) == list(range(size))
        for s, q in shares.items():
            for j, slot in enumerate(slots[s]):
                assert j * size // q <= slot < -(-(j + 1) * size // q)
            placed = 0
            for t in range(size + 1):
                placed = sum(x < t for x in slots[s])
                assert abs(placed * size - t * q) < size
            assert placed == q


def test_mix_places_every_row_once_and_keeps_the_weights(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), "t", "u") for i in range(2000)] + [(None, "a", "t", "u"), (7, "a", "t", "u"), (7, "a", "t", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string, _mixn string")
    weights = {"a": 0.4, "b": 0.3, "c": 0.2, None: 0.1}
    got = mixing.mix(docs, weights, block_rows=8, period=100).collect()
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    blocks = {}
    for r in got:
        blocks.setdefault(r["mix_slot"], []).append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    for rs in blocks.values():
        assert len({(r["source"], r["mix_block"]) for r in rs}) == 1 and sorted(r["mix_row"] for r in rs) == list(range(len(rs)))
    order = [blocks[s][0]["source"] for s in range(len(blocks))]
    first_end = min(max(s for s, x in enumerate(order) if x == name) for name in weights)
    for t in range(first_end + 1):
        for name, w in weights.items():
            assert abs(sum(x == name for x in order[:t]) - t * w) < 1
    assert mixing.mix(docs.limit(0)).collect() == []


def test_long_schedules_keep_exact_weights():
    from fractions import Fraction

    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 2**0.5, "b": 3**0.5, "c": 0.00003, "d": 7}):
        total = sum(map(Fraction, weights.values()))
        share = {s: Fraction(w) / total for s, w in weights.items()}
        placed = dict.fromkeys(weights, 0)
        for t, (s, j) in zip(range(1, 100_001), mixing.schedule(dict.fromkeys(weights, 10**6), weights)):
            assert j == placed[s]
            placed[s] += 1
            if t % 97 == 0 or t > 99_900:
                assert all(abs(placed[x] - t * share[x]) < 1 for x in weights)


def test_mix_takes_over_a_thousand_sources(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('host-', id % 1500) AS source")
    got = mixing.mix(docs, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    assert sorted({r["mix_slot"] for r in got}) == list(range(3000)) and len({(r["mix_slot"], r["source"]) for r in got}) == 3000


def archive(dictionary, frames):
    return struct.pack("<II", warc.DICTIONARY, len(dictionary)) + dictionary + b"".join(frames)


def test_archive_round_trip_and_damage():
    payloads = [b"", b"x" * 50, os.urandom(3000), "é\r\n\r\nWARC/1.1".encode() * 500]
    dictionary = warc.trained_dictionary(payloads)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    records = [warc.record(str(i), "http://a/ b", p, len(p), hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    records.append(warc.record("9", "", None, len(payloads[2]), hashlib.sha256(payloads[2]).hexdigest(), "2"))
    whole = archive(dictionary, [packer.compress(r) for r in records])
    read = [fields for _, fields in warc.archive_records(whole)]
    assert [r.get("payload") for r in read] == [*payloads, None]
    assert read[4]["refers_to"] == "2" and read[4]["payload_bytes"] == 3000 and read[0]["target_uri"] == "http://a/%20b"
    packed = zstandard.ZstdCompressor().compress(dictionary)
    assert [f.get("payload") for _, f in warc.archive_records(archive(packed, [packer.compress(r) for r in records]))][:4] == payloads
    assert "cut off" in list(warc.archive_records(whole[:-5]))[-1][1]["error"]
    wrong = records[1].replace(b"Content-Length: 5", b"Content-Length: 6")
    assert "error" in next(warc.archive_records(archive(dictionary, [packer.compress(wrong)])))[1]
    tampered = records[2][:-10] + b"!" + records[2][-9:]
    bad = list(warc.archive_records(archive(dictionary, [packer.compress(tampered), packer.compress(records[0])])))
    assert "digest" in bad[0][1]["error"] and bad[1][1]["payload"] == b""
    assert list(warc.archive_records(b"")) == [] and "error" in next(warc.archive_records(b"no archive"))[1]


def test_op8_corners(spark, tmp_path):
    from rastra.llm import queries

    long = "<p>" + "same " * 40
    rows = [(5, "u", long), (3, None, long), (9, "u\n2", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (6, "u", "é" * 80_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op8_warc_zstd(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(r["error"] is None for r in got.values())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {5: ("revisit", 3), 9: ("revisit", 3)}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op8_warc_zstd(spark, f"{tmp_path}/none").collect() == []


def test_chat_links(spark):
    schemas = {"add": {"properties": {"a": "integer", "b": "number", "note": "string"}, "required": ("a", "b")}, "free": {"additional": True}}
    calls = [
        (1, 1, "c1", "add", '{"b":2.5,"a":1}'), (1, 2, "c2", "add", '{"a":"x","z":[],"y":1}'), (1, 3, "c3", "free", '{"k":{"b":1,"a":[1,2]}}'),
        (1, 4, "c4", "gone", "{}"), (1, 5, "c5", "add", "not json"), (1, 6, "c6", "free", "[1]"), (1, 7, None, "free", "{}"), (2, 1, "c1", "free", None), (1, 9, "c1", "free", "{}"), (None, 1, "c1", "free", "{}"),
    ]
    results = [(1, 2, "c1", "é \"q\"\n"), (1, 8, "c1", "later"), (1, 3, "c9", "lost"), (2, 2, None, "nameless"), (None, 2, "c1", "null talk")]
    after = [(1, "c2", "c1"), (1, "c3", "c2"), (1, "c4", "c5"), (1, "c5", "c4"), (1, "c6", "c5"), (1, "c3", "c1"), (1, "c1", "none"), (2, "c1", "c2"), (1, None, "c1")]
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = chat.link(d(calls, "conv_id long, turn long, call_id string, name string, arguments string"), d(results, "conv_id long, turn long, call_id string, content string"), schemas, d(after, "conv_id long, call_id string, parent_id string")).collect()
    by = {(r["conv_id"], r["call_id"], r["status"]): r for r in got}
    assert len(got) == len(by) == 11
    assert json.loads(by[1, "c1", "linked"]["json"]) == {"arguments": {"a": 1, "b": 2.5}, "call_id": "c1", "level": 0, "name": "add", "result": 'é "q"\n', "status": "linked"}
    assert by[1, "c1", "linked"]["json"].startswith('{"arguments":{"a":1,"b":2.5},"call_id":"c1","level":0,')
    assert by[1, "c2", "unanswered"]["errors"] == ["a: not integer", "b: missing", "y, z: unknown"]
    assert [by[1, c, "unanswered"]["level"] for c in ("c2", "c3", "c4", "c5", "c6")] == [1, 2, None, None, None]
    assert '"arguments":{"k":{"a":[1,2],"b":1}}' in by[1, "c3", "unanswered"]["json"]
    assert [by[1, c, "unanswered"]["errors"] for c in ("c4", "c5", "c6")] == [["no such tool"], ["arguments: not an object"], ["arguments: not an object"]]
    assert by[2, "c1", "unanswered"]["errors"] == ["arguments: not an object"] and by[2, None, "orphan"]["level"] is None
    assert by[None, "c1", "linked"]["errors"] == [] and by[1, "c9", "orphan"]["errors"] == [] and by[1, None, "unanswered"]["turn"] == 7


def test_repeated_ids_keep_their_rows(spark):
    calls = spark.createDataFrame([(1, 1, "c0", "free", '{"n":1}'), (1, 4, "c0", "free", '{"n":4}'), (1, 6, "c0", "free", '{"n":6}'), (1, 2, "c1", "free", "{}")], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 5, "c0", "second"), (1, 3, "c0", "first"), (1, 7, "c1", "x"), (1, 8, "c1", "y")], "conv_id long, turn long, call_id string, content string")
    after = spark.createDataFrame([(1, "c0", "c1")], "conv_id long, call_id string, parent_id string")
    got = chat.link(calls, results, {"free": {"additional": True}}, after, repeats=True).collect()
    assert sorted((r["turn"], r["call_id"], r["status"], json.loads(r["json"])["result"], str(r["level"])) for r in got) == [
        (1, "c0", "linked", "first", "1"), (2, "c1", "linked", "x", "0"), (4, "c0", "linked", "second", "1"), (6, "c0", "unanswered", None, "1"), (8, "c1", "orphan", "y", "None"),
    ]


def test_a_call_behind_a_cycle_and_a_finished_one_has_no_level(spark):
    edges = [("x", "y"), ("y", "x"), ("z", "x"), ("z", "done"), ("after", "z"), ("p", "q"), ("q", "r"), ("r", "p"), ("w", "p"), ("w", "late"), ("late", "done")]
    nodes = sorted({n for e in edges for n in e})
    got = dict(chat.levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "child string, parent string")).collect())
    assert got == dict.fromkeys(nodes) | {"done": 0, "late": 1}


def test_levels_of_long_chains_and_joints(spark):
    edges = [(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("j", "n39"), ("j", "n3"), ("k", "j"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    got = dict(chat.levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "child string, parent string")).collect())
    assert got == {f"n{i}": i for i in range(40)} | {"j": 40, "k": 41, "alone": 0, "x": None, "y": None, "z": None, "s": None}


def test_pipeline_against_plain_python(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as cp

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    least = {}
    for r, g in zip(docs, five_word_groups([r["text"] for r in docs]), strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    kept = [r for r in docs if r["doc_id"] in least.values()]
    sketches = decontam.Sketches(list(enumerate(items)), 5, 0.8)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [decontam.normal(t).split()] for i in range(len(w) - 4)}
    goals = [grams(x) for x in items]
    kept = [r for r in kept if not any(len(g & grams(r["text"])) >= 0.8 * len(g) for g in goals)]
    assert all(not sketches.search(r["text"], 0.8) for r in kept)
    want = sorted((r["doc_id"], secret_scan.redacted(r["text"], secret_scan.secret_spans(r["text"]), "[SECRET]")) for r in kept)
    got = cp.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["mix_slot"], set()).add(r["source"])
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as cp

    rows = [(4, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (None, "other words here", "en", "s", 9), (9, None, None, None, None), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in cp.one_of_each(spark, docs, SF).collect()) == ["2", "8", "None"]


def five_word_groups(texts):
    """A group number for each text, by links of 5-word similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_duplicate_stage_links_edited_copies(spark):
    import corpus_pipeline as cp

    rng = random.Random(11)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(500)]) for _ in range(rng.choice([3, 40, 200, 400]))) for _ in range(20)]
    for n in range(80):
        words = rng.choice(texts).split()
        for _ in range(len(words) // rng.choice([25, 40, 60, 100])):
            words[rng.randrange(len(words))] = f"edit{n}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    first = {}
    for i, g in enumerate(five_word_groups(texts)):
        first.setdefault(g, i)
    assert 20 < len(first) < 100
    assert sorted(r["doc_id"] for r in cp.one_of_each(spark, docs, SF).collect()) == sorted(first.values())


def test_near_duplicate_stage_links_by_pivot_distances(spark, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(near, "bands", lambda grams: grams.sum(keepdims=True))  # no two sets meet in a band: only fingerprints are left
    rng = random.Random(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(900)]) for _ in range(rng.choice([4, 60, 300, 600]))) for _ in range(12)]
    for n in range(90):
        words = rng.choice(texts).split()
        for _ in range(max(1, len(words) // rng.choice([60, 200, 600]))):
            words[rng.randrange(len(words))] = f"edit{n}"
        texts.append(" ".join(words))
    sets = [set(near.shingles(near.word_hashes(t)).tolist()) for t in texts]
    fps = [simhash.majority(near.word_hashes(" ".join(set(t.split())))) for t in texts]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    group, met, missed = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if alike(i, j) and (fps[i] ^ fps[j]).bit_count() <= 3:
                met += sets[i] != sets[j]
                group = [group[j] if g == group[i] else g for g in group]
            elif alike(i, j):
                missed += 1
    assert met > 20 and missed > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.one_of_each(spark, docs, SF).collect()) == sorted(group.index(g) for g in set(group))


def test_near_duplicate_stage_keeps_one_row_of_equal_ids(spark):
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "a b c d", "en", "s", 7)] * 3 + [(None, "no id at all", "en", "s", 12)] * 4 + [(1, long + " end", "en", "s", 0), (0, long, "en", "s", 0), (5, "alone", "en", "s", 5), (5, "other", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in cp.one_of_each(spark, docs, SF).collect())
    assert got == sorted([("0", long), ("1", "a b c d"), ("5", "alone"), ("5", "other"), ("None", "no id at all")])


def test_pipeline_with_unlearned_languages_against_plain_python(spark, tmp_path):
    import corpus_pipeline as cp
    from tests.llm.test_text import DUTCH, FINNISH

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(10_000, DUTCH * 2), (10_001, FINNISH * 2), (10_002, "12 34"), (10_003, None)]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r[c] for c in cp.COLUMNS) for r in docs] + [(i, t, None, "web", 0) for i, t in odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = {}
    for r, g in zip(docs, five_word_groups([r["text"] for r in docs]), strict=True):
        first[g] = min(first.get(g, r), r, key=lambda r: r["doc_id"])
    grams = lambda t: {tuple(w[i : i + 5]) for w in [decontam.normal(t).split()] for i in range(len(w) - 4)}
    goals = [grams(x) for x in items]
    kept = [r for r in first.values() if not any(len(g & grams(r["text"])) >= 0.8 * len(g) for g in goals)]
    want = sorted((r["doc_id"], secret_scan.redacted(r["text"], secret_scan.secret_spans(r["text"]), "[SECRET]")) for r in kept)
    assert sorted((r["doc_id"], r["text"]) for r in cp.run(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("column", ["text", "lang", "source", "doc_id"])
def test_pipeline_stages_take_nulls(spark, column):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    some = docs.withColumn(column, F.when(F.col("doc_id") % 5 != 0, F.col(column)))
    for _, stage in cp.STAGES:
        out = stage(spark, some, SF)
        assert set(cp.COLUMNS) <= set(out.columns) and out.count() > 0
        assert stage(spark, some.limit(0), SF).count() == 0


def test_archives_roll_over_by_bytes(spark, tmp_path):
    rng = random.Random(3)
    bodies = [rng.randbytes(rng.choice([0, 10, 3000, 40_000])) for _ in range(60)]
    rows = [(str(i), "http://x/", b, len(b), hashlib.sha256(b).hexdigest(), None, "clash") for i, b in enumerate(bodies)]
    records = spark.createDataFrame(rows, "record_id string, uri string, payload binary, size long, digest string, refers_to string, roll string").repartition(2)
    warc.write_archives(records, f"{tmp_path}/a", b"", most=50_000)
    files = [f for f in spark.read.format("binaryFile").load(f"{tmp_path}/a").select("path", "length").collect()]
    assert len(files) > 10 and max(f["length"] for f in files) < 60_000
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, f"{tmp_path}/a").where("error is null").collect()}
    assert got == {str(i): b for i, b in enumerate(bodies)}


def test_a_cycle_beside_a_deep_ladder(spark):
    edges = [("x", "y"), ("y", "x"), ("z", "x"), ("z", "a0")]
    for i in range(1, 10):
        edges += [(f"a{i}", f"a{i - 1}"), (f"a{i}", f"b{i - 1}"), (f"b{i}", f"a{i - 1}"), (f"b{i}", f"b{i - 1}")]
    nodes = sorted({n for e in edges for n in e})
    got = dict(chat.levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "child string, parent string")).collect())
    assert got == {f"{s}{i}": i for s in "ab" for i in range(10)} | {"x": None, "y": None, "z": None}


def plain_levels(nodes, edges):
    level, parents = {}, {n: {p for c, p in edges if c == n} for n in nodes}
    while True:
        more = {n: 1 + max((level[p] for p in parents[n]), default=-1) for n in nodes if n not in level and all(p in level for p in parents[n])}
        if not more:
            return {n: level.get(n) for n in nodes}
        level |= more


def test_levels_of_a_long_ladder_take_seconds(spark):
    edges = [(f"a{i}", f"a{i - k}") for i in range(1, 1000) for k in (1, 2) if i >= k] + [("x", "y"), ("y", "x"), ("z", "x"), ("z", "a500")]
    nodes = sorted({n for e in edges for n in e})
    begun = time.monotonic()
    got = dict(chat.levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "child string, parent string")).collect())
    assert got == {f"a{i}": i for i in range(1000)} | {"x": None, "y": None, "z": None}
    assert time.monotonic() - begun < 60


def test_levels_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BITS", 2)
    monkeypatch.setattr(chat, "WIDE", 3)
    rng = random.Random(6)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = list({(nodes[i], nodes[rng.randrange(i)]) for i in range(1, 30) for _ in range(rng.choice([0, 1, 2]))} | {("n39", f"n{i:02}") for i in range(8)} | {("n31", "n32"), ("n32", "n31"), ("n33", "n31"), ("n33", "n05")})
    frame = spark.createDataFrame([(n, rng.random()) for n in nodes], "node string, place double")
    assert dict(chat.levels(frame, spark.createDataFrame(edges, "child string, parent string")).collect()) == plain_levels(nodes, edges)


def test_every_turn_stays_a_row(spark):
    rows = [(1, 0, "user", "one"), (1, 0, "user", "two"), (1, 1, "assistant", "answer"), (1, 1, "assistant", "another"), (None, 0, "user", "no conversation"), (2, None, "user", "no turn"), (3, 4, "assistant", None), (3, 5, "system", "rules")]
    talk = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string")
    calls, results, after = chat.from_turns(talk)
    got = sorted((str(r["conv_id"]), str(r["turn"]), r["status"]) for r in chat.link(calls, results, chat.REPLY, after, repeats=True).collect())
    assert got == [("1", "0", "linked"), ("1", "0", "linked"), ("2", "None", "unanswered"), ("3", "4", "orphan"), ("None", "0", "unanswered")]


def test_mix_takes_null_and_repeated_ids(spark):
    docs = spark.range(5000).selectExpr("if(id % 3 = 0, null, 7L) AS doc_id", "if(id % 2 = 0, null, 'a') AS source", "cast(id as string) AS text")
    got = mixing.mix(docs).collect()
    assert len(got) == 5000 and len({r["text"] for r in got}) == 5000
    assert len({(r["mix_slot"], r["mix_row"]) for r in got}) == 5000
    with pytest.raises(Exception, match="no weight for"):
        mixing.mix(docs, {"a": 1.0}).collect()
