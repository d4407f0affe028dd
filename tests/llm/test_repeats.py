"""Weighted clustering, repeated word windows and periodic runs against brute force."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastra.llm import debruijn, lloyd, queries, runs

DOCS = "doc_id long, text string, n_words long, id string, h1 int"


def plain_windows(texts, width):
    bodies = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(b[p : p + width]) for b in bodies for p in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = set()
        for p in range(len(b) - width + 1):
            if seen[tuple(b[p : p + width])] > 1:
                gone |= set(range(p, p + width))
        out.append((len(b), len(gone), b" ".join(w for i, w in enumerate(b) if i not in gone).decode()))
    return out


def passages(seed, n, vocabulary=12):
    rng = random.Random(seed)
    blocks = [" ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(rng.randint(2, 30))) for _ in range(8)]
    texts = ["\t \n".join(rng.choice([*blocks, f"x{rng.random()}"]) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    ladder = " ".join(f"l{i}" for i in range(60))
    prefixes = [" ".join(ladder.split()[a : a + rng.randint(5, 60)]) for a in (0, 0, 0, 7, 13)]
    return [*texts, *prefixes, None, "", " \n", "a " * 300, "a b " * 90, "short one", "one word here", texts[0], texts[0], blocks[0]]


@pytest.mark.parametrize("width,anchor,bits", [(8, 3, 64), (8, 7, 64), (12, 4, 6), (5, 1, 3)])
def test_repeated_windows_match_brute_force(spark, width, anchor, bits):
    texts = passages(width + bits, 40)
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, 7, "clash", 1) for i, t in enumerate(texts)], DOCS)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in debruijn.without_repeats(docs, width=width, anchor=anchor, hash_bits=bits).collect())
    want = Counter((None if i % 9 == 0 else i // 2, *row) for i, row in enumerate(plain_windows(texts, width)))
    assert got == want


def test_repeated_windows_of_long_texts_cross_blocks(spark):
    rng = random.Random(3)
    long = [f"u{i}" for i in range(140_000)]
    texts = [" ".join(long), " ".join(long[65_000:70_000]), " ".join(long[131_000:]), " ".join(str(rng.random()) for _ in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in debruijn.without_repeats(docs, finish=lambda c: F.sha2(c, 256)).collect())
    left = " ".join(long[:65_000] + long[70_000:131_000])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(0, 140_000, 14_000, sha(left)), (1, 5_000, 5_000, sha("")), (2, 9_000, 9_000, sha("")), (3, 50, 0, sha(texts[3]))]


def test_nonbranching_paths_are_compacted(spark):
    shared = " ".join(f"s{i}" for i in range(300))
    texts = [shared, "a " + shared + " b", "c " + shared]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "body binary").select("body", *(F.xxhash64(F.lit(n), "body").alias(f"h{n}") for n in (1, 2)))
    done = debruijn.repeated(docs, 20, 5).collect()
    assert sorted((r["n_removed"], bytes(r["kept"]).decode()) for r in done) == [(300, ""), (300, "a b"), (300, "c")]
    signed = lambda s: (s % (1 << 64) + (1 << 63)) % (1 << 64) - (1 << 63)
    edges = [(i, 100 + i, 3, 7 * pow(debruijn._TURN, i, 1 << 64)) for i in range(50)]
    edges += [(50, 150, 2, 7), (51, 251, 3, 7), (52, 252, 3, 7 * debruijn._TURN), (53, 254, 3, 7 * debruijn._TURN**3), (60, 65_535, 2, 1), (61, 65_536, 2, debruijn._TURN)]
    frame = spark.createDataFrame([(e, p, n, signed(s)) for e, p, n, s in edges], "edge long, source long, places long, sign long")
    assert sorted((r["path"], r["n"]) for r in debruijn.paths(frame).collect()) == [(0, 50), (50, 1), (51, 2), (53, 1), (60, 1), (61, 1)]


def test_repeated_windows_of_nothing(spark):
    assert debruijn.without_repeats(spark.createDataFrame([], DOCS)).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in debruijn.without_repeats(none).collect()) == [(1, 0, 0, ""), (2, 0, 0, "")]
    with pytest.raises(ValueError):
        debruijn.without_repeats(none, width=5, anchor=5)


def test_words_of_a_batch_are_not_held_together():
    texts = [" ".join(f"w{i + j}" for j in range(300)).encode() for i in range(3000)] + [b""]
    numbers = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, numbers, pa.array(texts, pa.binary())], names=["id", "h1", "h2", "body"])
    tracemalloc.start()
    try:
        got = [(r["id"], r["n_words"], len(r["whole"])) for out in debruijn._words(iter([batch])) for r in out.select(["id", "n_words", "whole"]).slice(0, 1).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0] == (0, 300, len(texts[0]))
    assert peak < 2 * sum(map(len, texts))
    rows = [r for out in debruijn._words(iter([batch])) for r in out.to_pylist()]
    assert [(r["h1"], r["n_words"], r["whole"]) for r in rows] == [(i, len(t.split()), t) for i, t in enumerate(texts)]


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        s = 0
        while s + p < len(words):
            if words[s] != words[s + p]:
                s += 1
                continue
            e = s
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            if e - s >= p and e - s + p >= least:
                found.setdefault((s, e - s + p), p)
            s = e
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def circling(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = [f"v{rng.randrange(rng.randint(1, 5))}" for _ in range(rng.randint(0, 90))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 20)
            words = [words[a + (i - a) % p] if i >= a and a + (i - a) % p < len(words) else w for i, w in enumerate(words)]
        yield " ".join(words)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(spark, least):
    texts = [*circling(least, 200), None, "", " ", "x\x0by\x0c" * 12, "é " * 30, "a a " * 5]
    docs = spark.createDataFrame([(None if i % 7 == 0 else i // 2, t, 1, "clash", 2) for i, t in enumerate(texts)], DOCS)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(docs, least=least).collect())
    want = Counter()
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        found = plain_runs(words, least)
        want[None if i % 7 == 0 else i // 2, len(words), tuple(found), plain_collapse([w.decode() for w in words], found)] += 1
    assert got == want


def test_runs_of_long_and_awkward_sequences():
    zeros = np.zeros(30_000, np.int64)
    assert runs.runs_of(zeros).tolist() == [[0, 30_000, 1]]
    thue_morse = np.array([bin(i).count("1") & 1 for i in range(4096)])
    assert runs.runs_of(thue_morse).tolist() == runs._compared(thue_morse, 12).tolist() == [list(r) for r in plain_runs(list(thue_morse))]
    fibonacci = [0]
    other = [0, 1]
    while len(other) < 3000:
        fibonacci, other = other, other + fibonacci
    other = np.array(other)
    assert runs.runs_of(other).tolist() == runs._compared(other, 12).tolist()
    once = np.concatenate((np.arange(5000), np.arange(5000), [3]))
    assert runs.runs_of(once).tolist() == [[0, 10_000, 5000]]


def test_runs_of_nothing(spark):
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_query_against_plain_python(spark, tmp_path):
    texts = [*circling(4, 120), None, "", *(" ".join(f"w{random.Random(i).randrange(40)}" for i in range(k)) for k in (1, 2, 30, 400))]
    spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts * 4):
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found = plain_runs(words)
        best = min(((-m, s, p) for s, m, p in found), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(plain_collapse(words, found))))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(tuple(r[c] for c in names) for r in queries.op13_harmonic_runs(spark, str(tmp_path)).collect()) == want


def plain_lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


def test_clusters_match_brute_force(spark):
    rng = random.Random(2)
    points = [[rng.choice([0.0, 0.25, -1.5, 2.0, 1e-4]) + rng.random() * rng.choice([0, 0, 1]) for _ in range(3)] for _ in range(80)]
    rows = [(i, rng.choice(points)) for i in range(300)] + [(5, points[0]), (5, points[0]), (5, points[1]), (None, points[2]), (None, points[2])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [1.0, float("-inf"), 2.0]), (906, [1.0] * 4)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, q int, cluster int")
    for k, rounds in ((8, 10), (1, 2), (3, 0)):
        found = lloyd.cluster(frame, clusters=k, rounds=rounds, components=3)
        assigned, centroids = plain_lloyd(rows, k, rounds)
        assert Counter(map(tuple, found.assigned.collect())) == Counter(assigned)
        table = {r["cluster"]: r for r in found.centroids.collect()}
        assert [table[c]["centroid"] for c in range(k)] == centroids
        assert all(table[c]["cluster_inertia"] == sum(d for _, n, d in assigned if n == c) and table[c]["vectors"] == sum(n == c for _, n, d in assigned) for c in range(k))
        assert {r["inertia"] for r in table.values()} == {sum(d for _, _, d in assigned)}


def test_clusters_of_huge_components_are_exact(spark):
    rows = [(1, [1e12, 0.0, 0.0]), (2, [1e12, 1.0, 0.0]), (3, [-1e12, 0.0, 5.0]), (4, [3e38, 0.0, 0.0]), (5, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in lloyd.cluster(frame, clusters=2, rounds=3, components=3).assigned.collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found[1]["cluster"] == found[2]["cluster"] and found[3]["distance"] == (1 << 63) - 1


def test_clusters_of_nothing_and_of_few(spark):
    none = lloyd.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.assigned.collect() == [] and none.centroids.collect() == [] and none.assigned.columns == ["vec_id", "cluster", "distance"]
    few = lloyd.cluster(spark.createDataFrame([(7, [0.5] * 64), (7, [0.5] * 64)], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, few.assigned.collect())) == [(7, 0, 0), (7, 0, 0)] and few.centroids.count() == 2
