"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random
from collections import Counter
from functools import partial

import xxhash
from pyspark.sql import functions as F

from rastra.llm import components, near, simhash, suffixes

SCHEMA = "doc_id long, text string, fp string, component_id long"
_h = partial(xxhash.xxh64_intdigest, seed=42)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [_h(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(fps):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted((str(i), f"{fp:016x}", least.get(find(n))) for n, (i, fp) in enumerate(fps))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 60]))) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(texts).split(" ")
        t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    return texts


def test_simhash_matches_brute_force(spark):
    rows = list(enumerate([*corpus(1, 60), None, "", "  \t\n", "Ä É ü", "A b C", "a B c", "x" * 100_000, "zz " * 20_000]))
    rows += [(3, "again another text"), (None, "A b c"), (None, None), rows[5], rows[5]]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == plain_components(rows)


def test_simhash_links_are_complete(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps):
        for d in (1, 2, 3, 4):
            fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), d)))
    table = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(table).collect()}
    want = {frozenset((simhash.signed(x), simhash.signed(y))) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3}
    assert got == want
    assert {frozenset((r["a"], r["b"])) for r in simhash.links(table, hot_pairs=0).collect()} == want
    close = [signed ^ low for signed in (5 << 40,) for low in rng.sample(range(1 << 14), 400)]
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(x,) for x in close], "fp long"), hot_pairs=1000).collect()}
    assert got == {frozenset((x, y)) for x in close for y in close if x < y and (x ^ y).bit_count() <= 3}


def test_distances_to_pivots_move_as_bits_do(spark):
    rng = random.Random(8)
    rows = [(x, b) for x in (rng.getrandbits(32) for _ in range(50)) for b in range(32) if not x >> b & 1]
    table = spark.createDataFrame(rows, "x long, b int")
    first, second = simhash.packed_distances(F.col("x"), 32)
    moved_first, moved_second = simhash.packed_distances(F.expr("x | shiftleft(1L, b)"), 32)
    gain_first, gain_second = (F.get(g, F.col("b")) for g in simhash.moves(32))
    assert table.where((first + gain_first != moved_first) | (second + gain_second != moved_second)).count() == 0


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "p long, q long"), "p", "q").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_a_family_of_near_copies_takes_few_stages(spark):
    rng = random.Random(11)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(90)], []
    for _ in range(60):
        text = list(rng.choice([base, base, *texts[-5:]]))
        for at in rng.sample(range(90), rng.randint(1, 5)):
            text[at] = f"x{rng.randrange(10**6)}"
        texts.append(text)
    texts += [texts[3], texts[3], base[:2], base[:2], [], []]
    sets = [set(near.shingles(near.word_hashes(" ".join(t))).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string")
    coalesce, group = "spark.sql.adaptive.coalescePartitions.enabled", "near copies"
    spark.conf.set(coalesce, "false")
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = near.components(docs, "row").collect()
    finally:
        spark.conf.unset(coalesce)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    groups = lambda of: sorted(sorted(i for i in of if of[i] == c) for c in set(of.values()))
    assert groups({r["row"]: r["component"] for r in got}) == groups(dict(enumerate(root)))
    # Where partitions are many, each stage is as many tasks, files and events, however few the rows.
    tracker = spark.sparkContext.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    ran = [info for i in stages if (info := tracker.getStageInfo(i)) and info.numCompletedTasks]
    assert len(ran) <= 180


def plain_removal(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def repetitive(seed):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(blocks) for _ in range(rng.randint(0, 8))) + str(rng.random())[: rng.randint(0, 9)] for _ in range(40)]
    return [*texts, None, "", "a" * 300, "a" * 31, "ab" * 200, "short", texts[3], texts[3]]


def removed(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffixes.without_repeats(docs, **options).collect())


def test_removal_matches_brute_force(spark):
    rows = [*enumerate(repetitive(3)), (None, "a" * 250), (2, "another text with that id")]
    assert removed(spark, rows, length=32, k=12) == plain_removal(rows, 32)


def test_large_families_are_counted_alike(spark):
    rows = list(enumerate(repetitive(4)))
    assert removed(spark, rows, length=32, k=8, family=2) == plain_removal(rows, 32)


def test_removal_empty(spark):
    assert removed(spark, []) == []


def test_suffix_arrays():
    rng = random.Random(5)
    for _ in range(300):
        text = [rng.randint(0, rng.choice([0, 1, 3, 9])) for _ in range(rng.randint(0, 50))]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_families_against_all_windows():
    rng = random.Random(6)
    for _ in range(300):
        reach, letters = rng.randint(1, 8), rng.choice([b"ab", b"abc", b"a"])
        part = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(0, reach)))
        members = [(part(), part()) for _ in range(rng.randint(2, 6))]
        window = lambda m, x: (m[0][len(m[0]) - x :], m[1][: reach - x]) if len(m[0]) >= x and len(m[1]) >= reach - x else None
        want = [[x for x in range(reach + 1) if window(m, x) and any(window(o, x) == window(m, x) for o in members if o is not m)] for m in members]
        assert [sorted(x) for x in suffixes.family_windows(members, reach)] == want


def test_equal_rows_and_runs_of_one_byte_stay_linear(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(10**6)) for _ in range(n))
    hot, other = prose(300), prose(300)
    rows = [(1, hot)] * 10_000 + [(2, hot), (None, hot), (3, " " * 1_000_000), (4, other + " " * 300), (5, hot[:500] + other[:150]), (6, prose(50)), (7, "x" * 199), (8, "x" * 199)]
    got = Counter(removed(spark, rows))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    whole = lambda i, t: (str(i), len(t), len(t), 1, digest(b""), b"")
    kept = lambda i, t, a: (str(i), len(t), len(t) - len(a), int(len(a) < len(t)), digest(a.encode()), a.encode())
    want = Counter([whole(1, hot)] * 10_000 + [whole(2, hot), whole(None, hot), whole(3, " " * 1_000_000), kept(4, rows[10_003][1], other)])
    want += Counter([kept(5, rows[10_004][1], other[:150]), kept(6, rows[10_005][1], rows[10_005][1]), kept(7, "x" * 199, "x" * 199), kept(8, "x" * 199, "x" * 199)])
    assert got == want


def test_batches_keep_runs_and_copies_short():
    import pyarrow as pa

    texts = [b" " * 5000, b"ab" * 3000, bytes(range(256)) * 3, bytes(range(256)) * 3 + b"end"]
    batch = pa.RecordBatch.from_pydict({"h1": pa.array(range(4), pa.int64()), "h2": pa.array(range(4), pa.int64()), "copies": pa.array([1] * 4, pa.int64()), "body": texts})
    (out,) = suffixes._segments_of(iter([batch]), 200, 108)
    assert out.num_rows < 60
