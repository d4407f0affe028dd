"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of the item's distinct word shingles are in
the document. Documents may be thousands of times longer than items, where the usual banded MinHash
signatures of whole sets miss almost everything (their Jaccard similarity is near 0). So each item is
sketched by its least hashes (a bottom-k MinHash), and the sizes are what decides k: of an item with n
shingles, a document that contains it lacks at most n - ceil(threshold * n), so at least one of the
item's n - ceil(threshold * n) + 1 least hashes is in the document. Items are partitioned by n (by powers of two in the
join; exactly for k), and a document meets only partitions whose items are small enough for it; no true pair is lost. The candidates are
verified by exact containment of the shingles themselves.

Both sides are tables. Documents are read once: a pass hashes all of their shingles (a polynomial over the bytes, by numpy) and tests
them against a Bloom filter of all sketches, whose size has a bound whatever the benchmark's; a fuller filter only lets more through.
Documents with a hit go on, meet the sketches in an equi-join (salted, because a passage may be in a third of all documents), and stream
past their candidates' texts, sorted by document, for the exact test. The driver holds the filter and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import free_prefix, stored

WIDTH = 5
THRESHOLD = 0.8
#: Bits of the Bloom filter for each hash, and bytes that the filter has at most.
BITS_PER_HASH, BLOCK_BYTES = 64, 16 << 20
#: Where the bits of a hash lie that give its places in the filter.
FILTER_SHIFTS = (37, 0, 18, 9)
#: Ways that a hash of the join is dealt out.
SALTS = 16
#: Contaminated keys that clean() broadcasts; more are joined by a shuffle.
MAX_BROADCAST = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: ASCII letters in lower case and digits; all other ASCII becomes a space.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower-cased words of letters, digits and anything beyond ASCII, parted by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def bounds(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end."""
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.append(gaps, len(plain))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(plain: bytes, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, alike for alike bytes wherever they stand."""
    n = len(starts) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(plain, np.uint8).astype(np.uint64) + np.uint64(1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * _powers(len(raw), _BASE), dtype=np.uint64)))
    a, b = starts[:n], ends[width - 1 :]
    h = (prefix[b] - prefix[a]) * _powers(len(raw) + 1, _INVERSE)[a]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def sketch(text: str | None, width: int, threshold: float) -> tuple[int, int, list[int]]:
    """(words a shingle, different shingles, least hashes) of an item; (0, 0, []) without a word."""
    plain = normal(text)
    starts, ends = bounds(plain)
    if not len(starts):
        return 0, 0, []
    w = min(width, len(starts))
    by_hash = dict(zip(shingle_hashes(plain, starts, ends, w).tolist(), shingles(plain, starts, ends, w), strict=True))
    n = len(set(by_hash.values()))
    return w, n, sorted(by_hash)[: n - math.ceil(threshold * n - 1e-9) + 1]


def shingles(plain: bytes, starts: np.ndarray, ends: np.ndarray, width: int) -> list[bytes]:
    """The shingles themselves, in the order of shingle_hashes()."""
    n = len(starts) - width + 1
    return [plain[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)] if n > 0 else []


def contained(item: bytes, doc: bytes, width: int, doc_shingles: dict[int, frozenset[bytes]]) -> float:
    """The share of the item's shingles (of so many words) that a document has; ``doc_shingles`` keeps the document's own by width."""
    own = frozenset(shingles(item, *bounds(item), width))
    if width not in doc_shingles:
        doc_shingles[width] = frozenset(shingles(doc, *bounds(doc), width))
    return len(own & doc_shingles[width]) / len(own)


class Sketches:
    """A few items in memory: what a search of one text by their sketches finds. The tables below do the same at any size."""

    def __init__(self, items: list[tuple[object, str]], width: int, threshold: float):
        self.items = [(key, text, *sketch(text, width, threshold)) for key, text in items]

    def search(self, text: str | None, threshold: float) -> list[tuple[object, float]]:
        """(item, containment) of each item that the text contains."""
        plain, seen, found = normal(text), {}, []
        starts, ends = bounds(plain)
        hashes = {w: set(shingle_hashes(plain, starts, ends, w).tolist()) for w in {i[2] for i in self.items if i[2]}}
        for key, item, w, _, least in self.items:
            if w and not hashes[w].isdisjoint(least):
                share = contained(normal(item), plain, w, seen)
                if share >= threshold - 1e-9:
                    found.append((key, share))
        return found


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64) if len(values) else [], pa.int64())


def bloom(hashes: DataFrame, block_bytes: int) -> tuple[np.ndarray, int]:
    """(64-bit words, hash bits of a place) of a filter over column hash: a place for each of FILTER_SHIFTS, found and merged by Spark."""
    n = hashes.count()
    bits = max(6, min((block_bytes * 8).bit_length() - 1, (BITS_PER_HASH * n).bit_length()))
    places = F.explode(F.array(*[F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in FILTER_SHIFTS]))
    words = hashes.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    out = np.zeros(1 << bits - 6, np.int64)
    for word, value in words.collect():  # at most block_bytes / 8 words
        out[word] = value
    return out.view(np.uint64), bits


def in_bloom(hashes: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes the filter may hold."""
    left = np.arange(len(hashes))
    for shift in FILTER_SHIFTS:
        place = hashes[left] >> np.uint64(shift) & np.uint64((1 << bits) - 1)
        left = left[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, threshold: float, block_bytes: int) -> DataFrame:
    """(row, id, h1, h2, item, containment) of the pairs; row numbers the documents with a hit, h1 and h2 are hashes of the text."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sketch(t.as_py(), width, threshold) for t in batch.column("text")]
            least = pa.array([np.array(e[2], np.uint64).view(np.int64) for e in each], pa.list_(pa.int64()))
            yield _batch(item=batch.column("item"), text=batch.column("text"), width=pa.array([e[0] for e in each], pa.int32()), n=pa.array([e[1] for e in each], pa.int64()), least=least)

    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    items = items.mapInArrow(sketched, f"item {kind}, text string, width int, n long, least array<long>").where("width > 0").withColumn("no", F.monotonically_increasing_id())
    items = stored(items, "items")
    # ceil(threshold * n) is the least size of a document that contains the item; sizes are parted by powers of two.
    keys = items.select("no", "width", "n", F.log2("n").cast("int").alias("size"), F.explode("least").alias("hash"))
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most ``width`` of them
    words, bits = bloom(keys.select("hash"), block_bytes)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = [], []
            for i, text in enumerate(batch.column("text")):
                plain = normal(text.as_py())
                starts, ends = bounds(plain)
                own = []
                for w in widths:
                    hashes = shingle_hashes(plain, starts, ends, w)
                    passed = hashes[in_bloom(hashes, words, bits)]
                    if len(passed):
                        passed, n = np.unique(passed), len(hashes)
                        own += [{"width": w, "n": n, "hash": h} for h in passed.view(np.int64).tolist()]
                if own:
                    places.append(i)
                    found.append(own)
            if places:
                kept = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.struct([("width", pa.int32()), ("n", pa.int64()), ("hash", pa.int64())])))], names=[*kept.schema.names, "hits"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    touched = rows.mapInArrow(hits, f"id {kind}, text string, hits array<struct<width: int, n: long, hash: long>>")
    touched = stored(touched.withColumn("row", F.monotonically_increasing_id()), "touched")  # numbered once, in files

    sizes = F.sequence(F.lit(0), F.log2(F.col("hit.n") / F.lit(threshold) + 1e-6).cast("int"))
    met = touched.select("row", F.explode("hits").alias("hit")).select("row", "hit.*", F.explode(sizes).alias("size"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    salted = keys.select("no", "width", "size", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = met.join(salted, ["width", "size", "hash", "salt"]).select("row", "no").distinct()

    # Each document's text, then its candidates' texts: one task sees them in this order and holds one document.
    nothing = lambda kind: F.lit(None).cast(kind)
    wanted = pairs.join(items.select("no", "width", F.col("text").alias("body")), "no").select("row", "no", "width", "body")
    stream = touched.join(pairs.select("row").distinct(), "row", "left_semi").select("row", nothing("long").alias("no"), nothing("int").alias("width"), F.col("text").alias("body")).union(wanted)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seen = b"", {}
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for row, no, w, body in zip(*(batch.column(c).to_pylist() for c in ("row", "no", "width", "body")), strict=True):
                if no is None:
                    doc, seen = normal(body), {}
                else:
                    share = contained(normal(body), doc, w, seen)
                    if share >= threshold - 1e-9:
                        found.append((row, no, share))
            yield _batch(**{c: pa.array([f[i] for f in found], kind) for i, (c, kind) in enumerate((("row", pa.int64()), ("no", pa.int64()), ("containment", pa.float64())))})

    dealt = stream.repartition("row").sortWithinPartitions("row", F.col("no").asc_nulls_first())
    pairs = stored(dealt.mapInArrow(verified, "row long, no long, containment double"), "contained")
    named = touched.select("row", "id", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    return pairs.join(named, "row").join(items.select("no", "item"), "no").select("row", "id", "h1", "h2", "item", "containment")


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_col, containment): every pair of a row and an item it contains.

    Case and punctuation don't count. Items with fewer than ``width`` words are one shingle of all their
    words; items and texts that are null or have no word match nothing. Repeated rows and items give
    repeated pairs. Null ids stay null. An empty table on either side gives no pair. Other columns are not read.
    ``block_bytes`` bounds the filter that travels to every task; a small one lets more through to the join, but changes no result.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, width, threshold, block_bytes)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "containment")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    A row goes if any row with its id is contaminated; rows with a null id are judged by their text's hash instead. The contaminated
    keys are broadcast if they are at most ``max_broadcast``, so that no text moves; more of them are joined by a shuffle.
    """
    own = free_prefix(docs, "_item")
    key = lambda i, h1, h2: F.coalesce(F.concat(F.lit("id "), i.cast("string")), F.concat_ws(" ", F.lit("text"), h1, h2))
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, width, threshold, block_bytes)
    bad = stored(found.select(key(F.col("id"), F.col("h1"), F.col("h2")).alias(own)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= max_broadcast else bad
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(own, key(F.col(id_col), F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)))
    return keyed.join(bad, own, "left_anti").select(*docs.columns)

