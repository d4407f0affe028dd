"""The wide mode of the SimHash operator: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

Every text has a SimHash fingerprint of its different words (of equal sets, the same one), and the operator's table of pivot distances (`simhash.links`) finds all fingerprints within 3 bits; exact sets verify.
Pairs at 0.8 may differ in more bits, which no equi-join on parts of a fingerprint finds. So pairs of more than 3 bits are searched by bands of MinHash values: 25 bands of 5, so that a pair at 0.8 is met with a probability of
1 - (1 - 0.8 ** 5) ** 25 = 0.99995, and more above. Exact shingle sets verify every candidate of either kind, so no other pair is linked.

Texts with the same shingles are one class before anything is joined. Of the classes in a bucket, each is first compared with the
one that meets most others, and each fingerprint with the linked one that has most links, so that a hot group of copies is no square. Larger buckets and linked fingerprints
that are in more than one component after that are searched by an exact prefix
join: shingles in order of their frequency, the rare ones first; of sets of n shingles, two at 0.8 share one among their n - ceil(0.8 n) + 1 first,
and the place of the first shared one bounds what they can share. Members of a large family whose own edits set them apart so meet nobody.
What that finds links components, so the last search for components has those as its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.llm.common import checkpointed, settled, stored
from rastra.llm.components import stars as components_of
from rastra.llm.simhash import MAX_RADIUS, distance, links, majority

WIDTH = 5
BANDS, BAND_ROWS = 25, 5
_hash, _second = (partial(xxhash.xxh64_intdigest, seed=seed) for seed in (42, 43))
SET = "decimal(38,0)"


def _numbers(what: str, n: int) -> np.ndarray:
    """Fixed odd multipliers."""
    return np.array([_hash(f"{what} {i}".encode()) | 1 for i in range(n)], np.uint64)


_PLACES, _TIMES, _PLUS = _numbers("place", WIDTH), _numbers("times", BANDS * BAND_ROWS), _numbers("plus", BANDS * BAND_ROWS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word, in order."""
    return np.array([_hash(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted different hashes of a text's shingles, from its words' hashes: none without a word, one for fewer words than a shingle has."""
    if not len(words):
        return words
    n = max(1, len(words) - WIDTH + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(WIDTH, len(words))):
        total += _mixed(words[i : i + n] + _PLACES[i]) * _PLACES[i]
    return np.unique(_mixed(total))


def fingerprint(words: np.ndarray) -> int:
    """The SimHash of the different words: an edit changes one of them, but five shingles, so near copies differ in fewer bits than by shingles."""
    return majority(np.unique(words))


def bands(grams: np.ndarray) -> np.ndarray:
    """A key for each band of the least permuted hashes."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[None, at : at + 2048] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    rows = _mixed(least).reshape(BANDS, BAND_ROWS)
    return _mixed((rows * _PLACES[None, :BAND_ROWS]).sum(axis=1, dtype=np.uint64) + _PLUS[:BANDS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, set, n, fp, bands) of (row, text)."""
    for batch in batches:
        grams, fps = [], []
        for text in batch.column(1):
            words = word_hashes(text.as_py())
            grams.append(shingles(words))
            fps.append(fingerprint(words))
        # 125 bits as one number, so that sets that differ are not taken for one in any corpus.
        both = np.array([(_hash(g.tobytes()), _second(g.tobytes()) >> 3) if len(g) else (0, 0) for g in grams], np.uint64).reshape(-1, 2)
        sets = pa.Array.from_buffers(pa.decimal128(38, 0), len(grams), [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())])
        keys = pa.array([bands(g).view(np.int64) if len(g) else [] for g in grams], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), sets, pa.array([len(g) for g in grams], pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), keys], names=["row", "set", "n", "fp", "bands"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, grams) of (set, text)."""
    for batch in batches:
        grams = pa.array([shingles(word_hashes(t.as_py())).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["set", "grams"])


def _sizes_fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _alike(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, root_a, root_b) whose sets have a similarity of 0.8 or more, as links (a, b) of their roots; grams: (set, grams) of each set."""
    side = lambda x: grams.select(F.col("set").alias(x), F.col("grams").alias(f"grams_{x}"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return checkpointed(pairs.join(side("a"), "a").join(side("b"), "b").where(both * 5 >= (F.size("grams_a") + F.size("grams_b") - both) * 4).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))


def _prefix_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b), a < b, each once: pairs of (set, n, root, grams) with different roots that may have a similarity of 0.8; none that has is left out."""
    sets = checkpointed(sets)
    each = sets.select("set", F.explode("grams").alias("gram"))
    each = each.join(checkpointed(each.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1")), "gram")
    # Shingles that occur once come first and meet nobody: they only move the places of the others.
    order = Window.partitionBy("set")
    each = each.withColumns({"others": F.count("*").over(order), "rank": F.row_number().over(order.orderBy("times", "gram"))})
    placed = each.join(sets.select("set", "n", "root"), "set").withColumn("place", F.col("n") - F.col("others") + F.col("rank"))
    prefix = checkpointed(placed.where("place <= n - div(4 * n + 4, 5) + 1").select("set", "n", "root", "gram", "place"))  # div(4 n + 4, 5) is ceil(0.8 n)
    a, b = prefix.alias("a"), prefix.alias("b")
    met = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.set") < F.col("b.set")) & (F.col("a.root") != F.col("b.root")) & _sizes_fit(F.col("a.n"), F.col("b.n"))
    # A similarity of 0.8 takes 4/9 of both sizes together; what is shared lies at or after the first shared shingle.
    enough = F.expr("9 * (least(a.n - a.place, b.n - b.place) + 1) >= 4 * (a.n + b.n)")
    return a.join(b, met & enough).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.col("a.root").alias("root_a"), F.col("b.root").alias("root_b")).distinct()


def _close_stars(sets: DataFrame, heads: DataFrame, close: DataFrame) -> DataFrame:
    """(a, b), a < b: sets to compare first, of (set, n, fp) and the links (a, b) of fingerprints: each with the head that stands for its fingerprint, and that with the head of the linked fingerprint that has most links."""
    same = sets.join(heads.where("many > 1"), "fp").where((F.col("set") != F.col("head.set")) & _sizes_fit(F.col("n"), F.col("head.n"))).select(F.col("head.set").alias("a"), F.col("set").alias("b"))
    ends = close.groupBy("a").agg(F.count("*").alias("n")).union(close.groupBy("b").agg(F.count("*").alias("n")))
    degrees = checkpointed(ends.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("degree")))
    degree = lambda x: degrees.select(F.col("fp").alias(x), F.col("degree").alias(f"degree_{x}"))
    known = close.join(degree("a"), "a").join(degree("b"), "b")
    best = known.groupBy("a").agg(F.max(F.struct(F.col("degree_b").alias("degree"), F.col("b").alias("fp"))).alias("best"))
    best = best.union(known.groupBy("b").agg(F.max(F.struct(F.col("degree_a").alias("degree"), F.col("a").alias("fp"))).alias("best")))
    middle = best.groupBy("a").agg(F.max("best")["fp"].alias("b"))
    side = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}"))
    linked = middle.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(F.col("head_a.n"), F.col("head_b.n")))
    linked = linked.select(F.least("head_a.set", "head_b.set").alias("a"), F.greatest("head_a.set", "head_b.set").alias("b")).distinct()
    return same.union(linked)


def _close_apart(owned: DataFrame, close: DataFrame) -> DataFrame:
    """The rows of (set, n, fp, root) whose fingerprint, with those linked to it in ``close``, is in more than one component."""
    ends = owned.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    side = lambda x: ends.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    linked = close.join(side("a"), "a").join(side("b"), "b").where(F.least("low_a", "low_b") < F.greatest("high_a", "high_b"))
    mixed = linked.select(F.explode(F.array("a", "b")).alias("fp")).union(ends.where("low < high").select("fp")).distinct()
    return owned.join(mixed, "fp", "left_semi")


def _rooted(sets: DataFrame, roots: DataFrame, of: str = "set") -> DataFrame:
    """``sets`` with column root, the root of column ``of``: that itself where it hangs below no other."""
    found = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return sets.join(found, F.col(of) == F.col("_node"), "left").withColumn("root", F.coalesce("_root", of)).drop("_node", "_root")


def components(docs: DataFrame, row_col: str, text_col: str = "text") -> DataFrame:
    """(row_col, component) of rows whose texts have a 5-word shingle similarity of 0.8 or more.

    row_col must be a unique long that stays the same when read again. Texts without a word are one class; null counts as empty.
    """
    rows = docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = checkpointed(rows.mapInArrow(_sets, f"row long, set {SET}, n long, fp long, bands array<long>"))
    classes = found.groupBy("set").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("row"))
    # The fingerprints' own way first: all within 3 bits, by the table of pivot distances.
    sets = checkpointed(classes.where("n > 0").select("set", "n", "fp", "row"))
    close = checkpointed(links(sets.select("fp").distinct()))
    heads = checkpointed(sets.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("head"), F.count("*").alias("many")))
    keyed = classes.select("set", "n", "fp", F.explode("bands").alias("key"))
    # What is asked of a bucket is aggregated, partly before it moves, and joined back: Spark splits such joins where one bucket holds much.
    many = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    met = checkpointed(keyed.join(many, "key"))
    # The middle of a bucket is the class that meets most others over all buckets: of a family of edited copies, one that was edited least.
    meets = met.groupBy("set").agg(F.sum("many").alias("meets"))
    ranked = checkpointed(met.join(meets, "set"))
    middle = checkpointed(ranked.groupBy("key").agg(F.min(F.struct(-F.col("meets"), "set", "n", "fp")).alias("first")))
    # What lies within 3 bits is for the fingerprints to link; the bands look for the rest.
    stars = ranked.join(middle, "key").where((F.col("set") != F.col("first.set")) & _sizes_fit(F.col("n"), F.col("first.n")) & (distance(F.col("fp"), F.col("first.fp")) > MAX_RADIUS))
    stars = stars.select(F.least("first.set", "set").alias("a"), F.greatest("first.set", "set").alias("b")).distinct()
    stars = settled(checkpointed(_close_stars(sets.drop("row"), heads, close).union(stars)))
    # Sets of a bucket with another that its size allows, read again once for both comparisons: a bucket's different sizes are few.
    by_size = Window.partitionBy("key").orderBy("n")
    sizes = met.groupBy("key", "n").agg(F.count("*").alias("equal")).withColumns({"more": F.lead("n").over(by_size), "less": F.lag("n").over(by_size)})
    sizes = checkpointed(sizes.where((F.col("equal") > 1) | _sizes_fit(F.col("n"), F.col("more")) | _sizes_fit(F.col("less"), F.col("n"))).select("key", "n"))
    fitting = met.join(sizes, ["key", "n"], "left_semi").select("set")
    meeting = close.select(F.explode(F.array("a", "b")).alias("fp")).union(heads.where("many > 1").select("fp")).distinct()
    fitting = fitting.union(sets.join(meeting, "fp", "left_semi").select("set")).distinct()
    needed = sets.select("set", "row").join(fitting, "set")
    grams = settled(stored(rows.join(needed, "row").select("set", "text").mapInArrow(_grams, f"set {SET}, grams array<long>"), "grams"))
    roots = components_of(_alike(stars.select("*", F.col("a").alias("root_a"), F.col("b").alias("root_b")), grams), "a", "b")
    owned = settled(checkpointed(_rooted(sets.select("set", "n", "fp"), roots)))
    apart = checkpointed(met.where("many > 2").select("key", "set").join(owned, "set"))
    mixed = checkpointed(apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    apart = apart.join(mixed, "key", "left_semi").select("set", "n", "root").union(_close_apart(owned, close).select("set", "n", "root")).distinct()
    rest = settled(checkpointed(_prefix_pairs(grams.join(apart, "set")).join(stars, ["a", "b"], "left_anti")))
    if not rest.isEmpty():  # links between the roots: components of those
        owned = _rooted(owned, components_of(_alike(rest, grams), "a", "b"), "root")
    return found.join(owned.select("set", "root"), "set", "left").select(F.col("row").alias(row_col), F.coalesce("root", "set").alias("component"))
