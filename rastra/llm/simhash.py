"""SimHash near-duplicates through tables of distances to reference fingerprints (pivots).

Every document gets a 64-bit fingerprint. Links are fingerprints at a Hamming distance of at most
``radius`` (3 at most). Pairs are never enumerated; the distances to fixed references stand for the fingerprints.

1. Table. Each half of a fingerprint (32 bits) has its distances to ``PIVOTS`` references, packed into two numbers.
2. Candidates. Of two fingerprints at distance 3 or less, one half differs in at most one bit. If in none, the half's
   distances are equal at every pivot; if in one bit, they differ by exactly 1 at every pivot, and the bit decides at which pivots up and at
   which down: 32 patterns. So every row goes under its own distances and under those moved by each pattern of a bit that is not
   set, and an equi-join of the moved with the own ones meets every such pair once.
3. Hot distances. Where many fingerprints share a half, the same is done again inside that key with the quarters of the other half, one of
   which differs in at most one bit too; what is left shares 48 bits but for two, so its size has a bound whatever the input.
4. Discard. By the triangle inequality a pair whose distances to any pivot differ by more than the radius is no link: the largest
   coordinate difference over the pivots of the whole fingerprint decides. (They follow from the fingerprint, so they are not shuffled with it.)
5. Verify by the true distance.

Copies meet before the join (one row for each fingerprint), so a hot group costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastra.llm.common import checkpointed
from rastra.llm.components import connected_components

#: How many bits may differ: one of two halves then differs in one bit at most.
MAX_RADIUS = 3
#: References for each half. Distances have parity in common, so that this many tell nearly all halves apart.
PIVOTS = 20
#: Bits that a distance takes in a packed number, and distances in each.
_LANE, _LANES = 6, 10
#: References for whole fingerprints.
SPREAD_PIVOTS = 16
#: Pairs that one key may bring into the join before it is split.
HOT_PAIRS = 1 << 16
SEED = 42
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def pivots(n: int = SPREAD_PIVOTS) -> list[int]:
    """Fixed reference fingerprints, spread over the space by hashing their numbers."""
    return [_hash(f"pivot {i}".encode()) for i in range(n)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, unsigned; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text, unsigned; 0 for no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([_hash(joined)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([_hash(joined[a:b]) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row as a signed long; rows stay as they are.

    A-Z are lower-cased; words are parted by ASCII white space; a bit is set if it is in more than
    half of the shingles' hashes. Null and wordless texts have fingerprint 0; fewer words than
    ``width`` are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long holds it."""
    return x - (1 << 64) if x >> 63 else x


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def packed_distances(part: Column, bits: int) -> list[Column]:
    """The distances of a part of ``bits`` bits to its pivots, _LANES of them in each number."""
    refs = [p & ((1 << bits) - 1) for p in pivots(PIVOTS)]
    lanes = [F.shiftleft(F.bit_count(part.bitwiseXOR(F.lit(ref))).cast("long"), _LANE * (n % _LANES)) for n, ref in enumerate(refs)]
    return [reduce(Column.__add__, lanes[at : at + _LANES]) for at in range(0, PIVOTS, _LANES)]


def moves(bits: int) -> list[Column]:
    """For each packed number, an array of what it gains if one bit is set, by bits; the last entry is 0, for no change."""
    refs = pivots(PIVOTS)
    gain = lambda bit, at: sum((1 - 2 * (ref >> bit & 1)) << _LANE * n for n, ref in enumerate(refs[at : at + _LANES]))
    return [F.array(*[F.lit(gain(bit, at)).cast("long") for bit in range(bits)], F.lit(0).cast("long")) for at in range(0, PIVOTS, _LANES)]


def _part(fp: Column, low: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, half, part, first, second): two rows for each fingerprint, with the distances of each half to its pivots."""
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("part", _part(F.col("fp"), F.col("half") * 32, 32))
    first, second = packed_distances(F.col("part"), 32)
    return halves.select("fp", "half", "part", first.alias("first"), second.alias("second"))


def max_difference(a: Column, b: Column) -> Column:
    """The largest difference of two fingerprints' distances to the spread pivots: never more than their own distance."""
    return F.greatest(*[F.abs(distance(a, F.lit(signed(p))) - distance(b, F.lit(signed(p)))) for p in pivots()])


def links(fps: DataFrame, radius: int = MAX_RADIUS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(a, b): the pairs of different fingerprints within ``radius``, a < b, each once.

    ``fps`` has a column fp without repeated values. No pair is lost: see the module's text.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must lie in 0 to {MAX_RADIUS}")
    bit, own = F.col("bit"), F.col("bit") == 32
    unset = _part(F.col("part"), bit, 1) == 0
    moved = pivot_table(fps).select("*", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bit")).where(own | unset)
    shifted = [F.col(c) + F.get(gains, bit) for c, gains in zip(("first", "second"), moves(32), strict=True)]
    keyed = moved.select("fp", "half", own.alias("own"), F.xxhash64("half", *shifted).alias("key"))
    of_key = Window.partitionBy("key")
    met = keyed.withColumns({"owns": F.sum(F.col("own").cast("long")).over(of_key), "rows": F.count("*").over(of_key)}).where("owns > 0 and rows > 1")
    met = checkpointed(met)

    def verified(probes: DataFrame, owns: DataFrame) -> DataFrame:
        a, b = probes.alias("a"), owns.alias("b")
        other = (F.col("a.fp") < F.col("b.fp")) | (~F.col("a.own") & (F.col("a.fp") != F.col("b.fp")))
        close = (max_difference(F.col("a.fp"), F.col("b.fp")) <= radius) & (distance(F.col("a.fp"), F.col("b.fp")) <= radius)
        return a.join(b, (F.col("a.key") == F.col("b.key")) & other & close).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))

    few, hot = met.where(F.col("owns") * F.col("rows") <= hot_pairs), met.where(F.col("owns") * F.col("rows") > hot_pairs)
    quarters = hot.select("fp", "own", "key", F.explode(F.array(F.lit(0), F.lit(16))).alias("low"), "half").withColumn("part", _part(F.col("fp"), (1 - F.col("half")) * 32 + F.col("low"), 16))
    first, second = packed_distances(F.col("part"), 16)
    quarters = quarters.select("*", first.alias("first"), second.alias("second"), F.explode(F.sequence(F.lit(0), F.lit(16))).alias("bit"))
    sign = F.when(unset, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long"))
    shifted = [F.col(c) + sign * F.get(gains, bit) for c, gains in zip(("first", "second"), moves(16), strict=True)]
    quarters = quarters.select("fp", "own", "bit", F.xxhash64("key", "low", *shifted).alias("key"))
    split = verified(quarters.drop("bit"), quarters.where("own and bit = 16").drop("bit"))
    return verified(few, few.where("own")).union(split).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = MAX_RADIUS) -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each row of ``docs``.

    component_id is the least id that is reachable over links, the row itself included. Rows with a
    null id are linked as others are, but no component is named after them: it is null only if
    all of the component's ids are. Repeated rows stay repeated. Other columns of ``docs`` are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, width))
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(classes.select("fp"), radius), "a", "b")
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return fps.join(members, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
