"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Block j (from 0) of a source with weight w may start at slot
floor(j / w), its release, and must have been placed before slot ceil((j + 1) / w), its deadline. In each
slot the released block with the earliest deadline goes out. Then after t slots each source has
placed less than one block more or less than t * w.

Weights are exact: whole numbers q of their sum Q (w = q / Q), however large, so windows are never rounded.
When a source runs out, the others go on with their own weights, scaled up: a new phase, which starts
from zero. A schedule depends on its own past, so one task runs it from slot to slot and writes it out as it goes, a row for each
block; that task holds a few numbers for each source. The driver gathers nothing, and the rows look their slots up by a join.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastra.llm.common import free_prefix, stored

BLOCK_ROWS = 16
#: Blocks that the scheduling task hands on at once.
BATCH = 65_536


def rounded(weights: Mapping[object, float], period: int) -> dict[object, int]:
    """Whole numbers that add up to the period, at least 1 each, by largest remainder: for callers that ask for a short period."""
    period = max(period, len(weights))
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x + 1e-9)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], str(s))):  # the largest remainders first
        if sum(out.values()) < period:
            out[s] += 1
    while sum(out.values()) > period:  # what very small weights got too much, the largest give
        out[max(out, key=lambda s: (out[s], str(s)))] -= 1
    return out


def whole(weights: Mapping[object, float | Fraction]) -> dict[object, int]:
    """Whole numbers in exactly the weights' proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: w.numerator * (scale // w.denominator) for s, w in exact.items()}


def endless(shares: Mapping[object, int]) -> Iterator[tuple[object, int]]:
    """(source, block) for slot 0, 1, ...: the earliest deadline among the released blocks."""
    period = sum(shares.values())
    order = {s: i for i, s in enumerate(sorted(shares, key=str))}
    waiting = [(0, order[s], s, 0) for s in shares]  # release, tie, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, object, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[s]), i, s, j))
        _, i, s, j = heapq.heappop(ready)
        yield s, j
        heapq.heappush(waiting, ((j + 1) * period // shares[s], i, s, j + 1))
        slot += 1


def period_slots(shares: Mapping[object, int]) -> dict[object, list[int]]:
    """For each source, the slots of its blocks in one period."""
    out: dict[object, list[int]] = {s: [] for s in shares}
    for slot, (s, _) in enumerate(islice(endless(shares), sum(shares.values()))):
        out[s].append(slot)
    return out


def schedule(blocks: Mapping[object, int], weights: Mapping[object, float | Fraction], period: int | None = None) -> Iterator[tuple[object, int]]:
    """(source, block) for every slot of all phases; exact unless a period is given."""
    left, done = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    exact = whole({s: weights[s] for s in left}) if left else {}
    while left:
        shares = {s: exact[s] for s in left} if period is None else rounded({s: weights[s] for s in left}, period)
        placed: dict[object, int] = {}
        for s, j in endless(shares):
            yield s, done[s] + j
            placed[s] = j + 1
            if placed[s] == left[s]:
                break
        for s, n in placed.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}


def tempered(counts: Mapping[object, int], alpha: float = 0.5) -> dict[object, float]:
    """Weights in proportion to a power of the sources' sizes."""
    return {s: n**alpha for s, n in counts.items()}


def _name(source: object) -> str:
    """A key of the caller's weights as the rows' sources are called."""
    return "null" if source is None else f"={str(source).lower() if isinstance(source, bool) else source}"


def mix(docs: DataFrame, weights: Mapping[object, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, period: int | None = None, prefix: str = "mix_") -> DataFrame:
    """All rows and columns of ``docs`` plus (prefix) block, slot and row: sort by slot and row for the mixture.

    ``weights`` has a positive weight for each source (None as key: rows without a source); without it
    they are the square roots of the sources' sizes. They hold exactly; only if a ``period`` is given are they rounded to multiples of
    1 / period. No row is dropped or repeated: when a source runs
    out, the rest go on in their proportions. Within a source the order is that of a hash of the row, then of
    the id; equal rows may change places with each other. The last block of a source may be short. Null
    sources are a source of their own; null ids count like any other id. An empty table gives an empty one.
    Input columns that are named like the new ones are replaced.
    """
    block, slot, row = (f"{prefix}{x}" for x in ("block", "slot", "row"))
    docs = docs.drop(block, slot, row)
    own = free_prefix(docs, "_mix")
    work = {x: own + x for x in ("salt", "salts", "rank", "source", "offset", "slots", "n")}
    given = None if weights is None else {_name(s): Fraction(w) for s, w in weights.items()}
    if given is not None and any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))  # null-safe, and never equal to a name
    sources = stored(docs.groupBy(source.alias(work["source"])).agg(F.count("*").alias(work["n"])), "sources")

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {s.as_py(): n.as_py() for batch in batches for s, n in zip(batch.column(0), batch.column(1), strict=True)}
        if given is not None and (lost := counts.keys() - given.keys()):
            raise ValueError(f"no weight for {sorted(lost)[:5]}")
        wanted = tempered(counts) if given is None else given
        slots, start = schedule({s: -(-n // block_rows) for s, n in counts.items()}, wanted, period), 0
        while part := list(islice(slots, BATCH)):
            numbers = [pa.array([p[1] for p in part], pa.int64()), pa.array(range(start, start + len(part)), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.string()), *numbers], names=["source", "block", "slot"])
            start += len(part)

    plan = stored(sources.coalesce(1).mapInArrow(planned, "source string, block long, slot long"), "slots")

    # A row's place in its source: a source of n rows is cut by a hash into sqrt(n) salts of about sqrt(n) rows, ranked salt by salt.
    hashed = F.xxhash64(*docs.columns)  # of all columns: ids may be null or repeated
    salts = sources.select(work["source"], F.floor(F.sqrt(work["n"])).alias(work["salts"]))
    salted = docs.withColumn(work["source"], source).join(salts, work["source"]).withColumn(work["salt"], F.pmod(hashed, work["salts"])).drop(work["salts"])
    sizes = salted.groupBy(work["source"], work["salt"]).agg(F.count("*").alias(work["n"]))
    before = Window.partitionBy(work["source"]).orderBy(work["salt"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(work["offset"], F.coalesce(F.sum(work["n"]).over(before), F.lit(0)))

    # The slots of the blocks that a salt's rows fall into travel with its offset, so that only salts are joined with the plan.
    nth = lambda rank: F.call_function("div", rank, F.lit(block_rows)).cast("long")
    touched = F.sequence(nth(F.col(work["offset"])), nth(F.col(work["offset"]) + F.col(work["n"]) - 1))
    blocks = offsets.select(F.col(work["source"]).alias("source"), F.col(work["salt"]).alias("salt"), F.col(work["offset"]).alias("offset"), F.explode(touched).alias("block"))
    found = blocks.join(plan, ["source", "block"]).groupBy("source", "salt").agg(F.first("offset").alias(work["offset"]), F.array_sort(F.collect_list(F.struct("block", "slot"))).alias(work["slots"]))
    found = found.select(F.col("source").alias(work["source"]), F.col("salt").alias(work["salt"]), work["offset"], F.col(f"{work['slots']}.slot").alias(work["slots"]))
    rank = F.row_number().over(Window.partitionBy(work["source"], work["salt"]).orderBy(hashed, F.col(id_col)))
    placed = salted.withColumn(work["rank"], rank - 1).join(found, [work["source"], work["salt"]])
    placed = placed.withColumn(work["rank"], F.col(work["rank"]) + F.col(work["offset"]))
    placed = placed.withColumns({block: nth(F.col(work["rank"])), row: F.pmod(F.col(work["rank"]), F.lit(block_rows)).cast("int")})
    return placed.withColumn(slot, F.get(work["slots"], (F.col(block) - nth(F.col(work["offset"]))).cast("int"))).drop(*work.values())
