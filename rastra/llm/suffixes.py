"""Repeated byte strings by suffix arrays, built by grouping.

Every string of ``length`` bytes that starts at two or more places is removed wherever it occurs. The corpus is
cut so that suffix arrays stay small and still see every repeat:

1. Anchors. Of the ``k``-byte strings inside a window of ``length`` bytes, that with the least hash is the window's
   anchor. Equal windows have equal anchors at equal offsets. The windows that share an anchor are
   neighbours and make up a segment; a text is a sequence of segments (one for about 47 bytes).
2. Equal segments. Segments with equal bytes and an equal anchor offset repeat as wholes. They are counted: in each
   batch first, then over all by anchor.
3. Families. Different segments around one anchor may still share windows. A family's segments, each as
   the bytes left of the anchor, one symbol for the anchor and the bytes right of it, are the text of one suffix
   array (less what all or no two of them share); a window is repeated if the common prefix with a neighbour in suffix order covers it.
   Families of more than ``FAMILY`` segments are never gathered: they are halved by where their windows lie about the anchor and split by
   the further bytes that all windows of a half cover, again and again, until they are small or only equal segments are left.

The suffix array is built by grouping (`suffix_array`): groups of suffixes with a common Lyndon prefix are
processed from the largest down, and pointers to the previous smaller group split the groups below; a
second pass emits the order inside every group. There is no renaming and no recursion. Both passes are linear, but for the sorting of
starts by their first symbol and within a group.

What decides a byte: segments that are equal as wholes, and parts of large families that are, by counting hashes; all other repeats by suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastra.llm.common import stored

LENGTH = 200
ANCHOR = 108
#: Segments of one family that a suffix array is built over at most; larger families are split.
FAMILY = 64
#: Windows that are looked at together; positions then fit the low bits of a number.
_CHUNK, _LOW = 1 << 16, np.uint64((1 << 17) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the text's suffixes in order. Symbols are numbers; a prefix comes before what it begins."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(sa):
        if i and text[s] != text[sa[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    # First pass: groups from the largest down; prev[s] is the nearest earlier suffix of a smaller group.
    prev: list[int | None] = [None] * n
    end = n
    while end:
        first = group[sa[end - 1]]
        members = sorted(sa[first:end])
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[s] = p
        pointed = Counter(prev[s] for s in members)
        pointed.pop(-1, None)
        # The more often the group's prefix follows a suffix, the larger that is in its group: it moves to the group's end.
        by_count: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[times]:
                moved.setdefault(group[p], []).append(p)
            for g, suffixes in moved.items():
                left = size[g] - len(suffixes)
                if not left:
                    continue
                to = g + size[g]
                for p in suffixes:
                    to -= 1
                    other, at = sa[to], place[p]
                    sa[to], sa[at], place[p], place[other] = p, other, to, at
                for p in suffixes:
                    group[p] = g + left
                size[g], size[g + left] = left, len(suffixes)
        end = first
    # Second pass: in ascending order, each suffix places those whose Lyndon prefix ends where it starts.
    done, out, free = [False] * n, [0] * n, list(range(n))
    for i in range(-1, n):
        s = (out[i] if i >= 0 else n) - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = prev[s]
    return out


def common_prefixes(text: Sequence[int], sa: Sequence[int]) -> list[int]:
    """For each suffix, the longest prefix it shares with the one before it in order, by starts."""
    n = len(sa)
    before = [-1] * n
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    shared, h = [0] * n, 0
    for s in range(n):
        p = before[s]
        if p < 0:
            h = 0
            continue
        most = n - max(s, p)
        while h < most and text[s + h] == text[p + h]:
            h += 1
        shared[s] = h
        h = max(0, h - 1)
    return shared


def _longest_shared(parts: Sequence[bytes]) -> tuple[int, int]:
    """(the prefix that all share, the longest prefix that any two share)."""
    ordered = sorted(parts)
    shared = []
    for a, b in zip(ordered, ordered[1:], strict=False):
        n = min(len(a), len(b))
        shared.append(next((i for i in range(n) if a[i] != b[i]), n))
    return min(shared), max(shared)


def family_windows(members: Sequence[tuple[bytes, bytes]], reach: int) -> list[list[int]]:
    """For each member (bytes left and right of the anchor), the distances before the anchor at which repeated windows start.

    A window is x bytes on the left, the anchor and ``reach`` - x bytes on the right. What all members have next to the
    anchor is taken into its symbol, and what no two share beyond is left off; the rest is the text of the suffix array.
    """
    if len(members) < 2:
        return [[] for _ in members]
    flipped = [left[::-1] for left, _ in members]
    (all_left, most_left), (all_right, most_right) = _longest_shared(flipped), _longest_shared([right for _, right in members])
    m = len(members)
    text: list[int] = []
    begins = []
    for i, (left, right) in enumerate(members):
        begins.append(len(text))
        text += [c + m + 1 for c in left[max(0, len(left) - most_left) : len(left) - all_left]]
        text.append(m)
        text += [c + m + 1 for c in right[all_right : most_right + 1]]
        text.append(i)  # every member ends in its own symbol, so nothing is shared across ends
    sa = suffix_array(text)
    shared = common_prefixes(text, sa)
    best = list(shared)
    for a, b in zip(sa, sa[1:], strict=False):
        best[a] = max(best[a], shared[b])
    out = []
    for begin, (left, _) in zip(begins, members, strict=True):
        own = min(len(left), most_left) - all_left
        found = [x for x in range(all_left + 1) if best[begin + own] >= 1 + max(0, reach - x - all_right)]
        found += [all_left + d for d in range(1, own + 1) if best[begin + own - d] >= d + 1 + max(0, reach - all_left - d - all_right)]
        out.append(found)
    return out


class Hasher:
    """Polynomial hashes of a text's substrings; equal substrings have equal hashes wherever they stand."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            powers = []
            for base in (_BASE, _INVERSE):
                x = np.full(max(2 * n, 1 << 14), base, np.uint64)
                x[0] = 1
                powers.append(np.multiply.accumulate(x))
            self.power, self.inverse = powers

    def prefix(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).astype(np.uint64)
        raw += np.uint64(1)
        return self.sums(raw)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The prefix hashes of a sequence of numbers."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts, ends) -> np.ndarray:
        """The hashes of [starts, ends): slices or arrays of places."""
        h = prefix[ends] - prefix[starts]
        h *= self.inverse[starts]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of its least one, the first of equals."""
    windows = len(hashes) - width + 1
    out = np.empty(windows, np.int64)
    for at in range(0, windows, _CHUNK):
        n = min(_CHUNK, windows - at)
        m = (hashes[at : at + n + width - 1] & ~_LOW) | np.arange(n + width - 1, dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            m = np.minimum(m[:-step], m[step:])
            done += step
        out[at : at + n] = (m & _LOW).astype(np.int64) + at
    return out


def segments(data: bytes, hasher: Hasher, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, last window, anchor's place) of every segment of a text."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    prefix = hasher.prefix(data)
    n = len(data) - k + 1
    hashes = hasher.spans(prefix, slice(0, n), slice(k, n + k))
    at = anchors(hashes, length - k + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    place = at[first]
    own = hasher.spans(prefix, first, last + length) ^ ((place - first).astype(np.uint64) * _MIX)
    return hashes[place], own, first, last, place


def remaining(data: bytes, ranges: Sequence[tuple[int, int]], length: int = LENGTH) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, what is left), given ranges of starts of repeated windows, both ends inclusive."""
    n = len(data)
    edge = np.zeros(n + 1, np.int64)
    if ranges:
        at = np.array(ranges)
        np.add.at(edge, np.minimum(at[:, 0], n), 1)
        np.add.at(edge, np.minimum(at[:, 1] + length, n), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if n else 0
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def runs_of(starts: Sequence[int]) -> list[tuple[int, int]]:
    """Numbers as inclusive ranges."""
    out: list[list[int]] = []
    for x in sorted(starts):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _segments_of(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, segment, h1, h2, at) from rows (h1, h2, copies, body) of different texts: within a batch, equal segments meet at once.

    The first of equal segments goes on under its anchor, marked if there are more or if its text has copies; the others are known to be
    repeated (again). Neighbours among those make one range, whose first window is in at and whose last is in segment, so that
    copies and runs of one byte are a few rows whatever their length. For the rest, at packs the anchor's place, again, the
    mark, and the distances from the first and the last window to the anchor, so that little is shuffled.
    """
    hasher = Hasher()
    for batch in batches:
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        for i, data in enumerate(batch.column("body")):
            parts = segments(data.as_py(), hasher, length, k)
            for column, x in zip(found, (*parts, np.full(len(parts[0]), i)), strict=True):
                column.append(x)
        anchor, own, first, last, place, text = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        if not len(anchor):
            continue
        order = np.lexsort((own, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
        counts = np.diff(np.append(np.flatnonzero(new), len(order)))
        h1, h2, copies = (batch.column(c).to_numpy() for c in ("h1", "h2", "copies"))
        leads = order[new]
        more = (counts > 1) | (copies[text[leads]] > 1)
        again = np.ones(len(order), bool)
        again[leads] = False
        begins = np.flatnonzero(again & ~np.concatenate(([False], again[:-1] & (text[1:] == text[:-1]))))
        ends = np.flatnonzero(again & ~np.concatenate((again[1:] & (text[1:] == text[:-1]), [False])))
        spread = (h1[text[begins]].view(np.uint64) + first[begins].astype(np.uint64)) * _MIX
        at = place[leads] << 18 | more << 16 | (place - first)[leads] << 8 | (place - last)[leads]
        source = np.concatenate((text[leads], text[begins]))
        yield _batch(
            key=np.concatenate((anchor[leads], spread)).view(np.int64), segment=np.concatenate((own[leads].view(np.int64), last[ends])),
            h1=h1[source], h2=h2[source], at=np.concatenate((at, first[begins] << 18 | 1 << 17)),
        )


def _sorted_families(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Ranges (h1, h2, first, last) of repeated windows from rows (key, h1, h2, place, single, left, right) that come sorted by key."""
    pending: list[tuple] = []

    def ranges(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        starts = family_windows([(g[5], g[6]) for g in group], reach)
        return [(h1, h2, place - b, place - a) for (_, h1, h2, place, single, _, _), xs in zip(group, starts, strict=True) if single for a, b in runs_of(xs)]

    def out(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return _batch(**{c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("h1", "h2", "first", "last"))})

    for batch in batches:
        found = []
        for g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pending and pending[0][0] != g[0]:
                found += ranges(pending)
                pending = []
            pending.append(g)
        yield out(found)
    if pending:
        yield out(ranges(pending))


def _split(parts: DataFrame, step: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """(ranges of repeated windows, the members of smaller families), from the members of large ones.

    A member's windows are cut by the number of bytes they have left of the anchor, at multiples of 2 ** ``step``: into two cells, as
    those before were twice as wide. All windows of a cell cover some bytes on either side; members that differ there go to different families.
    Members equal in a cell are repeated there as wholes; one of them goes on. A cell of one window has nothing else.
    """
    cut = parts.select("*", F.explode(F.sequence(F.shiftright("low", step), F.shiftright("high", step))).alias("cell"))
    least, most = F.shiftleft("cell", step), F.shiftleft(F.col("cell") + 1, step) - 1
    tail = lambda n: F.substring(F.col("left"), F.octet_length("left") - n + 1, n)
    head = lambda n: F.substring(F.col("right"), F.lit(1), n)
    cut = cut.withColumn("key", F.xxhash64("key", F.lit(step), "cell", tail(least), head(F.greatest(reach - most, F.lit(0)))))
    cut = cut.withColumns({"low": F.greatest("low", least), "high": F.least("high", most)}).withColumns({"left": tail(F.col("high")), "right": head(reach - F.col("low"))})
    names = ["key", "low", "high", "same1", "same2"]
    cut = cut.withColumns({f"same{seed}": F.xxhash64(F.lit(seed), "left", "right") for seed in (1, 2)})
    groups = cut.groupBy(names).agg(F.count("*").alias("copies"), F.first(F.struct("h1", "h2", "place", "single", "left", "right")).alias("one"))
    counted = stored(groups.join(groups.groupBy("key").agg(F.count("*").alias("members")), "key").where("copies > 1 or members > 1"), "split")
    equal = cut.where("single").join(counted.where("copies > 1").select(names), names, "left_semi").select("h1", "h2", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low")).alias("last"))
    rest = counted.where("members > 1").select("key", "members", "low", "high", "copies", "one.*")
    return equal, rest.withColumn("single", F.col("single") & (F.col("copies") == 1)).drop("copies")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR, family: int = FAMILY) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each row of ``docs``; kept is the remaining text's bytes.

    Texts are whole and UTF-8; null ones are empty. A byte goes if a string of ``length`` bytes that covers it starts at
    another place too, in any text; all are judged on the input. Rows that are repeated entirely lose all their bytes (if they
    have ``length``) and stay as rows. Ids may be null or repeated. Texts shorter than ``length`` stay whole. Other columns are not read.

    Equal texts (by two 64-bit hashes) meet first and are searched once; their rows look the result up at the end.
    """
    reach = length - k
    if not 0 < reach < 256:
        raise ValueError("the anchor must be shorter than the length, by less than 256")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", F.xxhash64(F.lit(1), "body").alias("h1"), F.xxhash64(F.lit(2), "body").alias("h2"))
    text = ["h1", "h2"]
    # Copies are merged on the map side: a hot text is at most one row from each task.
    texts = stored(rows.where(F.octet_length("body") >= length).groupBy(text).agg(F.first("body").alias("body"), F.count("*").alias("copies")), "texts")

    # Which segments repeat, and which share only their anchor with others: one shuffle by anchor of a few numbers each.
    cut = texts.mapInArrow(lambda batches: _segments_of(batches, length, k), "key long, segment long, h1 long, h2 long, at long")
    same, around = Window.partitionBy("key", "again", "segment"), Window.partitionBy("key", "again")
    packed = lambda shift, mask: F.shiftright("at", shift).bitwiseAND(F.lit(mask))
    place = F.shiftright("at", 18)
    dealt = cut.repartition("key").withColumns({"again": packed(17, 1) == 1, "times": packed(16, 1) + 1})
    ranked = dealt.withColumns({"rank": F.row_number().over(same.orderBy("h1", "h2", "at")), "copies": F.sum("times").over(same)})
    counted = ranked.withColumn("members", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(around)).where("again or copies > 1 or members > 1")
    first, last = (F.when(F.col("again"), of_range).otherwise(place - distance) for of_range, distance in ((place, packed(8, 255)), (F.col("segment"), packed(0, 255))))
    counted = counted.select("key", "h1", "h2", place.alias("place"), first.alias("first"), last.alias("last"), (F.col("again") | (F.col("copies") > 1)).alias("whole"), "members", (~F.col("again") & (F.col("members") > 1) & (F.col("rank") == 1)).alias("mixed"))
    # A list holds at most the segments of one text.
    lists = counted.groupBy(text).agg(
        F.collect_list(F.when(F.col("whole"), F.struct("first", "last"))).alias("whole"),
        F.collect_list(F.when(F.col("mixed"), F.struct("key", (~F.col("whole")).alias("single"), "members", "first", "last", "place"))).alias("mixed"),
    )
    lists = stored(lists, "segments")

    # Segments that share an anchor: their bytes on either side of it.
    parts = texts.join(lists.where(F.size("mixed") > 0).select(*text, "mixed"), text).select(*text, "body", F.explode("mixed").alias("part")).select(*text, "body", "part.*")
    at = lambda a, b: F.substring(F.col("body"), (a + 1).cast("int"), (b - a).cast("int"))
    before = lambda c: (F.col("place") - F.col(c)).cast("int")
    parts = stored(parts.select("key", *text, "place", "single", "members", before("last").alias("low"), before("first").alias("high"), at(F.col("first"), F.col("place")).alias("left"), at(F.col("place") + k, F.col("last") + length).alias("right")), "parts")

    # Larger families are split until they are small; equal parts are counted on the way.
    members = ["key", *text, "place", "single", "left", "right"]
    small, equal = [parts.where(F.col("members") <= family).select(members)], []
    large, step = parts.where(F.col("members") > family), reach.bit_length()
    while step and not large.isEmpty():
        step -= 1
        found, parts = _split(large, step, reach)
        equal.append(found)
        small.append(parts.where(F.col("members") <= family).select(members))
        large = parts.where(F.col("members") > family)
    dealt = reduce(DataFrame.union, small).repartition("key").sortWithinPartitions("key")
    by_order = dealt.mapInArrow(lambda batches: _sorted_families(batches, reach), "h1 long, h2 long, first long, last long")
    ranges = reduce(DataFrame.union, equal, by_order).groupBy(text).agg(F.collect_list(F.struct("first", "last")).alias("partial"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [remaining(data.as_py(), [(r["first"], r["last"]) for part in parts for r in part.as_py() or ()], length) for data, *parts in zip(batch.column("body"), batch.column("whole"), batch.column("partial"), strict=True)]
            yield _batch(h1=batch.column("h1"), h2=batch.column("h2"), n_removed=pa.array([d[0] for d in done], pa.int64()), n_spans=pa.array([d[1] for d in done], pa.int64()), kept_sha256=pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string()), kept=pa.array([d[2] for d in done], pa.binary()))

    touched = lists.select(*text, "whole").join(ranges, text, "left").where("size(whole) > 0 or size(partial) > 0")
    stripped = texts.select(*text, "body").join(touched, text).mapInArrow(strip, "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    # Texts with a thousandth of all rows or more are at most a thousand: their rows, all of whose bytes go, need no shuffle.
    limit = max(1000, (texts.agg(F.sum("copies")).first()[0] or 0) // 1000)
    hot = F.broadcast(texts.where(F.col("copies") > limit).select(text))
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    size, zero = F.octet_length("body").cast("long"), F.lit(0).cast("long")
    gone = rows.join(hot, text, "left_semi").select("id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    own = rows.join(hot, text, "left_anti").select("id", *text, size.alias("n_bytes"), F.sha2("body", 256).alias("own"), "body")
    rest = own.join(stripped, text, "left").select("id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"), F.coalesce("kept", "body").alias("kept"))
    return gone.select(columns).union(rest.select(columns)).withColumnRenamed("id", id_col)
