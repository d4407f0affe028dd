"""Repeated word windows through a compacted de Bruijn graph.

Every ``width`` consecutive words are an edge between the ``width`` - 1 words that begin and those that end it. An edge met at two or more
places is repeated, and its words go at every place. The graph holds repeated edges only, and never reaches one task:

1. Anchors. Of the ``anchor``-word strings in a window, that with the least hash is the window's anchor; neighbours that share it are
   one piece. Windows can only be equal if their anchors are, so only pieces with a repeated anchor become edges.
2. Equal pieces are bundled, then their edges are counted by hash. Each remembers its least source coordinate (text, word), how many coordinates it has and a signature of them,
   a sum that turns into the next edge's by one multiplication if each coordinate moves on by one word.
3. Compaction. Where all occurrences of an edge go on with one and the same edge, and all of that come from it, nothing branches
   between them: least coordinates are neighbours, counts are equal, and the signature turns into the next. Neighbours meet in one
   shuffle by least coordinate and make up nonbranching paths.
4. Coordinates. The occurrences of a path's first edge are the sources of the whole path: joins by that edge and by piece give repeated spans.
5. Verification. At each source the span's words are hashed anew, to 128 bits. Paths whose sources differ (hash collisions) are taken
   apart into windows that are counted by such hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.llm.common import discard, settled, stored
from rastra.llm.suffixes import Hasher, anchors

WIDTH, ANCHOR = 35, 12
#: Texts that are looked at together, in bytes; a longer text is looked at alone.
_TOGETHER = 1 << 18
#: What a signature is multiplied by for each word; small enough for products of 32 bits with it.
_TURN, _HALF = 0x1E3779B1, (1 << 32) - 1
_OTHER, _LOW = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


class Words:
    """The words of some texts, as hashes: ``text`` and ``place`` say where each is."""

    def __init__(self, bodies: list[bytes], hasher: Hasher):
        data = b" ".join(bodies)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_GAP[np.frombuffer(data, np.uint8)]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.cumsum([0, *(len(b) + 1 for b in bodies)])
        self.text = np.searchsorted(begins, starts, "right") - 1
        self.first = np.searchsorted(starts, begins[:-1])
        self.place = np.arange(len(starts)) - self.first[self.text]
        self.hasher, self.hashes = hasher, np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # byte hashes need tables as long as what is hashed at once
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + _TOGETHER)))
            prefix = hasher.prefix(data[starts[at] : ends[end - 1]])
            self.hashes[at:end] = hasher.spans(prefix, starts[at:end] - starts[at], ends[at:end] - starts[at])
            at = end
        self.sums = hasher.sums(self.hashes)

    def windows(self, width: int) -> np.ndarray:
        """The hash of the ``width`` words from each place on, across texts too."""
        n = max(0, len(self.hashes) - width + 1)
        return self.hasher.spans(self.sums, slice(0, n), slice(width, width + n)) if n else np.zeros(0, np.uint64)


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row numbers, texts) of a batch, some texts at a time."""
    rows, bodies, size = [], [], 0
    for i, body in enumerate(batch.column(column)):
        body = body.as_py()
        if rows and size + len(body) > _TOGETHER:
            yield np.array(rows), bodies
            rows, bodies, size = [], [], 0
        rows.append(i)
        bodies.append(body)
        size += len(body)
    if rows:
        yield np.array(rows), bodies


def _pieces(batches: Iterator[pa.RecordBatch], width: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, h1, h2, at, copies) from rows (h1, h2, body): the windows of a text that share an anchor.

    ``at`` packs the first window and how many follow. Equal texts in a batch are one.
    """
    hasher = Hasher()
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        _, some, copies = np.unique(keys, axis=0, return_index=True, return_counts=True)
        batch = batch.take(pa.array(some))
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        for rows, bodies in _groups(batch, "body"):
            words = Words(bodies, hasher)
            if len(words.hashes) < width:
                continue
            low = words.windows(anchor)
            at = anchors(low, width - anchor + 1)
            valid = np.flatnonzero(words.text[: len(at)] == words.text[width - 1 :])
            if not len(valid):
                continue
            new = np.ones(len(valid), bool)
            new[1:] = (np.diff(valid) > 1) | (at[valid[1:]] != at[valid[:-1]])
            begin = np.flatnonzero(new)
            first, last = valid[begin], valid[np.append(begin[1:], len(valid)) - 1]
            row = rows[words.text[first]]
            columns = [low[at[first]].view(np.int64), h1[row], h2[row], words.place[first] << 8 | (last - first), copies[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "h1", "h2", "at", "copies"])


def _bundles(batches: Iterator[pa.RecordBatch], width: int, mask: int) -> Iterator[pa.RecordBatch]:
    """Rows (p1, p2, sign, h1, h2, place, copies, edges) from rows (h1, h2, copies, body, ats): the pieces in ats, by 128 bits of their words, with their windows' hashes.

    ``place`` and ``sign`` are of the first window; each of the next has the place one on and the sign turned once more.
    """
    hasher, turns = Hasher(), np.ones(1, np.uint64)
    for batch in batches:
        h1, h2, copies = (batch.column(c).to_numpy() for c in ("h1", "h2", "copies"))
        lists = batch.column("ats")
        for rows, bodies in _groups(batch, "body"):
            words = Words(bodies, hasher)
            hashes = words.windows(width) & np.uint64(mask)
            second = hasher.sums((words.hashes ^ (words.hashes >> np.uint64(29))) * _OTHER)
            sizes = [len(lists[int(i)]) for i in rows]
            at = np.concatenate([lists[int(i)].values.to_numpy() for i in rows])
            row, place, times = np.repeat(rows, sizes), at >> 8, (at & 255) + 1
            first = np.repeat(words.first, sizes) + place
            ends = np.cumsum(times)
            edges = hashes[np.repeat(first - ends + times, times) + np.arange(int(ends[-1]))]
            if len(turns) <= int(place.max()):
                turns = _turns(2 * int(place.max()) + 2)
            sign = (h1[row].view(np.uint64) | np.uint64(1)) * turns[place]
            p1, p2 = (hasher.spans(sums, first, first + times + width - 1) for sums in (words.sums, second))
            columns = [pa.array(c, pa.int64()) for c in (p1.view(np.int64), p2.view(np.int64), sign.view(np.int64), h1[row], h2[row], place, copies[row])]
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(edges.view(np.int64), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["p1", "p2", "sign", "h1", "h2", "place", "copies", "edges"])


def _turns(n: int) -> np.ndarray:
    """What a signature is multiplied by for 0 to n - 1 words."""
    out = np.full(n, _TURN, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _single_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (edge, n, places, source, low, high) from rows (n, places, source, low, high, edges): a piece's edges, with the signature turned to each."""
    turns = _turns(256)
    for batch in batches:
        edges = batch.column("edges")
        sizes = np.diff(edges.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        low, high = (batch.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        sign = ((high << np.uint64(32)) + low)[row] * turns[at]
        index = pa.array(row)
        source = batch.column("source").to_numpy()[row] + at
        columns = [edges.flatten(), *(batch.column(c).take(index) for c in ("n", "places")), pa.array(source), pa.array((sign & _LOW).view(np.int64)), pa.array((sign >> np.uint64(32)).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["edge", "n", "places", "source", "low", "high"])


def _turned(sign: Column) -> Column:
    """A signature times _TURN modulo 2 ** 64, from its halves, none of which overflows."""
    low, high = sign.bitwiseAND(F.lit(_HALF)) * F.lit(_TURN), F.shiftrightunsigned(sign, 32) * F.lit(_TURN)
    return _joined(low, high)


def _joined(low: Column, high: Column) -> Column:
    """high * 2 ** 32 + low modulo 2 ** 64, for numbers of 0 to 2 ** 62."""
    top = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(_HALF))
    return F.shiftleft(top, 32).bitwiseOR(low.bitwiseAND(F.lit(_HALF)))


def paths(edges: DataFrame) -> DataFrame:
    """(path, n) of the nonbranching paths: the first edge and the number of edges. From rows (edge, source, places, sign), one an edge.

    ``source`` is the least coordinate, a number that grows by one from word to word of a text. Edges that follow each other have neighbouring
    ones, so one shuffle by those brings them together. Paths are cut every 65,536 numbers, so that no group grows with a text; where two texts'
    numbers overlap, paths may be cut too, but the signature keeps them from being mixed.
    """
    order = Window.partitionBy("block").orderBy("source")
    rows = edges.select("edge", F.shiftright("source", 16).alias("block"), "source", "places", "sign")
    before = F.lag(F.struct("source", "places", "sign")).over(order)
    joined = (F.col("before.source") + 1 == F.col("source")) & (F.col("before.places") == F.col("places")) & (_turned(F.col("before.sign")) == F.col("sign"))
    headed = rows.withColumn("before", before).withColumn("head", F.when(~F.coalesce(joined, F.lit(False)), F.col("edge")))
    named = headed.select("block", F.last("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("path"))
    return named.groupBy("block", "path").agg(F.count("*").alias("n")).select("path", "n")


def _digest(words: list[bytes]) -> tuple[int, int]:
    whole = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _strip(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, n_removed, kept, marks) from rows (h1, h2, body, spans); marks has the digest of each span's words."""
    mark = pa.struct([(c, pa.int64()) for c in ("path", "d1", "d2")])
    for batch in batches:
        for rows, bodies in _groups(batch, "body"):
            some, removed, kept, marks = batch.slice(rows[0], len(rows)), [], [], []
            for body, spans in zip(bodies, some.column("spans"), strict=True):
                words, found = body.split(), spans.as_py()
                edge = np.zeros(len(words) + 1, np.int64)
                own = []
                for s in found:
                    end = s["place"] + s["n"] + width - 1
                    edge[s["place"]] += 1
                    edge[end] -= 1
                    d1, d2 = _digest(words[s["place"] : end])
                    own.append({"path": s["path"], "d1": d1, "d2": d2})
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]))
                marks.append(own)
            yield pa.RecordBatch.from_arrays([some.column("h1"), some.column("h2"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(marks, pa.list_(mark))], names=["h1", "h2", "n_removed", "kept", "marks"])


def _single_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, place, copies, d1, d2): the digest of each window of the spans."""
    for batch in batches:
        for h1, h2, copies, body, spans in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "copies", "body", "spans")), strict=True):
            words = body.split()
            places = sorted({p for s in spans for p in range(s["place"], s["place"] + s["n"])})
            digests = [_digest(words[p : p + width]) for p in places]
            columns = [[h1] * len(places), [h2] * len(places), places, [copies] * len(places), [d[0] for d in digests], [d[1] for d in digests]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "place", "copies", "d1", "d2"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h1, h2, n_words, whole) from rows (id, h1, h2, body); words take ten times their text's memory, so only one text is split at a time."""
    for batch in batches:
        for rows, bodies in _groups(batch, "body"):
            some, sizes, wholes = batch.slice(rows[0], len(rows)), [], []
            for body in bodies:
                split = body.split()
                sizes.append(len(split))
                wholes.append(b" ".join(split))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "h1", "h2")), pa.array(sizes, pa.int64()), pa.array(wholes, pa.binary())], names=["id", "h1", "h2", "n_words", "whole"])


def repeated(texts: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hash_bits: int = 64) -> DataFrame:
    """(h1, h2, n_removed, kept) of each different text that repeats something, from rows (h1, h2, body): a text's key and its words in UTF-8.

    ``hash_bits`` shortens the edges' hashes; results don't depend on it (tests use that).
    """
    if not 0 < width - anchor < 255:
        raise ValueError("the anchor must be shorter than the window, by less than 255 words")
    key = ["h1", "h2"]
    pieces = texts.mapInArrow(lambda batches: _pieces(batches, width, anchor), "anchor long, h1 long, h2 long, at long, copies long")
    again = stored(pieces.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "anchors")
    lists = pieces.join(again, "anchor").select(*key, "at").distinct().groupBy(key).agg(F.collect_list("at").alias("ats"))  # at most a text's windows
    touched = stored(texts.groupBy(key).agg(F.first("body").alias("body"), F.count("*").alias("copies")).join(lists, key), "touched")
    discard(again)
    settled(touched)

    mask = (1 << hash_bits) - 1
    piece, numbers = ["p1", "p2"], ", ".join(f"{c} long" for c in ("p1", "p2", "sign", "h1", "h2", "place", "copies"))
    occurrences = stored(touched.mapInArrow(lambda batches: _bundles(batches, width, mask), f"{numbers}, edges array<long>"), "occurrences")
    source = F.shiftright(F.xxhash64("h1", "h2"), 1) + F.col("place")
    low, high = F.col("sign").bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned("sign", 32)
    summed = lambda n: [F.sum(n).alias("n"), F.sum("places").alias("places"), F.min("source").alias("source"), F.sum("low").alias("low"), F.sum("high").alias("high")]
    # Equal pieces are one before they become edges.
    rows = occurrences.select(*piece, "copies", F.lit(1).cast("long").alias("places"), source.alias("source"), low.alias("low"), high.alias("high"), "edges")
    bundles = settled(stored(rows.groupBy(piece).agg(*summed("copies"), F.first("edges").alias("edges")), "bundles"))
    single = bundles.select("n", "places", "source", "low", "high", "edges").mapInArrow(_single_edges, "edge long, n long, places long, source long, low long, high long")
    edges = single.groupBy("edge").agg(*summed("n")).where("n > 1").select("edge", "source", "places", _joined(F.col("low"), F.col("high")).alias("sign"))
    compact = settled(stored(paths(edges), "paths"))
    spots = stored(bundles.select(*piece, F.posexplode("edges").alias("at", "path")).join(compact, "path"), "spots")
    spans = occurrences.select(*piece, *key, "place").join(spots, piece).select("path", *key, (F.col("place") + F.col("at")).alias("place"), "n")
    spans = settled(stored(spans, "spans"))
    discard(occurrences, bundles, compact, spots)

    def stripped(of: DataFrame) -> DataFrame:
        grouped = of.groupBy(key).agg(F.collect_list(F.struct("place", "n", "path")).alias("spans"))
        return stored(touched.select(*key, "body").join(grouped, key).mapInArrow(lambda batches: _strip(batches, width), "h1 long, h2 long, n_removed long, kept binary, marks array<struct<path:long,d1:long,d2:long>>"), "stripped")

    done = stripped(spans)
    marks = done.select(F.explode("marks").alias("mark")).groupBy("mark.path").agg(*(f(f"mark.{d}").alias(f"{name}{d}") for d in ("d1", "d2") for name, f in (("min", F.min), ("max", F.max))))
    wrong = stored(marks.where("mind1 <> maxd1 or mind2 <> maxd2").select("path"), "wrong")
    if not wrong.isEmpty():
        doubtful = spans.join(wrong, "path", "left_semi").groupBy(key).agg(F.collect_list(F.struct("place", "n")).alias("spans"))
        windows = touched.select(*key, "copies", "body").join(doubtful, key).mapInArrow(lambda batches: _single_windows(batches, width), "h1 long, h2 long, place long, copies long, d1 long, d2 long")
        windows = stored(windows, "windows")
        certain = stored(windows.groupBy("d1", "d2").agg(F.sum("copies").alias("n")).where("n > 1").select("d1", "d2"), "certain")
        exact = windows.join(certain, ["d1", "d2"]).select(F.lit(0).cast("long").alias("path"), *key, "place", F.lit(1).cast("long").alias("n"))
        done = stripped(spans.join(wrong, "path", "left_anti").select("path", *key, "place", "n").union(exact))
    return done.select(*key, "n_removed", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, finish: Callable[[Column], Column] | None = None, hash_bits: int = 64) -> DataFrame:
    """(id_col, n_words, n_removed, kept), one row for each row of ``docs``; kept joins the remaining words by one space.

    Words are what spaces and the characters 9 to 13 part. A word goes if a window of ``width`` words that covers it starts at another
    place too, in any text; all are judged on the input. Rows that are repeated entirely lose all their words (if they have ``width``) and
    stay as rows. Null texts have no words. Ids may be null or repeated. Other columns are not read.

    ``finish`` is applied to the kept text before the last join: a digest, say, where the text itself is not wanted, is all that is shuffled then.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", *(F.xxhash64(F.lit(n), "body").alias(f"h{n}") for n in (1, 2)))
    kind, finish = docs.schema[id_col].dataType.simpleString(), finish or (lambda c: c)
    changed = repeated(rows.select("h1", "h2", "body"), width, anchor, hash_bits).select("h1", "h2", "n_removed", finish(F.col("kept").cast("string")).alias("kept"))
    whole = rows.mapInArrow(_words, f"id {kind}, h1 long, h2 long, n_words long, whole binary").select("id", "h1", "h2", "n_words", finish(F.col("whole").cast("string")).alias("whole"))
    joined = whole.join(changed, ["h1", "h2"], "left")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "whole").alias("kept"))
