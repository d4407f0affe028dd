"""The reversible transforms of lossless coding as column arithmetic on pixel tables; neighbours come from windows over rows and columns."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rastra.functions import argb
from rastra.operators.pixels import fixed_log2

BLACK = 0xFF000000


def with_neighbours(pixels: DataFrame) -> DataFrame:
    """Pixels with left, top, top_left and top_right (null beyond the edge), by two windows: along rows and along columns."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    above = pixels.withColumn("top", F.lag("argb").over(column))
    return above.withColumns({"left": F.lag("argb").over(row), "top_left": F.lag("top").over(row), "top_right": F.lead("top").over(row)})


def _half(a: Column, b: Column) -> Column:
    """The mean of two pixels, each channel rounded down."""
    return argb.pack(*[F.shiftright(argb.channel(a, c) + argb.channel(b, c), 1) for c in "argb"])


def _clip(n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), n))


def prediction(mode: int, left: Column, top: Column, top_left: Column, top_right: Column) -> Column:
    """What a mode predicts inside an image: black, a neighbour, means of neighbours, the nearer of two, or a gradient."""
    channels = lambda f: argb.pack(*[_clip(f(c)) for c in "argb"])
    at = argb.channel
    toward = lambda c: at(_half(left, top), c) - at(top_left, c)
    if mode == 11:
        lean = sum((F.abs(at(left, c) - at(top_left, c)) - F.abs(at(top, c) - at(top_left, c)) for c in "argb"), F.lit(0))
        return F.when(lean <= 0, top).otherwise(left)
    if mode == 12:
        return channels(lambda c: at(left, c) + at(top, c) - at(top_left, c))
    if mode == 13:  # a half that is cut towards zero
        return channels(lambda c: at(_half(left, top), c) + F.call_function("div", toward(c), F.lit(2)))
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: _half(_half(left, top_right), top), 6: lambda: _half(left, top_left), 7: lambda: _half(left, top), 8: lambda: _half(top_left, top), 9: lambda: _half(top, top_right),
        10: lambda: _half(_half(left, top_left), _half(top, top_right)),
    }.get(mode, lambda: F.lit(BLACK))()


def residuals(pixels: DataFrame, mode: int) -> DataFrame:
    """(img, x, y, argb): each pixel less its prediction, modulo 256. The first pixel is predicted black, the first row by the left, the first column by the top; the last column's top right is its row's first pixel."""
    near = with_neighbours(pixels)
    first = F.first("argb").over(Window.partitionBy("img", "y").orderBy("x"))
    guess = prediction(mode, F.col("left"), F.col("top"), F.col("top_left"), F.coalesce("top_right", first))
    guess = F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(BLACK)).when(F.col("y") == 0, F.col("left")).when(F.col("x") == 0, F.col("top")).otherwise(guess)
    return near.select("img", "x", "y", argb.pack(*[F.pmod(argb.channel(F.col("argb"), c) - argb.channel(guess, c), F.lit(256)) for c in "argb"]).alias("argb"))


def cross_coloured(pixels: DataFrame, tiles: DataFrame, bits: int, inverse: bool = False) -> DataFrame:
    """Pixels after the cross-colour transform with each tile's multipliers (img, tx, ty, green_to_red, green_to_blue, red_to_blue)."""
    at = pixels.withColumns({"tx": F.shiftright("x", bits), "ty": F.shiftright("y", bits)}).join(tiles, ["img", "tx", "ty"])
    return at.select("img", "x", "y", argb.cross_color(F.col("argb"), F.col("green_to_red"), F.col("green_to_blue"), F.col("red_to_blue"), inverse).alias("argb"))


#: Fixed value: how often the two multipliers of blue are chosen at most, each given the other.
CROSS_COLOUR_ROUNDS = 3


#: The multipliers in the order in which equally good ones are taken: the nearest to zero, then the lower.
MULTIPLIERS = np.array(sorted(range(-128, 128), key=lambda m: (abs(m), m)), np.int16)

#: The share of each channel value that each multiplier takes, modulo 256.
MULTIPLIER_SHARES = (np.arange(256, dtype=np.uint8).view(np.int8)[:, None] * MULTIPLIERS >> 5).astype(np.int8)

# How many colours of a tile are added up at once, how many such blocks, and the side, as a power of two, of what is gathered in front of a shuffle.
COLOUR_BLOCK, BLOCKS_AT_ONCE, GATHERED_BITS = 16, 128, 4


def _nearest_multipliers(rest: np.ndarray, by: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """For each tile the first of MULTIPLIERS that leaves least of ``rest`` once its share of channel ``by`` is taken off.

    The tables have a row for each block of colours, and ``tile`` is the block's tile, ascending. Signed bytes overflow as they should: what is left counts
    modulo 256, and 128 is read as such. Costs are summed over a few blocks at a time, whatever a tile's size.
    """
    cost = np.zeros((int(tile.max(initial=-1)) + 1, len(MULTIPLIERS)), np.int64)
    for at in range(0, len(tile), BLOCKS_AT_ONCE):
        part = slice(at, at + BLOCKS_AT_ONCE)
        left = np.abs(rest[part, :, None].view(np.int8) - MULTIPLIER_SHARES[by[part]]).view(np.uint8).sum(axis=1, dtype=np.int32)
        own = tile[part]
        cost[own[0] : own[-1] + 1] += np.add.reduceat(left, np.flatnonzero(np.diff(own, prepend=-1)), axis=0)
    return MULTIPLIERS[cost.argmin(axis=1)]


def cross_colour_multipliers(pixels: DataFrame, bits: int) -> DataFrame:
    """(img, tx, ty, green_to_red, green_to_blue, red_to_blue): the multipliers, -128 to 127, that leave the smallest residuals in each tile of 2**bits.

    Residuals count by their distance from zero as signed bytes. Red has one multiplier. Blue has two, chosen in turn, each for what the other leaves, in
    CROSS_COLOUR_ROUNDS rounds; tiles where nothing changes any more are left out of the next. The colours of a tile are one array, gathered before
    and after a shuffle by tile (larger tiles in parts first); a small Arrow helper tries the 256 candidates on the tiles of a batch.
    """
    tile = ["img", "tx", "ty"]
    at = pixels.select("img", *[F.shiftright(c, k).alias(name) for c in "xy" for k, name in ((bits, f"t{c}"), (GATHERED_BITS, f"g{c}"))], F.col("argb").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("rgb"))
    at = at.where(" AND ".join(f"{c} IS NOT NULL" for c in tile))
    colours = at.groupBy(*tile, *(["gx", "gy"] if bits > GATHERED_BITS else [])).agg(F.collect_list("rgb").alias("colours"))
    if bits > GATHERED_BITS:
        colours = colours.groupBy(*tile).agg(F.flatten(F.collect_list("colours")).alias("colours"))

    @arrow_udf("green_to_red int, green_to_blue int, red_to_blue int")
    def best(colours: pa.Array) -> pa.Array:
        size = np.diff(colours.offsets)
        blocks = np.maximum(-(-size // COLOUR_BLOCK), 1)
        tile = np.repeat(np.arange(len(size)), blocks)
        # What a tile's last block has left is black, which no multiplier changes.
        before = (np.arange(len(tile)) - (np.cumsum(blocks) - blocks)[tile]) * COLOUR_BLOCK
        table = np.zeros((len(tile), COLOUR_BLOCK), np.int32)
        table[np.arange(COLOUR_BLOCK) < (size[tile] - before)[:, None]] = colours.flatten()
        r, g, b = ((table >> s).astype(np.uint8) for s in (16, 8, 0))

        def blue(moved: np.ndarray, given: np.ndarray, other: np.ndarray, by: np.ndarray) -> np.ndarray:
            """The multipliers of channel ``by`` in the tiles that moved, given those of the other channel."""
            part = moved[tile]
            share = (given[tile[part], None] * other[part].view(np.int8) >> 5).astype(np.uint8)
            return _nearest_multipliers(b[part] - share, by[part], np.cumsum(moved)[tile[part]] - 1)

        green_to_red = _nearest_multipliers(r, g, tile)
        moved = np.ones(len(size), bool)
        green_to_blue, red_to_blue = np.full(len(size), len(MULTIPLIERS), np.int16), np.zeros(len(size), np.int16)  # the first is no multiplier yet
        for _ in range(CROSS_COLOUR_ROUNDS):
            found = blue(moved, red_to_blue, r, g)
            changed = found != green_to_blue[moved]
            green_to_blue[moved] = found
            moved[moved] = changed
            red_to_blue[moved] = blue(moved, green_to_blue, g, r)
        return pa.StructArray.from_arrays([pa.array(m, pa.int32()) for m in (green_to_red, green_to_blue, red_to_blue)], ["green_to_red", "green_to_blue", "red_to_blue"])

    return colours.select(*tile, best("colours").alias("m")).select(*tile, "m.*")


def predictor_modes(pixels: DataFrame, bits: int) -> DataFrame:
    """(img, tx, ty, mode): the mode whose residuals have least entropy in each tile of 2**bits, summed over channels in whole bits; the lowest of equal ones.

    Pixels of the first row and column have fixed predictions and count for no mode; a tile that has no others has mode 0. Each pixel
    gives a row for each mode and channel, which are counted before they move.
    """
    tile = ["img", "tx", "ty"]
    near = with_neighbours(pixels)
    first = F.first("argb").over(Window.partitionBy("img", "y").orderBy("x"))
    near = near.withColumn("top_right", F.coalesce("top_right", first))
    near = near.select("img", F.shiftright("x", bits).alias("tx"), F.shiftright("y", bits).alias("ty"), (F.least("x", "y") > 0).alias("inner"), "argb", "left", "top", "top_left", "top_right")
    guesses = [prediction(m, *(F.col(c) for c in ("left", "top", "top_left", "top_right"))) for m in range(14)]
    guessed = near.where("inner").select(*tile, "argb", F.posexplode(F.array(*[g.cast("long") for g in guesses])).alias("mode", "guess"))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.pmod(argb.channel(F.col("argb"), c) - argb.channel(F.col("guess"), c), F.lit(256)).alias("value")) for c in "argb"]))
    counts = guessed.select(*tile, "mode", parts.alias("p")).groupBy(*tile, "mode", "p.channel", "p.value").agg(F.count("*").alias("n"))
    per = counts.groupBy(*tile, "mode", "channel").agg(F.sum("n").alias("total"), F.sum(F.col("n") * fixed_log2(F.col("n"))).alias("part"))
    cost = F.shiftright(F.col("total") * fixed_log2(F.col("total")) - F.col("part"), 16)
    best = per.groupBy(*tile, "mode").agg(F.sum(cost).alias("cost")).groupBy(*tile).agg(F.min(F.struct("cost", "mode"))["mode"].alias("mode"))
    return near.select(*tile).distinct().join(best, tile, "left").select(*tile, F.coalesce("mode", F.lit(0)).alias("mode"))


def predicted(pixels: DataFrame, tiles: DataFrame, bits: int) -> DataFrame:
    """(img, x, y, argb): each pixel less what its tile's mode (img, tx, ty, mode) predicts; rims as in ``residuals``."""
    near = with_neighbours(pixels)
    first = F.first("argb").over(Window.partitionBy("img", "y").orderBy("x"))
    near = near.withColumns({"top_right": F.coalesce("top_right", first), "tx": F.shiftright("x", bits), "ty": F.shiftright("y", bits)}).join(tiles, ["img", "tx", "ty"])
    guess = F.lit(BLACK)
    for m in range(1, 14):
        guess = F.when(F.col("mode") == m, prediction(m, *(F.col(c) for c in ("left", "top", "top_left", "top_right")))).otherwise(guess)
    guess = F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(BLACK)).when(F.col("y") == 0, F.col("left")).when(F.col("x") == 0, F.col("top")).otherwise(guess)
    return near.withColumn("guess", guess).select("img", "x", "y", argb.pack(*[F.pmod(argb.channel(F.col("argb"), c) - argb.channel(F.col("guess"), c), F.lit(256)) for c in "argb"]).alias("argb"))


#: Fixed value: a side of an image from which near-lossless passes are made.
MIN_NEAR_LOSSLESS = 64


def near_lossless_bits(level: int) -> int:
    """How many low bits a level of 0 to 100 may change."""
    return 0 if level >= 100 else 5 - level // 20


def near_lossless(pixels: DataFrame, bits: int) -> DataFrame:
    """One pass: inner pixels that differ from a neighbour by 2**bits or more in a channel go to the grid; others stay."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    near = pixels.withColumns({"up": F.lag("argb").over(column), "down": F.lead("argb").over(column), "left": F.lag("argb").over(row), "right": F.lead("argb").over(row)})
    smooth, inner = F.lit(True), F.lit(True)
    for side in ("up", "down", "left", "right"):
        smooth = smooth & argb.is_near(F.col("argb"), F.col(side), 1 << bits)
        inner = inner & F.col(side).isNotNull()
    return near.select("img", "x", "y", F.when(inner & ~smooth, argb.discretized(F.col("argb"), bits)).otherwise(F.col("argb")).alias("argb"))


def near_lossless_passes(pixels: DataFrame, level: int) -> DataFrame:
    """All passes of a level, the strongest first; images with fewer than MIN_NEAR_LOSSLESS pixels both ways stay as they are."""
    sizes = pixels.groupBy("img").agg((F.greatest(F.max("x"), F.max("y")) + 1 >= MIN_NEAR_LOSSLESS).alias("large"))
    if near_lossless_bits(level) == 0:
        return pixels
    sized = pixels.join(sizes, "img")
    small, pixels = sized.where("not large").select(*pixels.columns), sized.where("large").select(*pixels.columns)
    for bits in range(near_lossless_bits(level), 0, -1):
        pixels = near_lossless(pixels, bits)
    return pixels.union(small.select(*pixels.columns))


def alpha_filtered(planes: DataFrame, kind: str) -> DataFrame:
    """(img, x, y, v): each alpha value less its prediction: horizontal, vertical or gradient; the first row is always horizontal."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    near = planes.withColumn("top", F.lag("v").over(column)).withColumns({"left": F.lag("v").over(row), "corner": F.lag("top").over(row)})
    flat = F.coalesce("left", "top", F.lit(0))
    guess = {"horizontal": flat, "vertical": F.coalesce("top", flat), "gradient": F.when(F.col("top").isNull(), flat).when(F.col("left").isNull(), F.col("top")).otherwise(_clip(F.col("left") + F.col("top") - F.col("corner")))}[kind]
    return near.select("img", "x", "y", F.pmod(F.col("v") - guess, F.lit(256)).alias("v"))


def alpha_unfiltered_rows(planes: DataFrame) -> DataFrame:
    """The inverse of the horizontal filter: running sums down the first column, then along each row."""
    first = planes.where("x = 0").select("img", "y", F.sum("v").over(Window.partitionBy("img").orderBy("y")).alias("seed"))
    along = F.sum(F.when(F.col("x") > 0, F.col("v")).otherwise(0)).over(Window.partitionBy("img", "y").orderBy("x"))
    return planes.withColumn("run", along).join(first, ["img", "y"]).select("img", "x", "y", F.pmod(F.col("seed") + F.col("run"), F.lit(256)).alias("v"))


def prefix_code(value: Column) -> Column:
    """struct(symbol, extra_bits, extra): how a length or distance from 1 on is coded: the two highest bits of value - 1 and the rest."""
    d = value - 1
    high = F.length(F.bin(d)) - 1
    extra = F.greatest(high - 1, F.lit(0))
    second = F.call_function("shiftright", d, extra).bitwiseAND(F.lit(1))
    rest = d - F.call_function("shiftleft", F.call_function("shiftright", d, extra), extra)
    small = value <= 4
    return F.struct(F.when(small, d).otherwise(2 * high + second).cast("int").alias("symbol"), F.when(small, 0).otherwise(extra).cast("int").alias("extra_bits"), F.when(small, F.lit(0)).otherwise(rest).cast("long").alias("extra"))


def prefix_value(symbol: Column, extra: Column) -> Column:
    """The value that a prefix code stands for."""
    bits = F.shiftright(symbol - 2, 1)
    return F.when(symbol < 4, symbol + 1).otherwise(F.call_function("shiftleft", (2 + symbol.bitwiseAND(F.lit(1))).cast("long"), bits) + extra + 1)


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """(img, symbol, length, code, reversed): each image's canonical prefix codes of used symbols (length over 0), by length, then symbol; reversed has the bits from the other end.

    The code of the n-th symbol is the sum, over the symbols before it, of the share of codes that each takes.
    """
    used = lengths.where("length > 0")
    order = Window.partitionBy("img").orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - F.col("length"))).over(order), F.lit(0))
    code = F.call_function("shiftright", share, F.lit(32) - F.col("length"))
    digits = F.lpad(F.bin(code), F.col("length"), F.lit("0"))
    return used.select("img", "symbol", "length", code.alias("code"), F.conv(F.reverse(digits), 2, 10).cast("long").alias("reversed"))


def _tree_depths(counts: list[int], floor: int) -> list[int]:
    """The depth of each leaf in the tree that joins the two least weights again and again; of equal ones the older. Weights are at least ``floor``."""
    heap = [(max(n, floor), i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    above = [0] * (2 * len(counts) - 1)
    for parent in range(len(counts), len(above)):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i] = above[j] = parent
        heapq.heappush(heap, (a + b, parent))
    depth = [0] * len(above)
    for node in range(len(above) - 2, -1, -1):
        depth[node] = depth[above[node]] + 1
    return depth[: len(counts)]


def code_lengths(counts: DataFrame, limit: int = 15) -> DataFrame:
    """(img, symbol, n, length): the prefix-code lengths, at most ``limit``, of each image's symbols (img, symbol, n) with n over 0.

    The tree is the best one; while it is too deep, weights below a floor count as the floor, which doubles. A single symbol has length 1.
    An image's symbols are one array (an alphabet has a few hundred), and a small Arrow helper builds its tree. ``limit`` must leave room for them.
    """
    used = counts.where("n > 0").groupBy("img").agg(F.array_sort(F.collect_list(F.struct("symbol", F.col("n").cast("long").alias("n")))).alias("symbols"))

    @arrow_udf("array<int>")
    def lengths(weights: pa.Array) -> pa.Array:
        out = []
        for row in weights.to_pylist():
            if len(row) > 1 << limit:
                raise ValueError(f"{len(row)} symbols need codes of more than {limit} bits")
            floor, found = 1, [1] if len(row) == 1 else _tree_depths(row, 1)
            while max(found) > limit:
                floor *= 2
                found = _tree_depths(row, floor)
            out.append(found)
        return pa.array(out, pa.list_(pa.int32()))

    coded = used.withColumn("lengths", lengths(F.transform("symbols", lambda s: s["n"])))
    return coded.select("img", F.inline(F.arrays_zip("symbols", "lengths"))).select("img", "symbols.symbol", "symbols.n", F.col("lengths").alias("length"))


# The least and greatest size of a block as powers of two, the blocks of an image at most, and the cost of a code's header.
BLOCK_BITS, MAX_BLOCKS, HEADER_BITS, SYMBOL_BITS = (2, 9), 256, 24, 3


def _fixed_logs(n: np.ndarray) -> np.ndarray:
    """n times its base-2 logarithm with 16 bits below the point, as ``pixels.fixed_log2`` gives it."""
    known, at = np.unique(n, return_inverse=True)
    whole = np.array([max(int(x), 1).bit_length() - 1 for x in known], np.int64)
    m = np.where(whole <= 16, known << np.maximum(16 - whole, 0), known >> np.maximum(whole - 16, 0))
    part = np.zeros_like(known)
    for k in range(15, -1, -1):
        m = m * m >> 16
        high = m >= 1 << 17
        m = np.where(high, m >> 1, m)
        part += high.astype(np.int64) << k
    return np.where(known > 1, known * (whole * 65536 + part), 0)[at].reshape(n.shape)


def _code_bits(counts: np.ndarray) -> np.ndarray:
    """The bits that the codes of histograms (..., channel, value) take: whole bits of each channel's entropy, and headers of channels with two values or more."""
    used = (counts > 0).sum(axis=-1)
    entropy = (_fixed_logs(counts.sum(axis=-1)) - _fixed_logs(counts).sum(axis=-1)) >> 16
    return (entropy + np.where(used > 1, HEADER_BITS + SYMBOL_BITS * used, 0)).sum(axis=-1)


def _merged_groups(counts: np.ndarray) -> np.ndarray:
    """The group of each block: the two groups that save most together are joined, of equally good pairs the first, until none saves any; numbered by their first blocks."""
    n = len(counts)
    group, alive, own = np.arange(n), np.ones(n, bool), _code_bits(counts)
    saving = np.full((n, n), np.iinfo(np.int64).max)
    for i in range(n - 1):
        saving[i, i + 1 :] = _code_bits(counts[i] + counts[i + 1 :]) - own[i] - own[i + 1 :]
    while n > 1:
        a, b = divmod(int(saving.argmin()), n)
        if saving[a, b] >= 0:
            break
        counts[a] += counts[b]
        own[a], alive[b] = _code_bits(counts[a]), False
        group[group == b] = a
        saving[b, :] = saving[:, b] = np.iinfo(np.int64).max
        others = np.flatnonzero(alive & (np.arange(n) != a))
        if len(others):
            with_a = _code_bits(counts[a] + counts[others]) - own[a] - own[others]
            saving[np.minimum(a, others), np.maximum(a, others)] = with_a
    return np.unique(group, return_inverse=True)[1]


def block_groups(pixels: DataFrame) -> DataFrame:
    """(img, bits, bx, by, group): which blocks of 2**bits pixels of an image share their codes, each pixel coded by its four channels.

    Blocks are the smallest of which an image has no more than MAX_BLOCKS; a larger image than that allows has one group, with bits null and a row for block 0. Pixels are counted by block
    before they move; an image's blocks, at most MAX_BLOCKS histograms, are merged pair by pair in one group of a task.
    """
    size = pixels.groupBy("img").agg((F.max("x") + 1).cast("long").alias("w"), (F.max("y") + 1).cast("long").alias("h"))
    side = lambda c, k: F.shiftright(F.col(c) + (1 << k) - 1, k)
    bits = F.coalesce(*[F.when(side("w", k) * side("h", k) <= MAX_BLOCKS, F.lit(k)) for k in range(BLOCK_BITS[0], BLOCK_BITS[1] + 1)])
    sized = pixels.join(size.select("img", bits.alias("bits")), "img")
    at = lambda c: F.coalesce(F.call_function("shiftright", F.col(c).cast("int"), F.col("bits")), F.lit(0))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), argb.channel(F.col("argb"), c).cast("int").alias("value")) for n, c in enumerate("argb")]))
    counts = sized.select("img", "bits", at("x").alias("bx"), at("y").alias("by"), parts.alias("p")).groupBy("img", "bits", "bx", "by", "p.channel", "p.value").agg(F.count("*").alias("n"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        blocks, block = np.unique(rows[["by", "bx"]].to_numpy(), axis=0, return_inverse=True)
        table = np.zeros((len(blocks), 4, 256), np.int64)
        table[block.ravel(), rows["channel"], rows["value"]] = rows["n"]
        return pd.DataFrame({"img": rows["img"].iloc[0], "bits": rows["bits"].iloc[0], "bx": blocks[:, 1], "by": blocks[:, 0], "group": _merged_groups(table)}).astype({"bits": "Int32"})

    kind = dict(pixels.dtypes)["img"]
    return counts.groupBy("img").applyInPandas(merge, f"img {kind}, bits int, bx int, by int, group int")
