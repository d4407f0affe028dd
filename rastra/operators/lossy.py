"""The arithmetic of lossy coding that needs no bit stream: quantisers, levels, inverse transforms, filter strengths, presets.

Blocks are arrays of 16 numbers, row by row; everything here is a column expression over one row, but for ``blocks`` and
``segment_biases``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The format's steps for each quantiser, and the quantiser for each quality.
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17,
    18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43,
    44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74,
    75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118,
    122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19,
    20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51,
    52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108,
    110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209,
    213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
QUALITY_QUANTISERS = (
    127, 103, 97, 93, 89, 86, 84, 81, 79, 77,
    76, 74, 72, 71, 69, 68, 67, 66, 64, 63,
    62, 61, 60, 59, 58, 57, 56, 55, 54, 54,
    53, 52, 51, 50, 50, 49, 48, 47, 47, 46,
    45, 45, 44, 43, 43, 42, 41, 41, 40, 40,
    39, 38, 38, 37, 37, 36, 36, 35, 34, 34,
    33, 33, 32, 32, 31, 31, 30, 30, 29, 29,
    28, 28, 28, 27, 27, 26, 25, 24, 22, 21,
    20, 19, 18, 16, 15, 14, 13, 12, 11, 10,
    9, 8, 7, 6, 5, 4, 3, 3, 2, 1,
    0,
)
# The order of coefficients, what sharpening adds to each, and the presets.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
SHARPENING = (0, 30, 60, 90, 30, 60, 90, 90, 60, 90, 90, 90, 90, 90, 90, 90)
#: Noise shaping, filter strength, filter sharpness and segments of each preset.
PRESETS = {"default": (50, 60, 0, 4), "picture": (80, 35, 4, 4), "photo": (80, 30, 3, 4), "drawing": (25, 10, 6, 4), "icon": (25, 10, 0, 4), "text": (0, 0, 0, 2)}

# The inverse transform's two factors and that of the second-order steps, with 16 bits below the point.
INVERSE_LOW, INVERSE_HIGH, Y2_AC_SCALE = 35468, 20091, 101581

#: Bits below the point of a reciprocal; the largest level; the largest quantiser.
RECIPROCAL_BITS, MAX_LEVEL, MAX_QUANTISER = 17, 2047, 127


def _div(a: Column, b: Column) -> Column:
    """Whole division towards zero."""
    return F.call_function("div", a, b)


def _clip(c: Column, most: int | None, least: int | None = 0) -> Column:
    """A number kept within bounds; null stays null."""
    out = c if most is None else F.least(F.lit(most), c)
    return F.when(c.isNotNull(), out if least is None else F.greatest(F.lit(least), out))


def _entry(table: Sequence[int], index: Column) -> Column:
    return F.when(index.isNotNull(), F.get(F.array(*map(F.lit, table)), index.cast("int")))


def quantiser(quality: Column, jpeg_like: Column | None = None, partition_limit: Column | None = None) -> Column:
    """The quantiser (0 to 127) for a quality (0 to 100, clipped), coarser by a sixteenth of what is left if jpeg_like, and by the limit's percentage of 127; null if one of them is."""
    base = _entry(QUALITY_QUANTISERS, _clip(quality, 100))
    out = base
    if jpeg_like is not None:
        out = out + F.when(jpeg_like, _div(F.lit(MAX_QUANTISER + 15) - base, F.lit(16))).when(~jpeg_like, 0)
    if partition_limit is not None:
        out = out + _clip(_div(partition_limit * MAX_QUANTISER, F.lit(100)), None)
    return _clip(out, MAX_QUANTISER).cast("int")


def steps(q: Column) -> Column:
    """struct(y1_dc, y1_ac, y2_dc, y2_ac, uv_dc, uv_ac): what a level of one counts for, by plane; a quantiser out of range is clipped."""
    dc, ac, uv = _entry(DC_STEPS, _clip(q, MAX_QUANTISER)), _entry(AC_STEPS, _clip(q, MAX_QUANTISER)), _entry(DC_STEPS, _clip(q, 117))
    y2 = _clip(F.shiftright(ac.cast("long") * Y2_AC_SCALE, 16).cast("int"), None, 8)
    return F.struct(dc.alias("y1_dc"), ac.alias("y1_ac"), (dc * 2).alias("y2_dc"), y2.alias("y2_ac"), uv.alias("uv_dc"), ac.alias("uv_ac"))


def quantised(block: Column, dc: Column, ac: Column, first: int = 0, sharpen: bool = False) -> Column:
    """struct(levels, values, last) of a block of coefficients.

    levels (rounded to the nearest, in zigzag order, zero before ``first``), values (what a decoder gets back, row by row, as 16 bits) and
    last (the zigzag place of the last level that isn't zero; first - 1 if none). ``sharpen`` lifts high frequencies first.
    """
    wrap = lambda c: F.pmod(c + 32768, F.lit(65536)) - 32768

    def level(at: Column, n: Column) -> Column:
        c, step = F.get(block, at).cast("long"), F.when(at == 0, dc).otherwise(ac).cast("long")
        lift = F.shiftright(_entry(SHARPENING, at).cast("long") * ac, 11) if sharpen else F.lit(0)
        size = F.shiftright((F.abs(c) + lift) * _div((1 << RECIPROCAL_BITS) + _div(step, F.lit(2)), step) + (1 << RECIPROCAL_BITS - 1), RECIPROCAL_BITS)
        clipped = _clip(size, MAX_LEVEL, None)
        return F.when(n < first, F.lit(0).cast("long")).otherwise(F.when(c < 0, -clipped).otherwise(clipped))

    levels = F.transform(F.array(*map(F.lit, ZIGZAG)), level)
    at_place = [ZIGZAG.index(j) for j in range(16)]
    # One binding, so that levels are computed once for the three fields.
    build = lambda found: F.struct(
        found.alias("levels"),
        F.array(*[wrap(F.get(found, F.lit(n)) * (dc if j == 0 else ac)) for j, n in enumerate(at_place)]).alias("values"),
        F.greatest(F.array_max(F.transform(found, lambda v, n: F.when(v != 0, n))), F.lit(first - 1)).alias("last"),
    )
    return F.get(F.transform(F.array(levels), build), F.lit(0))


def _two_passes(block: Column, butterfly, rounder: int) -> Column:
    """A transform of columns, of the result's columns (which are the block's rows), then a shift by 3 with a rounder on the first of each four."""

    def one(values: Column, add: int) -> Column:
        cell = lambda i, k: F.get(values, i + 4 * k).cast("long")
        return F.flatten(F.transform(F.array(*map(F.lit, range(4))), lambda i: F.array(*butterfly(cell(i, 0) + add, cell(i, 1), cell(i, 2), cell(i, 3)))))

    second = lambda first: one(first, rounder)
    return F.transform(F.get(F.transform(F.array(one(block, 0)), second), F.lit(0)), lambda v: F.shiftright(v, 3))


def inverse_dct(block: Column) -> Column:
    """The residual samples of a block of coefficients, row by row, before they are added to a prediction."""
    less = lambda v: F.shiftright(v * INVERSE_LOW, 16)
    more = lambda v: F.shiftright(v * INVERSE_HIGH, 16) + v

    def butterfly(p: Column, q: Column, r: Column, s: Column) -> list[Column]:
        even, odd, low, high = p + r, p - r, less(q) - more(s), more(q) + less(s)
        return [even + high, odd + low, odd - low, even - high]

    return _two_passes(block, butterfly, 4)


def inverse_hadamard(block: Column) -> Column:
    """The first coefficients of 16 luma blocks from the block that holds them."""

    def butterfly(p: Column, q: Column, r: Column, s: Column) -> list[Column]:
        outer, inner, skew, rest = p + s, q + r, q - r, p - s
        return [outer + inner, rest + skew, outer - inner, rest - skew]

    return _two_passes(block, butterfly, 3)


def reconstructed(prediction: Column, residual: Column) -> Column:
    """A prediction's samples plus residuals, clipped to a byte."""
    return F.zip_with(prediction, residual, lambda p, r: _clip(p + r, 255))


def blocks(planes: DataFrame) -> DataFrame:
    """(img, bx, by, block): every whole 4 x 4 block of a plane (img, x, y, v); blocks that reach beyond the plane have no row."""
    cells = planes.select("img", F.shiftright("x", 2).alias("bx"), F.shiftright("y", 2).alias("by"), F.struct("y", "x", "v").alias("c"))
    whole = cells.groupBy("img", "bx", "by").agg(F.array_sort(F.collect_list("c")).alias("c")).where("size(c) = 16")
    return whole.select("img", "bx", "by", F.transform("c", lambda c: c["v"].cast("long")).alias("block"))


def filter_level(q: Column, strength: Column, bias: Column | None = None) -> Column:
    """The loop filter's level (0 to 63) for a quantiser, a strength (0 to 100) and a segment's bias (0 to 255); below 2 it is off."""
    step = F.shiftright(_entry(AC_STEPS, _clip(q, MAX_QUANTISER)), 2)
    level = _div(5 * strength * step, 256 + (_clip(bias, None) if bias is not None else F.lit(0)))
    return F.when(level < 2, 0).otherwise(_clip(level, 63, None)).cast("int")


def filter_limits(level: Column, sharpness: Column, is_4x4: Column, reference_delta: Column | None = None, mode_delta: Column | None = None) -> Column:
    """struct(edge_limit, inner_limit, inner_edges, hev_threshold) of a macroblock; all zero and false at level 0."""
    if reference_delta is not None:
        level = level + reference_delta
    if mode_delta is not None:
        level = level + F.when(is_4x4, mode_delta).when(~is_4x4, 0)
    level = _clip(level, 63)
    eased = F.when(sharpness > 4, F.shiftright(level, 2)).otherwise(F.shiftright(level, 1))
    inner = _clip(F.when(sharpness > 0, F.least(eased, 9 - sharpness)).when(sharpness <= 0, level), None, 1)
    on = level > 0
    hev = F.when(level >= 40, 2).when(level >= 15, 1).otherwise(0)
    zero = lambda c: F.when(on, c).when(~on, 0).cast("int")
    return F.struct(zero(2 * level + inner).alias("edge_limit"), zero(inner).alias("inner_limit"), (on & is_4x4).alias("inner_edges"), zero(hev).alias("hev_threshold"))


# Fixed values of the forward transform, of the activity measure and of the two clusterings.
DCT_LOW, DCT_HIGH = 2217, 5352
ACTIVITY_BINS, ACTIVITY_SCALE = 32, 510
CLUSTER_ROUNDS, LEAST_MOVE = 6, 5
SMOOTH_MAJORITY = 5
#: Bits below the point of an alpha level's centre.
LEVEL_BITS = 16


def _bound(value: Column, build) -> Column:
    """``build(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def forward_dct(block: Column) -> Column:
    """The coefficients of a block of 16 residual samples, row by row; rows are transformed first, then columns."""
    cell = lambda v, i: F.get(v, i).cast("long")
    four = F.array(*map(F.lit, range(4)))

    def row(i: Column) -> Column:
        a, b, c, d = (cell(block, 4 * i + k) for k in range(4))
        even, odd, inner, outer = a + d, b + c, b - c, a - d
        return F.array((even + odd) * 8, F.shiftright(inner * DCT_LOW + outer * DCT_HIGH + 1812, 9), (even - odd) * 8, F.shiftright(outer * DCT_LOW - inner * DCT_HIGH + 937, 9))

    def columns(rows: Column) -> Column:
        def column(i: Column) -> Column:
            a, b, c, d = (cell(rows, i + 4 * k) for k in range(4))
            even, odd, inner, outer = a + d, b + c, b - c, a - d
            return F.array(
                F.shiftright(even + odd + 7, 4), F.shiftright(inner * DCT_LOW + outer * DCT_HIGH + 12000, 16) + F.when(outer != 0, 1).otherwise(0),
                F.shiftright(even - odd + 7, 4), F.shiftright(outer * DCT_LOW - inner * DCT_HIGH + 51000, 16),
            )

        turned = lambda cols: F.flatten(F.transform(four, lambda k: F.transform(cols, lambda c: F.get(c, k))))
        return _bound(F.transform(four, column), turned)

    return _bound(F.flatten(F.transform(four, row)), columns)


def macroblock_activity(luma: DataFrame) -> DataFrame:
    """(img, mx, my, activity): how busy each 16 x 16 block of a luma plane (img, x, y, v) is, 0 to 255.

    The coefficients of its 4 x 4 blocks, the first of each left out, are counted in bins by size; the highest bin that is used counts against
    the fullest. A 4 x 4 block that lacks samples counts none. Blocks of 16 samples are the only rows that are gathered.
    """
    sample = F.struct((4 * F.pmod("y", F.lit(4)) + F.pmod("x", F.lit(4))).alias("at"), F.col("v").cast("long").alias("v"))
    small = luma.groupBy("img", F.shiftright("x", 2).alias("bx"), F.shiftright("y", 2).alias("by")).agg(F.array_sort(F.collect_list(sample)).alias("samples")).where(F.size("samples") == 16)
    bins = F.transform(forward_dct(F.transform("samples", lambda s: s["v"])), lambda c, i: F.when(i == 0, 0).otherwise(F.least(F.shiftright(F.abs(c), 3), F.lit(ACTIVITY_BINS - 1))).cast("int"))
    counts = small.select("img", F.shiftright("bx", 2).alias("mx"), F.shiftright("by", 2).alias("my"), F.explode(bins).alias("bin")).groupBy("img", "mx", "my", "bin").agg(F.count("*").alias("n"))
    most = counts.groupBy("img", "mx", "my").agg(F.max("bin").alias("last"), F.max("n").alias("n"))
    return most.select("img", "mx", "my", F.when(F.col("n") > 1, F.least(F.lit(255), _div(ACTIVITY_SCALE * F.col("last"), F.col("n")))).otherwise(0).cast("int").alias("activity"))


def segmented(blocks: DataFrame, most: int = 4) -> DataFrame:
    """``blocks`` (img, mx, my, activity) with segment, from 0 for the calmest, and centre, the segment's mean activity.

    Each image's activities, at most 256 values with counts, are one row; up to ``most`` centres start evenly spread over them and move to
    their values' means in CLUSTER_ROUNDS rounds at most, until all together move by less than LEAST_MOVE. A value belongs to the nearest centre, the lower of two.
    Centres that keep no value are no segments. An image whose blocks are all alike has one.
    """
    counts = blocks.groupBy("img", "activity").agg(F.count("*").alias("n")).groupBy("img").agg(F.array_sort(F.collect_list(F.struct(F.col("activity").cast("long").alias("a"), "n"))).alias("values"))
    low, high = F.get("values", F.lit(0))["a"], F.element_at("values", -1)["a"]
    begin = F.transform(F.sequence(F.lit(0), F.lit(max(0, most - 1))), lambda k: (low + _div((high - low) * k, F.lit(max(1, most - 1)))).cast("long"))
    nearest = lambda a, centres: F.array_min(F.transform(centres, lambda c, k: F.struct(F.abs(a - c).alias("d"), k.alias("k"))))["k"]
    total = lambda values, of: F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + of(v))
    mean = lambda values: _div(total(values, lambda v: v["a"] * v["n"]), total(values, lambda v: v["n"]))
    mine = lambda centres, k: F.filter("values", lambda v: nearest(v["a"], centres) == k)

    def step(state: Column, _: Column) -> Column:
        moved = F.transform(state["centres"], lambda c, k: _bound(mine(state["centres"], k), lambda own: F.when(F.size(own) > 0, mean(own)).otherwise(c)))
        far = lambda new: F.aggregate(F.zip_with(new, state["centres"], lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
        return F.when(state["done"], state).otherwise(_bound(moved, lambda new: F.struct(new.alias("centres"), (far(new) < LEAST_MOVE).alias("done"))))

    start = F.struct(begin.alias("centres"), F.lit(False).alias("done"))
    centres = F.aggregate(F.sequence(F.lit(1), F.lit(CLUSTER_ROUNDS)), start, step)["centres"] if most > 1 else begin
    found = counts.withColumn("centres", F.when(low == high, F.array(low)).otherwise(centres))
    placed = found.withColumn("spots", F.transform("values", lambda v: nearest(v["a"], F.col("centres"))))
    used = placed.withColumn("used", F.array_sort(F.array_distinct("spots")))
    entry = lambda v, i: F.struct(v["a"].cast("int").alias("activity"), (F.array_position("used", F.get("spots", i)) - 1).cast("int").alias("segment"), mean(mine(F.col("centres"), F.get("spots", i))).alias("centre"))
    table = used.select("img", F.inline(F.transform("values", entry)))
    return blocks.join(table, ["img", "activity"])


def smoothed(blocks: DataFrame) -> DataFrame:
    """``blocks`` (img, mx, my, segment) with smooth: the segment that SMOOTH_MAJORITY or more of the eight neighbours share, the lowest if there were two, else the block's own; blocks on the rim keep theirs."""
    beside = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    votes = blocks.select("img", F.explode(F.array(*[F.struct((F.col("mx") + dx).alias("mx"), (F.col("my") + dy).alias("my")) for dx, dy in beside])).alias("to"), "segment").select("img", "to.*", "segment")
    counted = votes.groupBy("img", "mx", "my", "segment").agg(F.count("*").alias("n")).groupBy("img", "mx", "my").agg(F.sum("n").alias("votes"), F.min(F.when(F.col("n") >= SMOOTH_MAJORITY, F.col("segment"))).alias("most"))
    return blocks.join(counted, ["img", "mx", "my"], "left").withColumn("smooth", F.when(F.col("votes") == len(beside), F.coalesce("most", "segment")).otherwise(F.col("segment"))).drop("votes", "most")


def quantised_alpha(planes: DataFrame, levels: int) -> DataFrame:
    """(img, x, y, v): alpha planes (img, x, y, v) with at most ``levels`` different values each (2 to 256); planes that have no more stay as they are.

    Each image's values, at most 256 with counts, are one row. Centres, fixed-point numbers, start evenly spread from the least to the largest value. In
    CLUSTER_ROUNDS rounds each value goes to the centre whose bounds, halfway to its neighbours, it lies in, and centres move to their values' means;
    centres without values stay. In the end each value becomes its centre, rounded.
    """
    counts = planes.groupBy("img", "v").agg(F.count("*").alias("n")).groupBy("img").agg(F.array_sort(F.collect_list(F.struct(F.col("v").cast("long").alias("v"), "n"))).alias("values"))
    low, high = F.get("values", F.lit(0))["v"], F.element_at("values", -1)["v"]
    rounded = lambda n, d: _div(n + _div(d, F.lit(2).cast("long")), d)
    scaled = lambda c: c * F.lit(1 << LEVEL_BITS)
    begin = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: scaled(low) + rounded(scaled((high - low) * i), F.lit(max(1, levels - 1)).cast("long")))
    bounds = lambda centres: F.zip_with(F.slice(centres, 1, levels - 1), F.slice(centres, 2, levels - 1), lambda a, b: a + b)
    spot = lambda v, limits: F.size(F.filter(limits, lambda b: 2 * scaled(v) > b))
    total = lambda values, of: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + of(x))

    def step(state: Column, _: Column) -> Column:
        spots = _bound(bounds(state["centres"]), lambda limits: F.transform("values", lambda x: spot(x["v"], limits)))
        mean = lambda own: rounded(scaled(total(own, lambda x: x["v"] * x["n"])), total(own, lambda x: x["n"]))
        own = lambda at, i: F.filter("values", lambda x, k: F.get(at, k) == i)
        return _bound(spots, lambda at: F.struct(F.transform(state["centres"], lambda c, i: _bound(own(at, i), lambda mine: F.when(F.size(mine) > 0, mean(mine)).otherwise(c))).alias("centres"), at.alias("spots")))

    start = F.struct(begin.alias("centres"), F.transform("values", lambda x: F.lit(0)).alias("spots"))
    end = counts.where(F.size("values") > levels).select("img", "values", F.aggregate(F.sequence(F.lit(1), F.lit(CLUSTER_ROUNDS)), start, step).alias("end"))
    value = lambda i: _clip(F.shiftright(F.get(F.col("end.centres"), F.get(F.col("end.spots"), i)) + F.lit(1 << (LEVEL_BITS - 1)), LEVEL_BITS), 255)
    table = end.select("img", F.inline(F.transform("values", lambda x, i: F.struct(x["v"].alias("v"), value(i).alias("level")))))
    return planes.join(table, ["img", "v"], "left").select("img", "x", "y", F.coalesce("level", "v").alias("v"))


def noise_shaping(activity: Column, strength: Column) -> Column:
    """How much coarser (or finer, below zero) a block of an activity (0 to 255) is quantised at a strength (0 to 100, clipped)."""
    return _div((activity - 128) * _clip(strength, 100), F.lit(512)).cast("int")


def segment_biases(segments: DataFrame) -> DataFrame:
    """``segments`` (img, segment, activity) with bias: 0 for an image's calmest segment, 255 for its busiest, 0 for all if they are alike."""
    per = Window.partitionBy("img")
    least, most = F.min("activity").over(per), F.max("activity").over(per)
    return segments.withColumn("bias", _div(255 * (F.col("activity") - least), F.greatest(most - least, F.lit(1))).cast("int"))


def alpha_levels(quality: Column) -> Column:
    """How many levels an alpha plane may keep at a quality (0 to 100, clipped): 2 to 256."""
    return (2 + _div(_clip(quality, 100) * 254 + 50, F.lit(100))).cast("int")


def preset(name: Column) -> Column:
    """struct(noise_shaping, filter_strength, filter_sharpness, segments) of a preset by name, case aside; null if there is none of the name."""
    fields = ("noise_shaping", "filter_strength", "filter_sharpness", "segments")
    table = F.create_map(*[x for n, v in PRESETS.items() for x in (F.lit(n), F.struct(*[F.lit(k).alias(f) for f, k in zip(fields, v, strict=True)]))])
    return F.try_element_at(table, F.lower(name))


def tuning(name: Column, **knobs: Column) -> Column:
    """A preset's values, overridden by the knobs that are not null and clipped to their ranges; without a known name, the default's."""
    most = {"noise_shaping": (0, 100), "filter_strength": (0, 100), "filter_sharpness": (0, 7), "segments": (1, 4)}
    base = F.coalesce(preset(name), preset(F.lit("default")))
    return F.struct(*[_clip(F.coalesce(knobs[f], base[f]) if f in knobs else base[f], hi, lo).cast("int").alias(f) for f, (lo, hi) in most.items()])
