"""Operators on pixel tables (img, x, y, argb). Images are never gathered: geometry is arithmetic on x and y."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.functions import argb


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The window's pixels, moved to the corner. Windows must not be empty; one that leaves an image simply has fewer pixels there (see ``crop_errors``)."""
    if width < 1 or height < 1 or x < 0 or y < 0:
        raise ValueError("the window must have a size and a place")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.where(inside).select("img", (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "argb")


def crop_errors(images: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """``images`` (img, width, height) with an error crop_out_of_bounds where the window doesn't fit, so that bad rows go before any pixel is read."""
    return images.withColumn("error", F.when((F.col("width") < x + width) | (F.col("height") < y + height), "crop_out_of_bounds"))


def scaled_size(width: Column, height: Column, to_width: Column, to_height: Column) -> tuple[Column, Column]:
    """The target size; a 0 is derived from the other axis, rounded up, the width first."""
    up = lambda a, b: F.call_function("div", a + b - 1, b).cast("long")
    w = F.when(to_width == 0, up(width * to_height, height)).otherwise(to_width)
    return w, F.when(to_height == 0, up(height * w, width)).otherwise(to_height)


def flip(pixels: DataFrame) -> DataFrame:
    """Every image upside down; its height is that of its own pixels."""
    height = pixels.groupBy("img").agg((F.max("y") + 1).alias("h"))
    return pixels.join(height, "img").select("img", "x", (F.col("h") - 1 - F.col("y")).alias("y"), "argb")


def pad(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Every image at the top left of a transparent canvas; pixels beyond the canvas go."""
    grid = pixels.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i"))
    grid = grid.select("img", F.pmod("i", F.lit(width)).alias("x"), F.call_function("div", F.col("i"), F.lit(width)).cast("int").alias("y"))
    return grid.join(pixels, ["img", "x", "y"], "left").select("img", "x", "y", F.coalesce("argb", F.lit(0).cast("long")).alias("argb"))


def shrink(pixels: DataFrame, factor: int) -> DataFrame:
    """Every image ``factor`` times smaller: premultiplied box averages, rounded, colours restored. Rims that don't fill a box average what they have."""
    at = [F.call_function("div", F.col(c), F.lit(factor)).cast("int").alias(c) for c in ("x", "y")]
    m = argb.matte(F.col("argb"))
    sums = pixels.select("img", *at, *[argb.channel(m, c).alias(c) for c in "argb"]).groupBy("img", "x", "y").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "argb"])
    mean = lambda c: F.call_function("div", F.col(c) * 2 + F.col("n"), F.col("n") * 2)
    return sums.select("img", "x", "y", argb.matte(argb.pack(*[mean(c) for c in "argb"]), inverse=True).alias("argb"))


_ONE = 1 << 32


def _fraction(a: Column, b: Column) -> Column:
    """a / b in fixed point with 32 bits; a whole one has none."""
    return F.pmod(F.call_function("div", a.cast("long") * F.lit(_ONE), b.cast("long")), F.lit(_ONE))


def _product(a: Column, b: Column) -> Column:
    """The product of a number and a fraction, rounded."""
    return F.shiftright(a * b + F.lit(_ONE >> 1), 32)


def _targets(at: Column, n: Column, to: Column, shares: Callable[[Column, Column], Column]) -> Column:
    """array<struct(to, ...)>: the target cells that source cell ``at`` of ``n`` reaches, and its share in them.

    When there are fewer target cells, a source cell lies in one; when there are more, each target cell lies between two source cells.
    ``shares(cell, over)`` makes the entries of a target cell.
    """
    div = lambda a, b: F.call_function("div", a, b)
    here = div(at * to, n)
    over = div((here + 1) * n + to - 1, to) * to - (here + 1) * n  # how far the last source cell of a target cell reaches beyond it
    last = div((here + 1) * n + to - 1, to) - 1 == at
    return shares(here, F.when(last, over).otherwise(0))


def _between(at: Column, n: Column, to: Column, upper: bool) -> Column:
    """The target cells, more than source cells, of which ``at`` is the upper or the lower neighbour, as array<long>; rounding goes up."""
    div = lambda a, b: F.call_function("div", a, b)
    steps, cells = to - 1, F.greatest(n - 1, F.lit(1))
    until = lambda q: div(q * steps, cells)
    place = at if upper else at + 1
    low, high = F.when(place == 0, 0).otherwise(until(place - 1) + 1), F.when(place == 0, 0).otherwise(until(place))
    whole = F.sequence(F.lit(0).cast("long"), steps)
    none = F.array().cast("array<bigint>")
    span = F.when((place < n) & (low <= high), F.sequence(low.cast("long"), high.cast("long"))).otherwise(none)
    return F.when(n == 1, whole if upper else none).otherwise(span)


def resized(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, x, y, argb): images at the sizes (img, width, height, to_width, to_height), any ratio, colours weighted by alpha. Images without sizes go.

    Fewer columns or rows are area averages, more are interpolated; fixed point with 32 bits decides the last digit. A cell's average takes what its last source cell has
    beyond it off and gives it to the next cell, and that depends on this source cell alone. So each axis is one join of source cells
    with the one or two target cells that they reach, and one sum by target cell: two shuffles, with partial sums before each.
    """
    div = lambda a, b: F.call_function("div", a, b)
    channels = "argb"
    m = argb.matte(F.col("argb"))
    size = sizes.select("img", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "to_width", "to_height")])
    at = pixels.join(size, "img").select("img", F.col("x").cast("long").alias("x"), "y", "width", "height", "to_width", "to_height", *[argb.channel(m, c).alias(c) for c in channels])
    n, to = F.col("width"), F.col("to_width")
    entry = lambda cell, values: F.struct(cell.cast("long").alias("cell"), *[values(c).cast("long").alias(c) for c in channels])

    def columns(cell: Column, over: Column) -> Column:
        carried = lambda c: _product(F.col(c) * over, _fraction(F.lit(1), to))
        return F.array(entry(cell, lambda c: F.col(c) * to - F.col(c) * over), entry(cell + 1, lambda c: carried(c) * to))

    # How near target cell k lies to its lower neighbour, of to - 1 parts; a single column counts for both.
    nearness = lambda k: F.greatest(F.lit(1), div(k * (n - 1) + to - 2, to - 1)) * (to - 1) - k * (n - 1)
    lower = F.transform(_between(F.col("x"), n, to, False), lambda k: entry(k, lambda c: F.col(c) * nearness(k)))
    first = F.when(F.col("x") == 0, F.array(entry(F.lit(0), lambda c: F.col(c) * (to - 1)))).otherwise(F.array().cast(f"array<struct<cell:bigint,{','.join(f'{c}:bigint' for c in channels)}>>"))
    upper = F.transform(F.filter(_between(F.col("x"), n, to, True), lambda k: (k > 0) | (n == 1)), lambda k: entry(k, lambda c: F.col(c) * F.when(n == 1, to - 1).otherwise(to - 1 - nearness(k))))
    parts = F.when(n < to, F.concat(lower, F.when(n == 1, F.array().cast(f"array<struct<cell:bigint,{','.join(f'{c}:bigint' for c in channels)}>>")).otherwise(first), upper)).otherwise(_targets(F.col("x"), n, to, columns))
    keys = ["img", "width", "height", "to_width", "to_height"]
    rows = at.select(*keys, "y", F.explode(parts).alias("p")).select(*keys, F.col("y").cast("long").alias("y"), F.col("p.cell").alias("x"), *[F.col(f"p.{c}").alias(c) for c in channels]).where("x < to_width")
    rows = rows.groupBy(*keys, "y", "x").agg(*[F.pmod(F.sum(c), F.lit(_ONE)).alias(c) for c in channels])

    h, up = F.col("height"), F.col("to_height")

    def lines(cell: Column, over: Column) -> Column:
        beyond = lambda c: F.shiftright(F.col(c) * F.pmod(_fraction(F.lit(1), up) * over, F.lit(_ONE)), 32)
        return F.array(entry(cell, lambda c: F.col(c) - beyond(c)), entry(cell + 1, beyond))

    reach = lambda k: div(k * (h - 1) + up - 2, up - 1) * (up - 1) - k * (h - 1)
    above = F.transform(_between(F.col("y"), h, up, True), lambda k: entry(k, lambda c: F.col(c) * (F.lit(_ONE) - _fraction(reach(k), up - 1))))
    below = F.transform(F.filter(_between(F.col("y"), h, up, False), lambda k: reach(k) > 0), lambda k: entry(k, lambda c: F.col(c) * _fraction(reach(k), up - 1)))
    parts = F.when(h < up, F.concat(above, below)).otherwise(_targets(F.col("y"), h, up, lines))
    cells = rows.select(*keys, "x", F.explode(parts).alias("p")).select(*keys, "x", F.col("p.cell").alias("y"), *[F.col(f"p.{c}").alias(c) for c in channels]).where("y < to_height")
    cells = cells.groupBy(*keys, "x", "y").agg(*[F.sum(c).alias(c) for c in channels])
    wide = F.when(n < to, to - 1).otherwise(n)
    scale = div(up * F.lit(_ONE), wide * h)
    averaged = lambda c: F.when(scale < F.lit(_ONE), _product(F.pmod(F.col(c), F.lit(_ONE)), scale)).otherwise(F.pmod(F.col(c), F.lit(256)))
    blended = lambda c: _product(F.shiftright(F.col(c) + F.lit(_ONE >> 1), 32), _fraction(F.lit(1), wide))
    value = lambda c: F.least(F.lit(255), F.when(h < up, blended(c)).otherwise(averaged(c)))
    return cells.select("img", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), argb.matte(argb.pack(*[value(c) for c in channels]), inverse=True).alias("argb"))


def upsampled(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """(img, x, y, argb): opaque pixels from luma (img, x, y, v) and half-size chroma (img, x, y, u, v), each chroma value blended with its neighbours by 9:3:3:1.

    A pixel lies nearest to one chroma cell; the others of the four are on the sides that its parity tells. Cells beyond the rim are those on it. Each chroma
    cell goes to the at most 16 pixels around it, and Spark meets them by place: a stencil without windows.
    """
    size = luma.groupBy("img").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    at = luma.join(size, "img").withColumnRenamed("v", "luma")
    half = lambda c: F.shiftright(c, 1)

    def near_far(c: str, edge: str) -> tuple[Column, Column]:
        place = F.col(c)
        far = F.when(F.pmod(place, F.lit(2)) == 1, half(place) + 1).otherwise(half(place) - 1)
        return half(place), F.least(F.greatest(far, F.lit(0)), half(F.col(edge)))

    (nx, fx), (ny, fy) = near_far("x", "right"), near_far("y", "bottom")
    corners = F.explode(F.array(*[F.struct(cx.alias("cx"), cy.alias("cy"), F.lit(n).alias("corner")) for n, (cx, cy) in enumerate(((nx, ny), (fx, ny), (nx, fy), (fx, fy)))]))
    met = at.select("img", "x", "y", "luma", corners.alias("c")).select("img", "x", "y", "luma", "c.*").join(chroma.select("img", F.col("x").cast("int").alias("cx"), F.col("y").cast("int").alias("cy"), "u", "v"), ["img", "cx", "cy"])
    one = lambda c, n: F.max(F.when(F.col("corner") == n, F.col(c))).alias(f"{c}{n}")
    four = met.groupBy("img", "x", "y").agg(F.first("luma").alias("luma"), *[one(c, n) for c in "uv" for n in range(4)]).join(size, "img")
    rim = (F.col("x") == 0) | ((F.col("x") == F.col("right")) & (F.pmod("x", F.lit(2)) == 1))

    def blended(c: str) -> Column:
        near, side, below, across = (F.col(f"{c}{n}") for n in range(4))
        flat = F.shiftright(3 * near + below + 2, 2)
        # First the mean of the four with the two sides three times, rounded, then its mean with the nearest, cut.
        mixed = F.shiftright(F.shiftright(near + 3 * side + 3 * below + across + 8, 3) + near, 1)
        return F.when(rim, flat).otherwise(mixed)

    return four.select("img", "x", "y", argb.yuv_to_argb(F.col("luma"), blended("u"), blended("v")).alias("argb"))


def alpha_flags(pixels: DataFrame) -> DataFrame:
    """(img, has_alpha): whether any pixel isn't opaque."""
    return pixels.groupBy("img").agg(F.bool_or(argb.channel(F.col("argb"), "a") != 255).alias("has_alpha"))


def classes(pixels: DataFrame, most: int = 8192) -> DataFrame:
    """(img, class): transparent, graphic (at most ``most`` colours) or photo."""
    rgb = F.col("argb").bitwiseAND(F.lit(0xFFFFFF))
    per = pixels.groupBy("img").agg(F.bool_or(argb.channel(F.col("argb"), "a") != 255).alias("t"), F.count_distinct(rgb).alias("n"))
    return per.select("img", F.when(F.col("t"), "transparent").when(F.col("n") <= most, "graphic").otherwise("photo").alias("class"))


def histogram(pixels: DataFrame) -> DataFrame:
    """(channel, value, n) over all pixels, with partial sums before the shuffle."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), argb.channel(F.col("argb"), c).alias("value")) for c in "argb"]))
    return pixels.select(parts.alias("p")).groupBy("p.channel", "p.value").agg(F.count("*").alias("n"))


def entropies(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, bits): Shannon's n log2 n sums of (keys, value, n), the least bits that the values take."""
    log = lambda n: F.col(n) * F.log2(F.col(n))
    per = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(log("n")).alias("part"))
    return per.select(*keys, (log("total") - F.col("part")).alias("bits"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(img, width, height, psnr, max_delta, error) for images in both tables; psnr over RGB is null if they are alike, max_delta is over RGBA.

    Images of different sizes have the error size_mismatch and nothing else.
    """
    size = lambda t: t.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    sizes = size(left).alias("l").join(size(right).alias("r"), "img")
    differ = (F.col("l.width") != F.col("r.width")) | (F.col("l.height") != F.col("r.height"))
    both = left.alias("l").join(right.alias("r"), ["img", "x", "y"])
    deltas = {c: F.abs(argb.channel(F.col("l.argb"), c) - argb.channel(F.col("r.argb"), c)) for c in "argb"}
    sums = both.groupBy("img").agg(F.sum(sum((deltas[c] * deltas[c] for c in "rgb"), F.lit(0))).alias("se"), F.count("*").alias("n"), F.max(F.greatest(*deltas.values())).alias("most"))
    psnr = F.when(F.col("se") > 0, 10 * F.log10(F.lit(255.0 * 255.0) * 3 * F.col("n") / F.col("se")))
    return sizes.join(sums, "img", "left").select("img", F.col("l.width").alias("width"), F.col("l.height").alias("height"), F.when(~differ, psnr).alias("psnr"), F.when(~differ, F.col("most")).alias("max_delta"), F.when(differ, "size_mismatch").alias("error"))


def fixed_log2(n: Column) -> Column:
    """The base-2 logarithm of a whole number, times 65,536, rounded down bit by bit; 0 below 2."""
    n = n.cast("long")
    whole = F.length(F.bin(n)) - 1
    shifted = lambda f, a, b: F.call_function(f, a, b)
    start = F.when(whole <= 16, shifted("shiftleft", n, 16 - whole)).otherwise(shifted("shiftright", n, whole - 16))

    def step(state: Column, k: Column) -> Column:
        square = F.shiftright(state["m"] * state["m"], 16)
        high = square >= 1 << 17
        return F.struct(F.when(high, F.shiftright(square, 1)).otherwise(square).alias("m"), (state["f"] + F.when(high, shifted("shiftleft", F.lit(1).cast("long"), k)).otherwise(0)).alias("f"))

    part = F.aggregate(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), F.struct(start.alias("m"), F.lit(0).cast("long").alias("f")), step, lambda s: s["f"])
    return F.when(n > 1, whole * 65536 + part).otherwise(F.lit(0).cast("long"))


#: The exact PSNR of equal images, and log2(10) times 65,536; fixed values.
EQUAL_CENTIDECIBELS, LOG2_10 = (1 << 32) - 1, 217_706


def exact_psnr(left: DataFrame, right: DataFrame) -> DataFrame:
    """(img, centidecibels): the PSNR over RGB of images in both tables in whole hundredths of a decibel, by whole-number arithmetic; null if their sizes differ."""
    extent = lambda t: t.groupBy("img").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    alike = extent(left).join(extent(right).withColumnsRenamed({"right": "r", "bottom": "b"}), "img").select("img", ((F.col("right") == F.col("r")) & (F.col("bottom") == F.col("b"))).alias("alike"))
    both = left.alias("l").join(right.alias("r"), ["img", "x", "y"])
    deltas = [argb.channel(F.col("l.argb"), c) - argb.channel(F.col("r.argb"), c) for c in "rgb"]
    sums = both.groupBy("img").agg(F.sum(sum((d * d for d in deltas), F.lit(0))).alias("se"), F.count("*").alias("n"))
    ratio = F.greatest(F.lit(0), fixed_log2(65025 * 3 * F.col("n")) - fixed_log2(F.col("se")))
    value = F.when(F.col("se") == 0, F.lit(EQUAL_CENTIDECIBELS)).otherwise(F.call_function("div", ratio * 1000, F.lit(LOG2_10)))
    return alike.join(sums, "img", "left").select("img", F.when(F.col("alike"), value).alias("centidecibels"))


def with_alpha(pixels: DataFrame, plane: DataFrame) -> DataFrame:
    """(img, x, y, argb): pixels with the alpha of a plane (img, x, y, v); a pixel that the plane lacks has a null argb."""
    given = pixels.select("img", "x", "y", "argb").join(plane.select("img", "x", "y", "v"), ["img", "x", "y"], "left")
    return given.select("img", "x", "y", (F.col("argb").bitwiseAND(F.lit(0xFFFFFF)) + F.shiftleft(F.col("v").cast("long"), 24)).alias("argb"))


#: What keeps the quotients of the structural similarity of 8-bit samples from dividing by nothing.
SSIM_LUMA, SSIM_CONTRAST = 6.5025, 58.5225


def ssim(left: DataFrame, right: DataFrame, block: int = 8) -> DataFrame:
    """(img, ssim): the mean over blocks and colours of the structural similarity of two tables' images."""
    c1, c2 = SSIM_LUMA, SSIM_CONTRAST
    both = left.alias("l").join(right.alias("r"), ["img", "x", "y"])
    at = [F.call_function("div", F.col(c), F.lit(block)).alias(f"b{c}") for c in ("x", "y")]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), argb.channel(F.col("l.argb"), c).cast("double").alias("p"), argb.channel(F.col("r.argb"), c).cast("double").alias("q")) for c in "rgb"]))
    stats = both.select("img", *at, values.alias("v")).groupBy("img", "bx", "by", "v.c").agg(F.avg("v.p").alias("mp"), F.avg("v.q").alias("mq"), F.var_pop("v.p").alias("vp"), F.var_pop("v.q").alias("vq"), F.covar_pop("v.p", "v.q").alias("cov"))
    one = (2 * F.col("mp") * F.col("mq") + c1) * (2 * F.col("cov") + c2) / ((F.col("mp") * F.col("mp") + F.col("mq") * F.col("mq") + c1) * (F.col("vp") + F.col("vq") + c2))
    return stats.groupBy("img").agg(F.avg(one).alias("ssim"))


def palettes(pixels: DataFrame, most: int = 256) -> DataFrame:
    """(img, idx, argb, delta, bundle_bits): each image's colours in order, the difference of each to the one before, and how many bits of pixels share a byte.

    Images of more than ``most`` colours have no palette.
    """
    colours = pixels.groupBy("img", "argb").agg(F.count("*").alias("_n")).drop("_n")
    few = colours.groupBy("img").agg(F.count("*").alias("colours")).where(F.col("colours") <= most)
    order = Window.partitionBy("img").orderBy("argb")
    before = F.coalesce(F.lag("argb").over(order), F.lit(0).cast("long"))
    delta = argb.pack(*[F.pmod(argb.channel(F.col("argb"), c) - argb.channel(before, c), F.lit(256)) for c in "argb"])
    bits = F.when(F.col("colours") <= 2, 3).when(F.col("colours") <= 4, 2).when(F.col("colours") <= 16, 1).otherwise(0)
    return colours.join(few, "img").select("img", (F.row_number().over(order) - 1).alias("idx"), "argb", delta.alias("delta"), bits.alias("bundle_bits"))


def indexed(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(img, x, y, idx): pixels as places in their image's palette."""
    return pixels.join(palette.select("img", "argb", "idx"), ["img", "argb"]).select("img", "x", "y", "idx")


def unindexed(indexes: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels from palette places; places beyond the palette are transparent."""
    return indexes.join(palette.select("img", "idx", "argb"), ["img", "idx"], "left").select("img", "x", "y", F.coalesce("argb", F.lit(0).cast("long")).alias("argb"))


def chroma_planes(pixels: DataFrame) -> DataFrame:
    """(img, x, y, u, v) at half size; blocks that reach over the right or lower edge repeat the edge's pixels."""
    half = [F.call_function("div", F.col(c), F.lit(2)).cast("int").alias(c) for c in ("x", "y")]
    rgb = [argb.channel(F.col("argb"), c).alias(c) for c in "rgb"]
    sums = pixels.select("img", *half, *rgb).groupBy("img", "x", "y").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])
    u, v = argb.chroma(*[F.call_function("div", F.col(c) * 4, F.col("n")) for c in "rgb"])
    return sums.select("img", "x", "y", u.alias("u"), v.alias("v"))


def effort_levels(pixels: DataFrame) -> DataFrame:
    """(img, level): how deep a search an image deserves: by the bits a pixel that its green row differences need, and no deeper than its size allows."""
    row = Window.partitionBy("img", "y").orderBy("x")
    green = argb.channel(F.col("argb"), "g")
    values = pixels.select("img", F.pmod(green - F.coalesce(F.lag(green).over(row), F.lit(0)), F.lit(256)).alias("value"))
    counts = values.groupBy("img", "value").agg(F.count("*").alias("n"))
    bits = entropies(counts, "img").join(counts.groupBy("img").agg(F.sum("n").alias("pixels")), "img")
    cost = F.floor(F.round("bits", 6)) / F.col("pixels")
    content = F.when(cost <= 1, 9).when(cost <= 2, 8).when(cost <= 3, 7).when(cost <= 4, 5).when(cost <= 5, 4).otherwise(3)
    size = F.when(F.col("pixels") <= 1 << 14, 9).when(F.col("pixels") <= 1 << 18, 6).when(F.col("pixels") <= 1 << 20, 4).when(F.col("pixels") <= 1 << 22, 3).otherwise(2)
    return bits.select("img", F.least(content, size).alias("level"))


#: Signs of the Walsh-Hadamard basis in the order that coded blocks use.
#: The signs of the transform's four rows.
HADAMARD = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1))


def block_hadamard(planes: DataFrame) -> DataFrame:
    """(img, bx, by, u, v, c): the Walsh-Hadamard transform of every 4 x 4 block of a plane (img, x, y, v), halved and rounded down: sums of samples by sign."""
    block = planes.select("img", F.shiftright("x", 2).alias("bx"), F.shiftright("y", 2).alias("by"), F.pmod("x", F.lit(4)).alias("i"), F.pmod("y", F.lit(4)).alias("j"), F.col("v").alias("s"))
    sign = lambda k, at: F.element_at(F.array(*map(F.lit, HADAMARD[k])), at + 1)
    sums = block.groupBy("img", "bx", "by").agg(*[F.sum(F.col("s") * sign(u, F.col("i")) * sign(v, F.col("j"))).alias(f"c{u}{v}") for u in range(4) for v in range(4)])
    cells = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.shiftright(f"c{u}{v}", 1).alias("c")) for u in range(4) for v in range(4)])
    return sums.select("img", "bx", "by", F.inline(cells))
