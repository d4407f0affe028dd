"""Pixels as numbers 0xAARRGGBB in a BIGINT, as Spark expressions. All arithmetic is on whole numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte order of a pixel in each layout.
LAYOUTS = {"rgba8": "rgba", "argb8": "argb", "bgra8": "bgra"}
SHIFT = {"a": 24, "r": 16, "g": 8, "b": 0}


def channel(argb: Column, name: str) -> Column:
    return F.shiftright(argb, SHIFT[name]).bitwiseAND(F.lit(255))


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    """One pixel of four channels of 0 to 255."""
    parts = [F.shiftleft(c.cast("long"), s) for c, s in ((a, 24), (r, 16), (g, 8))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(b.cast("long"))


def each(argb: Column, change: Callable[[Column], Column], names: str = "argb") -> Column:
    """The pixel with ``change`` applied to the named channels, modulo 256."""
    return pack(*[F.pmod(change(channel(argb, c)), F.lit(256)) if c in names else channel(argb, c) for c in "argb"])


def to_layout(argb: Column, layout: str) -> Column:
    """The pixel's four bytes in a layout, as hex digits."""
    return F.concat(*[F.lpad(F.hex(channel(argb, c)), 2, "0") for c in LAYOUTS[layout]])


def from_layout(digits: Column, layout: str) -> Column:
    """The pixel that eight hex digits mean in a layout."""
    at = LAYOUTS[layout].index
    return pack(*[F.conv(F.substring(digits, 2 * at(c) + 1, 2), 16, 10).cast("long") for c in "argb"])


def opaque(argb: Column) -> Column:
    return argb.bitwiseOR(F.lit(0xFF000000))


def alpha_as_gray(argb: Column) -> Column:
    """The alpha channel as an opaque gray pixel."""
    a = channel(argb, "a")
    return pack(F.lit(255), a, a, a)


def clear_hidden(argb: Column) -> Column:
    """Fully transparent pixels lose their colour."""
    return F.when(channel(argb, "a") == 0, F.lit(0).cast("long")).otherwise(argb)


def matte(argb: Column, inverse: bool = False) -> Column:
    """Colour times alpha (or, inverse, colour restored), in fixed point with 24 bits; opaque pixels stay, transparent ones become 0."""
    a = channel(argb, "a")
    scale = F.expr("4278190080L").cast("long") if inverse else a * F.lit((1 << 24) // 255)
    scaled = (lambda c: F.shiftright(c * F.call_function("div", scale, a) + F.lit(1 << 23), 24)) if inverse else (lambda c: F.shiftright(c * scale + F.lit(1 << 23), 24))
    out = F.shiftleft(a, 24)
    for name in "rgb":
        out = out.bitwiseOR(F.shiftleft(scaled(channel(argb, name)), SHIFT[name]))
    return F.when(a == 255, argb).when(a == 0, F.lit(0).cast("long")).otherwise(out)


def over(src: Column, dst: Column) -> Column:
    """``src`` drawn over ``dst``, colours not premultiplied."""
    a = channel(src, "a")
    rest = F.shiftright(channel(dst, "a") * (F.lit(256) - a), 8)
    total = a + rest
    scale = F.call_function("div", F.lit(1 << 24).cast("long"), F.when(a > 0, total))
    mixed = {c: F.shiftright((channel(src, c) * a + channel(dst, c) * rest) * scale, 24).bitwiseAND(F.lit(255)) for c in "rgb"}
    return F.when(a == 255, src).when(a == 0, dst).otherwise(pack(total, mixed["r"], mixed["g"], mixed["b"]))


def subtract_green(argb: Column) -> Column:
    g = channel(argb, "g")
    return pack(channel(argb, "a"), F.pmod(channel(argb, "r") - g, F.lit(256)), g, F.pmod(channel(argb, "b") - g, F.lit(256)))


def add_green(argb: Column) -> Column:
    g = channel(argb, "g")
    return pack(channel(argb, "a"), F.pmod(channel(argb, "r") + g, F.lit(256)), g, F.pmod(channel(argb, "b") + g, F.lit(256)))


def signed_byte(n: Column) -> Column:
    """A byte read as a number of -128 to 127."""
    low = n.bitwiseAND(F.lit(255))
    return F.when(low > 127, low - 256).otherwise(low)


def cross_color(argb: Column, green_to_red: Column, green_to_blue: Column, red_to_blue: Column, inverse: bool = False) -> Column:
    """The cross-colour transform with signed 3.5 fixed-point multipliers; inverse undoes it."""
    sign = F.lit(1 if inverse else -1)
    step = lambda m, c: F.shiftright(signed_byte(m) * signed_byte(c), 5)
    a, r, g, b = (channel(argb, c) for c in "argb")
    red = F.pmod(r + sign * step(green_to_red, g), F.lit(256))
    blue = F.pmod(b + sign * (step(green_to_blue, g) + step(red_to_blue, red if inverse else r)), F.lit(256))
    return pack(a, red, g, blue)


#: Fixed value: the colour cache's multiplier.
CACHE_MULTIPLIER = 0x1E35A7BD


def cache_index(argb: Column, bits: int) -> Column:
    """The place of a pixel in a colour cache of 2**bits entries: the top bits of a 32-bit product."""
    return F.shiftright((argb * F.lit(CACHE_MULTIPLIER)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)


def discretized(argb: Column, bits: int) -> Column:
    """Every channel rounded to a grid of 2**bits, halves to even, at most 255."""
    mask = (1 << bits) - 1

    def near(c: Column) -> Column:
        biased = c + F.lit(mask >> 1) + F.shiftright(c, bits).bitwiseAND(F.lit(1))
        return F.when(biased > 255, F.lit(255)).otherwise(biased.bitwiseAND(F.lit(~mask & 0xFFFF)))

    return pack(*[near(channel(argb, c)) for c in "argb"])


def is_near(p: Column, q: Column, limit: int) -> Column:
    """Whether all channels differ by less than the limit."""
    out = F.lit(True)
    for c in "argb":
        out = out & (F.abs(channel(p, c) - channel(q, c)) < limit)
    return out


# The coefficients below are fixed values: of BT.601 in fixed point with 16 bits, and of its inverse with 14.


def luma(argb: Column) -> Column:
    """Y of BT.601 in 16-bit fixed point, 16 to 235."""
    return F.shiftright(16839 * channel(argb, "r") + 33059 * channel(argb, "g") + 6420 * channel(argb, "b") + F.lit((1 << 15) + (16 << 16)), 16)


def chroma(r4: Column, g4: Column, b4: Column) -> tuple[Column, Column]:
    """U and V from the sums of a colour over 2 x 2 pixels."""
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(v + F.lit((128 << 18) + (1 << 17)), 18)))
    return clip(-9719 * r4 - 19081 * g4 + 28800 * b4), clip(28800 * r4 - 24116 * g4 - 4684 * b4)


def yuv_to_argb(y: Column, u: Column, v: Column) -> Column:
    """An opaque pixel from Y, U, V; each product is cut to 8 bits less before they are added."""
    part = lambda c, k: F.shiftright(c * k, 8)
    clip = lambda n: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(n, 6)))
    base = part(y, 19077)
    return pack(F.lit(255), clip(base + part(v, 26149) - 14234), clip(base - part(u, 6419) - part(v, 13320) + 8708), clip(base + part(u, 33050) - 17685))
