"""Searches, clusterings and geometry against plain loops that keep state as a scalar version would."""

import random

import pytest

from pyspark.sql import functions as F

from rastra.operators import animation, batch, container, lossy, pixels, transforms
from rastra.sources import images as images_io


def images(seed, sizes, colours=None):
    """{img: rows of argb} of random pixels, smooth in part."""
    rng = random.Random(seed)
    out = {}
    for img, (w, h) in enumerate(sizes):
        pick = lambda x, y: rng.choice(colours) if colours else (rng.choice([255, 255, 0, 90]) << 24) | ((x * 9 + rng.randrange(40)) % 256 << 16) | ((x * 5 + y * 7 + rng.randrange(9)) % 256 << 8) | rng.randrange(256)
        out[img] = [[pick(x, y) for x in range(w)] for y in range(h)]
    return out


def table(spark, imgs):
    return spark.createDataFrame([(i, x, y, v) for i, rows in imgs.items() for y, row in enumerate(rows) for x, v in enumerate(row)], "img int, x int, y int, argb long")


def signed(c):
    return c - 256 if c > 127 else c


def plain_multipliers(rows, bits, tx, ty):
    px = [(v >> 16 & 255, v >> 8 & 255, v & 255) for y, row in enumerate(rows) if y >> bits == ty for x, v in enumerate(row) if x >> bits == tx]
    size = lambda v: min(v % 256, 256 - v % 256)
    best = lambda cost: min(range(-128, 128), key=lambda m: (cost(m), abs(m), m))
    share = lambda m, c: (m * signed(c)) >> 5
    red = best(lambda m: sum(size(r - share(m, g)) for r, g, _ in px))
    g2b = best(lambda m: sum(size(b - share(m, g)) for _, g, b in px))
    r2b = best(lambda m: sum(size(b - share(g2b, g) - share(m, r)) for r, g, b in px))
    for _ in range(2):
        was = g2b, r2b
        g2b = best(lambda m: sum(size(b - share(m, g) - share(r2b, r)) for r, g, b in px))
        r2b = best(lambda m: sum(size(b - share(g2b, g) - share(m, r)) for r, g, b in px))
        if was == (g2b, r2b):
            break
    return red, g2b, r2b


def test_cross_colour_multipliers_and_their_way_back(spark):
    imgs = images(1, [(7, 5), (1, 1), (4, 9), (8, 8)]) | {9: images(2, [(6, 6)], [0xFF102030, 0xFF204060, 0x00FFFFFF])[0]}
    px = table(spark, imgs)
    found = transforms.cross_colour_multipliers(px, 2)
    got = {(r["img"], r["tx"], r["ty"]): (r["green_to_red"], r["green_to_blue"], r["red_to_blue"]) for r in found.collect()}
    assert got == {k: plain_multipliers(imgs[k[0]], 2, k[1], k[2]) for k in got} and len(got) == 4 + 1 + 3 + 4 + 4
    there = transforms.cross_coloured(px, found, 2)
    assert sorted(map(tuple, transforms.cross_coloured(there, found, 2, inverse=True).collect())) == sorted(map(tuple, px.collect()))


def test_cross_colour_search_gathers_tiles_once(spark):
    """One shuffle for small tiles, and no row for each pixel and candidate; large tiles, bytes at the ends of their range and repeated pixels count as before."""
    ends = [a << 24 | r << 16 | g << 8 | b for a, r, g, b in ((255, 128, 127, 0), (0, 0, 128, 255), (9, 129, 128, 128), (255, 255, 1, 127), (255, 128, 128, 128))]
    imgs = images(4, [(37, 18), (5, 33)]) | {2: images(5, [(20, 19)], ends)[0], 3: [[0xFF000000] * 3] * 2}
    px = table(spark, imgs)
    plan = transforms.cross_colour_multipliers(px, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Join" not in plan
    for bits in (2, 4, 5):
        twice = px.union(px.where("img = 0")).union(spark.createDataFrame([(None, 0, 0, 5), (7, None, 0, 5)], px.schema))
        got = {(r["img"], r["tx"], r["ty"]): (r["green_to_red"], r["green_to_blue"], r["red_to_blue"]) for r in transforms.cross_colour_multipliers(twice, bits).collect()}
        assert set(got) == {(i, x >> bits, y >> bits) for i, rows in imgs.items() for y, row in enumerate(rows) for x in range(len(row))}
        assert got == {k: plain_multipliers(imgs[k[0]], bits, k[1], k[2]) for k in got}


def plain_log(n):
    """The logarithm of a whole number, times 65,536, by squaring."""
    if n < 2:
        return 0
    whole = n.bit_length() - 1
    m, part = (n << 16) >> whole, 0
    for k in range(15, -1, -1):
        m = m * m >> 16
        if m >= 1 << 17:
            m >>= 1
            part += 1 << k
    return whole * 65536 + part


def plain_guess(mode, left, top, corner, right):
    ch = lambda f: sum(f(*[p >> s & 255 for p in (left, top, corner, right)]) << s for s in (0, 8, 16, 24))
    clip = lambda v: max(0, min(255, v))
    cut = lambda v: int(v / 2)
    if mode == 11:
        lean = sum(abs((left >> s & 255) - (corner >> s & 255)) - abs((top >> s & 255) - (corner >> s & 255)) for s in (0, 8, 16, 24))
        return top if lean <= 0 else left
    return [
        lambda: 0xFF000000, lambda: left, lambda: top, lambda: right, lambda: corner, lambda: ch(lambda lf, t, c, r: ((lf + r) // 2 + t) // 2), lambda: ch(lambda lf, t, c, r: (lf + c) // 2), lambda: ch(lambda lf, t, c, r: (lf + t) // 2),
        lambda: ch(lambda lf, t, c, r: (c + t) // 2), lambda: ch(lambda lf, t, c, r: (t + r) // 2), lambda: ch(lambda lf, t, c, r: ((lf + c) // 2 + (t + r) // 2) // 2), None,
        lambda: ch(lambda lf, t, c, r: clip(lf + t - c)), lambda: ch(lambda lf, t, c, r: clip((lf + t) // 2 + cut((lf + t) // 2 - c))),
    ][mode]()


def plain_mode(rows, bits, tx, ty):
    flat, w = [v for row in rows for v in row], len(rows[0])
    at = [y * w + x for y in range(1, len(rows)) if y >> bits == ty for x in range(1, w) if x >> bits == tx]
    costs = []
    for mode in range(14):
        cost = 0
        for s in (0, 8, 16, 24):
            counts = {}
            for i in at:
                d = ((flat[i] >> s & 255) - (plain_guess(mode, flat[i - 1], flat[i - w], flat[i - w - 1], flat[i - w + 1]) >> s & 255)) % 256
                counts[d] = counts.get(d, 0) + 1
            cost += (len(at) * plain_log(len(at)) - sum(n * plain_log(n) for n in counts.values())) >> 16
        costs.append((cost, mode))
    return min(costs)[1]


def test_predictor_modes_and_residuals(spark):
    imgs = images(3, [(9, 7), (1, 6), (6, 1), (5, 5)]) | {7: [[0xFF224466] * 8] * 8, 8: [[0xFF000000 + (x * 3 + y * 5) * 0x10101 for x in range(9)] for y in range(9)]}
    px = table(spark, imgs)
    found = transforms.predictor_modes(px, 2)
    got = {(r["img"], r["tx"], r["ty"]): r["mode"] for r in found.collect()}
    assert got == {k: plain_mode(imgs[k[0]], 2, k[1], k[2]) for k in got} and len(got) == 6 + 2 + 2 + 4 + 4 + 9
    want = []
    for img, rows in imgs.items():
        flat, w = [v for row in rows for v in row], len(rows[0])
        for i, v in enumerate(flat):
            y, x = divmod(i, w)
            guess = 0xFF000000 if i == 0 else flat[i - 1] if y == 0 else flat[i - w] if x == 0 else plain_guess(got[img, x >> 2, y >> 2], flat[i - 1], flat[i - w], flat[i - w - 1], flat[i - w + 1])
            want.append((img, x, y, sum(((v >> s & 255) - (guess >> s & 255)) % 256 << s for s in (0, 8, 16, 24))))
    assert sorted(map(tuple, transforms.predicted(px, found, 2).collect())) == sorted(want)


def fraction(a, b):
    return ((a << 32) // b) & 0xFFFFFFFF


def product(a, b):
    return (a * b + (1 << 31)) >> 32


def plain_row(v, to):
    """A row of another length, times the old length (or one less than the new): a walk that keeps a remainder."""
    n, out, carry, rest, i = len(v), [], 0, 0, 0
    if n < to:
        rest = to - 1
        for _ in range(to):
            right = v[min(i + 1, n - 1)]
            out.append(right * (to - 1) + (v[i] - right) * rest)
            rest -= n - 1
            if rest < 0:
                i, rest = i + 1, rest + to - 1
        return out
    for _ in range(to):
        rest, total, last = rest + n, carry, 0
        while rest > 0:
            rest, last, i = rest - to, v[i], i + 1
            total += last
        out.append(total * to - last * -rest)
        carry = product(last * -rest, fraction(1, to))
    return out


def plain_plane(rows, to_w, to_h):
    w, h = len(rows[0]), len(rows)
    wide, lines, out, y = (to_w - 1 if w < to_w else w), [plain_row(r, to_w) for r in rows], [], -1
    if h < to_h:
        rest = to_h - 1
        for _ in range(to_h):
            while y < 0 or rest > 0:
                y, rest = y + 1, rest - (to_h - 1)
            b = fraction(-rest, to_h - 1)
            mixed = [(((1 << 32) - b) * lines[y][x] + (b * lines[y - 1][x] if rest else 0) + (1 << 31)) >> 32 for x in range(to_w)]
            out.append([min(255, product(m, fraction(1, wide))) for m in mixed])
            rest += h - 1
        return out
    scale, rest, kept = (to_h << 32) // (wide * h), h, [0] * to_w
    for _ in range(to_h):
        while rest > 0:
            y, rest = y + 1, rest - to_h
            kept = [(a + b) & 0xFFFFFFFF for a, b in zip(kept, lines[y], strict=True)]
        over = [(v * ((fraction(1, to_h) * -rest) & 0xFFFFFFFF)) >> 32 for v in lines[y]]
        out.append([min(255, product(a - b, scale)) if scale < 1 << 32 else (a - b) & 255 for a, b in zip(kept, over, strict=True)])
        kept, rest = over, rest + h
    return out


SIZES = [(9, 7, 4, 3), (9, 7, 9, 7), (5, 4, 13, 11), (5, 9, 12, 2), (8, 3, 3, 10), (1, 1, 5, 4), (1, 6, 1, 4), (1, 5, 2, 5), (6, 1, 1, 1), (7, 7, 2, 9), (16, 16, 5, 5), (3, 2, 4, 3), (2, 2, 3, 1), (10, 1, 4, 6)]


def test_resize_of_any_ratio(spark):
    imgs = {i: [[v | 0xFF000000 for v in row] for row in rows] for i, rows in images(5, [s[:2] for s in SIZES]).items()}
    sizes = spark.createDataFrame([(i, *s) for i, s in enumerate(SIZES)], "img int, width int, height int, to_width int, to_height int")
    got = {}
    for r in pixels.resized(table(spark, imgs), sizes).collect():
        got.setdefault(r["img"], {})[r["x"], r["y"]] = r["argb"]
    for i, (_, _, w, h) in enumerate(SIZES):
        planes = {s: plain_plane([[v >> s & 255 for v in row] for row in imgs[i]], w, h) for s in (0, 8, 16, 24)}
        assert set(got[i]) == {(x, y) for x in range(w) for y in range(h)}, SIZES[i]
        for (x, y), v in got[i].items():
            a = planes[24][y][x]
            if a == 255:  # else colours are restored from what alpha took away
                assert v == sum(planes[s][y][x] << s for s in (0, 8, 16, 24)), (SIZES[i], x, y)
            else:
                assert v >> 24 == a, (SIZES[i], x, y)


def test_resize_weighs_colours_by_alpha(spark):
    px = table(spark, {0: [[0xFFFF0000, 0x0000FF00]], 1: [[0x80FF0000, 0x80FF0000]]})
    sizes = spark.createDataFrame([(0, 2, 1, 1, 1), (1, 2, 1, 1, 1), (5, 1, 1, 2, 2)], "img int, width int, height int, to_width int, to_height int")
    got = {r["img"]: r["argb"] for r in pixels.resized(px, sizes).collect()}
    assert got[0] >> 16 == 0x80FF and got[0] & 0xFFFF == 0 and got[1] == 0x80FF0000 and set(got) == {0, 1}


@pytest.mark.parametrize("size", [(1, 1), (2, 2), (5, 4), (6, 7), (1, 6), (7, 1)])
def test_chroma_is_blended_from_four_neighbours(spark, size):
    w, h = size
    rng = random.Random(w * 10 + h)
    cw, chh = (w + 1) // 2, (h + 1) // 2
    y = [[rng.randrange(256) for _ in range(w)] for _ in range(h)]
    u, v = ([[rng.randrange(256) for _ in range(cw)] for _ in range(chh)] for _ in range(2))
    luma = spark.createDataFrame([(0, i, j, y[j][i]) for j in range(h) for i in range(w)], "img int, x int, y int, v int")
    chroma = spark.createDataFrame([(0, i, j, u[j][i], v[j][i]) for j in range(chh) for i in range(cw)], "img int, x int, y int, u int, v int")

    def row(plane, j):
        near, far = (0, 0) if j == 0 else ((j - 1) // 2, min((j + 1) // 2, chh - 1)) if j % 2 else (j // 2, j // 2 - 1)
        n, f, out = plane[near], plane[far], [0] * w
        out[0] = (3 * n[0] + f[0] + 2) >> 2
        for k in range(1, (w - 1) // 2 + 1):
            out[2 * k - 1] = (((n[k - 1] + 3 * n[k] + 3 * f[k - 1] + f[k] + 8) >> 3) + n[k - 1]) >> 1
            out[2 * k] = (((3 * n[k - 1] + n[k] + f[k - 1] + 3 * f[k] + 8) >> 3) + n[k]) >> 1
        if w % 2 == 0:
            out[w - 1] = (3 * n[(w - 1) // 2] + f[(w - 1) // 2] + 2) >> 2
        return out

    def rgb(a, b, c):
        k, clip = a * 19077 >> 8, lambda n: max(0, min(255, n >> 6))
        return 0xFF000000 | clip(k + (c * 26149 >> 8) - 14234) << 16 | clip(k - (b * 6419 >> 8) - (c * 13320 >> 8) + 8708) << 8 | clip(k + (b * 33050 >> 8) - 17685)

    want = {(i, j): rgb(y[j][i], row(u, j)[i], row(v, j)[i]) for j in range(h) for i in range(w)}
    assert {(r["x"], r["y"]): r["argb"] for r in pixels.upsampled(luma, chroma).collect()} == want


def plain_segments(values, most):
    low, high = min(values), max(values)
    if low == high or most < 2:
        return [(0, sum(values) // len(values) if low != high else low)] * len(values)
    centres = [low + (high - low) * k // (most - 1) for k in range(most)]
    near = lambda v: min(range(most), key=lambda k: (abs(v - centres[k]), k))
    for _ in range(6):
        spots, moved = [near(v) for v in values], 0
        for k in range(most):
            own = [v for v, s in zip(values, spots, strict=True) if s == k]
            if own:
                moved += abs(sum(own) // len(own) - centres[k])
                centres[k] = sum(own) // len(own)
        if moved < 5:
            break
    spots = [near(v) for v in values]
    used = sorted(set(spots))
    mean = lambda k: sum(v for v, s in zip(values, spots, strict=True) if s == k) // spots.count(k)
    return [(used.index(s), mean(s)) for s in spots]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_segments_are_clusters_of_activity(spark, most):
    rng = random.Random(most)
    grids = {i: [[rng.choice([rng.randrange(256), 10, 200]) for _ in range(w)] for _ in range(h)] for i, (w, h) in enumerate([(6, 5), (3, 3), (1, 4), (2, 2)])} | {8: [[7] * 4] * 4}
    rows = [(i, x, y, v) for i, g in grids.items() for y, r in enumerate(g) for x, v in enumerate(r)]
    found = lossy.smoothed(lossy.segmented(spark.createDataFrame(rows, "img int, mx int, my int, activity int"), most)).collect()
    got = {(r["img"], r["mx"], r["my"]): (r["segment"], r["centre"], r["smooth"]) for r in found}
    for i, g in grids.items():
        flat, w, h = [v for r in g for v in r], len(g[0]), len(g)
        plain = plain_segments(flat, most)
        for n, (segment, centre) in enumerate(plain):
            y, x = divmod(n, w)
            around = [plain[b * w + a][0] for b in (y - 1, y, y + 1) for a in (x - 1, x, x + 1) if (a, b) != (x, y) and 0 <= a < w and 0 <= b < h]
            vote = next((s for s in range(4) if around.count(s) >= 5), segment) if len(around) == 8 else segment
            assert got[i, x, y] == (segment, centre, vote), (i, x, y)


def test_activity_of_flat_and_busy_blocks(spark):
    rng = random.Random(4)
    value = {0: lambda x, y: 77, 1: lambda x, y: rng.randrange(256), 2: lambda x, y: (x % 2) * 255}
    rows = [(i, x, y, f(x, y)) for i, f in value.items() for y in range(16) for x in range(16)]
    got = {r["img"]: r["activity"] for r in lossy.macroblock_activity(spark.createDataFrame(rows, "img int, x int, y int, v int")).collect()}
    assert got[0] == 0 and got[1] == 255 and 0 < got[2] <= 255


def plain_levels(values, levels):
    seen = sorted(set(values))
    if len(seen) <= levels:
        return dict(zip(seen, seen, strict=True))
    low, high = seen[0], seen[-1]
    half = lambda n, d: (n + d // 2) // d
    centres, spot = [(low << 16) + half((high - low) * i << 16, levels - 1) for i in range(levels)], {}
    for _ in range(6):
        slot = 0
        for v in seen:
            while slot + 1 < levels and v << 17 > centres[slot] + centres[slot + 1]:
                slot += 1
            spot[v] = slot
        for i in range(levels):
            own = [v for v in values if spot[v] == i]
            if own:
                centres[i] = half(sum(own) << 16, len(own))
    return {v: max(0, min(255, (centres[spot[v]] + 32768) >> 16)) for v in seen}


@pytest.mark.parametrize("levels", [2, 5, 40, 256])
def test_alpha_levels_are_clusters_of_values(spark, levels):
    rng = random.Random(levels)
    planes = {0: [rng.randrange(256) for _ in range(300)], 1: [rng.choice([0, 255, 30, 31, 32]) for _ in range(50)], 2: [9] * 4, 3: [int(rng.gauss(128, 30)) % 256 for _ in range(400)]}
    table = spark.createDataFrame([(i, x, 0, v) for i, vs in planes.items() for x, v in enumerate(vs)], "img int, x int, y int, v int")
    got = {(r["img"], r["x"]): r["v"] for r in lossy.quantised_alpha(table, levels).collect()}
    assert got == {(i, x): plain_levels(vs, levels)[v] for i, vs in planes.items() for x, v in enumerate(vs)}
    assert all(len({got[i, x] for x in range(len(vs))}) <= max(levels, 1) for i, vs in planes.items())


def test_frame_plans(spark):
    base = [[1] * 6 for _ in range(4)]
    changed = [row[:] for row in base]
    changed[3][5] = changed[1][3] = 9
    shown = [base, base, changed, changed, base, base, changed]
    rows = [(0, i, x, y, v) for i, f in enumerate(shown) for y, row in enumerate(f) for x, v in enumerate(row)]
    frames = spark.createDataFrame(rows, "img int, frame_idx int, x int, y int, argb long")
    box, keep, whole = (2, 0, 4, 4), (0, 0, 1, 1), (0, 0, 6, 4)
    plan = lambda **k: [tuple(r)[2:] for r in sorted(animation.frame_plan(frames, **k).collect())]
    assert plan() == [("key", *whole), ("keep", *keep), ("delta", *box), ("keep", *keep), ("delta", *box), ("keep", *keep), ("delta", *box)]
    assert [p[0] for p in plan(kmax=2)] == ["key", "keep", "delta", "key", "delta", "keep", "key"]
    assert plan(kmax=2)[3][1:] == whole and [p[0] for p in plan(kmin=5, kmax=2)] == ["key", "keep", "delta", "keep", "delta", "keep", "key"]


def plain_lengths(counts, limit):
    floor = 1
    if len(counts) == 1:
        return [1]
    while True:
        pool = [(max(n, floor), i, [i]) for i, n in enumerate(counts)]
        depth, made = [0] * len(counts), len(counts)
        while len(pool) > 1:
            pool.sort(key=lambda t: t[:2])
            (a, _, s), (b, _, t), *pool = pool
            for leaf in s + t:
                depth[leaf] += 1
            pool.append((a + b, made, s + t))
            made += 1
        if max(depth) <= limit:
            return depth
        floor *= 2


@pytest.mark.parametrize("limit", [5, 7, 15])
def test_code_lengths_are_limited_and_complete(spark, limit):
    rng = random.Random(limit)
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    tables = {0: [5], 1: [3, 9], 2: fib, 3: [rng.randrange(1, 50) for _ in range(32)], 4: [7] * 16}
    rows = [(i, 10 * s, n) for i, ns in tables.items() for s, n in enumerate(ns)] + [(0, 5, 0), (9, 1, 0)]
    tables = {i: ns for i, ns in tables.items()}
    got = {}
    for r in transforms.code_lengths(spark.createDataFrame(rows, "img int, symbol int, n int"), limit).collect():
        got.setdefault(r["img"], []).append((r["symbol"], r["n"], r["length"]))
    assert set(got) == set(tables)
    for i, ns in tables.items():
        assert [x[2] for x in sorted(got[i])] == plain_lengths(ns, limit)
        assert sum(2 ** (limit - x[2]) for x in got[i]) == (2**limit if len(ns) > 1 else 2 ** (limit - 1))


def test_code_lengths_need_room(spark):
    with pytest.raises(Exception, match="need codes of more than 2 bits"):
        transforms.code_lengths(spark.createDataFrame([(0, s, 1) for s in range(5)], "img int, symbol int, n int"), 2).collect()


def test_readers_tell_what_is_wrong(spark):
    bmp = lambda bits, w, h, body, packed=0: b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + b"\1\0" + bits.to_bytes(2, "little") + packed.to_bytes(4, "little") + bytes(20) + body
    files = {
        "a.ppm": (b"P6\n1 1\n255\n\1\2\3", "ppm", None), "cut.ppm": (b"P6\n2 2\n255\n\1\2\3", "ppm", "truncated"), "deep.ppm": (b"P6 1 1 65535 " + bytes(6), "ppm", "unsupported"), "zero.ppm": (b"P6 0 1 255 \1", "ppm", "invalid_dimensions"), "bad.ppm": (b"P6 a", "ppm", "bad_header"), "vast.ppm": (b"P6 999999 999999 255 \1", "ppm", "limit_exceeded"),
        "gray.pgm": (b"P5\n# g\n2 1\n255\n\5\xff", "ppm", None), "x.pam": (b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 2\nMAXVAL 255\nENDHDR\n\1\2", "pam", "unsupported"), "half.pam": (b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nENDHDR\n\1\2", "pam", "truncated"), "no.pam": (b"P7\nWIDTH 1\nENDHDR\n", "pam", "bad_header"),
        "clear.bmp": (bmp(32, 2, 1, b"\1\2\3\0\4\5\6\0"), "bmp", None), "alpha.bmp": (bmp(32, 2, -1, b"\1\2\3\0\4\5\6\x80"), "bmp", None), "eight.bmp": (bmp(8, 1, 1, b"\1\2\3\4"), "bmp", "unsupported"), "packed.bmp": (bmp(32, 1, 1, b"\1\2\3\4", 1), "bmp", "unsupported"), "short.bmp": (b"BM12", "bmp", "bad_header"), "cut.bmp": (bmp(24, 3, 3, b"\1"), "bmp", "truncated"),
        "x.txt": (b"hello", "raw", "unknown_format"), "none": (None, None, "unknown_format"), "empty": (b"", "raw", "unknown_format"),
    }
    table = spark.createDataFrame([(p, c) for p, (c, _, _) in files.items()], "path string, content binary")
    assert {r["path"]: (r["format"], r["error"]) for r in images_io.read_errors(table).collect()} == {p: (f, e) for p, (_, f, e) in files.items()}
    assert {(r["img"], r["x"], r["y"]): r["argb"] for r in images_io.any_pixels(table).collect()} == {
        ("a.ppm", 0, 0): 0xFF010203, ("gray.pgm", 0, 0): 0xFF050505, ("gray.pgm", 1, 0): 0xFFFFFFFF, ("clear.bmp", 0, 0): 0xFF030201, ("clear.bmp", 1, 0): 0xFF060504, ("alpha.bmp", 0, 0): 0x00030201, ("alpha.bmp", 1, 0): 0x80060504,
    }


def test_lossy_arithmetic_keeps_nulls(spark):
    row = spark.createDataFrame([(None, 50, None, True)], "q int, s int, b int, f boolean")
    q, s, b, f = (F.col(c) for c in "qsbf")
    got = row.select(lossy.quantiser(q).alias("quantiser"), lossy.alpha_levels(q).alias("levels"), lossy.steps(q)["y2_ac"].alias("step"), lossy.filter_level(q, s).alias("level"), lossy.filter_level(s, s, b).alias("biased"), lossy.filter_limits(q, s, f)["edge_limit"].alias("limit"), lossy.quantiser(s, partition_limit=b).alias("limited"), lossy.noise_shaping(q, s).alias("noise")).first()
    assert all(v is None for v in got)


def test_exact_psnr_of_different_sizes_is_null(spark):
    a, b = table(spark, images(1, [(4, 4), (3, 3)])), table(spark, images(2, [(4, 5), (3, 3)]))
    got = {r["img"]: r["centidecibels"] for r in pixels.exact_psnr(a, b).collect()}
    assert got[0] is None and got[1] > 0


def test_metadata_lists_are_folded_from_the_left(spark):
    lists = {None: "111", "": "111", " , ": "111", "none": "000", "icc": "100", "icc,xmp": "101", "all,none": "000", "none, EXIF": "010", "exif,none,xmp": "001", "icc,all": "111", "icc,gps": "000"}
    table = spark.createDataFrame([(k,) for k in lists], "fields string").select("fields", container.selection(F.col("fields")).alias("s"))
    for r in table.collect():
        assert "".join(str(int(r["s"][n])) for n in ("icc", "exif", "xmp")) == lists[r["fields"]] and r["s"]["error"] == ("unknown_field" if r["fields"] == "icc,gps" else None)


def test_lossy_tiers(spark):
    rows = [(None, 1 << 20, "best"), (None, (1 << 20) + 1, "full"), (None, 1 << 24, "full"), (None, (1 << 24) + 1, "fast"), (0, 1, "fast"), (2, 1, "fast"), (3, 1, "full"), (7, None, "full"), (8, 1 << 30, "best"), (None, None, None)]
    table = spark.createDataFrame(rows, "level int, pixels long, want string")
    assert all(r["want"] == r["got"] for r in table.withColumn("got", batch.lossy_tier(F.col("level"), F.col("pixels"))).collect())


def plain_groups(rows):
    w, h = len(rows[0]), len(rows)
    up = lambda n, k: (n + (1 << k) - 1) >> k
    bits = next((k for k in range(2, 10) if up(w, k) * up(h, k) <= 256), None)
    blocks = {}
    for y, row in enumerate(rows):
        for x, v in enumerate(row):
            blocks.setdefault((y >> bits, x >> bits), []).append(v)
    keys = sorted(blocks)

    def cost(values):
        total = 0
        for s in (0, 8, 16, 24):
            counts = {}
            for v in values:
                counts[v >> s & 255] = counts.get(v >> s & 255, 0) + 1
            total += (len(values) * plain_log(len(values)) - sum(n * plain_log(n) for n in counts.values())) >> 16
            total += 24 + 3 * len(counts) if len(counts) > 1 else 0
        return total

    sets, members = [list(blocks[k]) for k in keys], [{i} for i in range(len(keys))]
    alive = set(range(len(keys)))
    while True:
        best = min(((cost(sets[a] + sets[b]) - cost(sets[a]) - cost(sets[b]), a, b) for a in alive for b in alive if a < b), default=(0,))
        if best[0] >= 0:
            break
        _, a, b = best
        sets[a], members[a] = sets[a] + sets[b], members[a] | members[b]
        alive.remove(b)
    order = sorted(alive)
    return {keys[i]: (bits, order.index(g)) for g in alive for i in members[g]}


def test_block_groups(spark):
    rng = random.Random(8)
    noisy = [[0xFF000000 | rng.randrange(1 << 24) for _ in range(17)] for _ in range(9)]
    halves = [[(0xFF000000 if x < 12 else 0xFFF0F0F0) | rng.randrange(4) * 0x010101 for x in range(24)] for _ in range(10)]
    imgs = {0: noisy, 1: halves, 2: [[5] * 12] * 12, 3: [[7]]}
    got = {}
    for r in transforms.block_groups(table(spark, imgs)).collect():
        got.setdefault(r["img"], {})[r["by"], r["bx"]] = (r["bits"], r["group"])
    assert got == {i: plain_groups(rows) for i, rows in imgs.items()}
    assert len({g for _, g in got[1].values()}) >= 1
