"""Animations as tables of frames: reading, editing, writing, planning and compositing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.functions import argb, riff
from rastra.functions.bits import le_bytes
from rastra.operators.container import chunk_bytes, chunks, described, first_chunk

#: The largest sum of durations that is reported.
MAX_DURATION = (1 << 32) - 1
FRAME = ("frame_idx", "x", "y", "width", "height", "duration_ms", "blend", "dispose", "payload")


def frames(files: DataFrame) -> DataFrame:
    """(path, frame_idx, x, y, width, height, duration_ms, blend, dispose, payload), one row for each whole ANMF chunk; payload is what follows its header."""
    found = chunks(files).where("fourcc = 'ANMF'").select("path", "idx", riff.read_anmf(F.col("payload")).alias("f"), F.expr(f"substring(payload, {riff.FRAME_HEADER + 1})").alias("payload")).where("f is not null")
    order = Window.partitionBy("path").orderBy("idx")
    return found.select("path", (F.row_number().over(order) - 1).alias("frame_idx"), "f.*", "payload").select("path", *FRAME)


def animations(files: DataFrame) -> DataFrame:
    """(path, canvas_w, canvas_h, background, loop_count, frame_count, total_duration_ms) of each animated file."""
    head = chunks(files).withColumn("head", F.substring("payload", 1, 16))
    first = lambda fourcc: F.min_by(F.when(F.col("fourcc") == fourcc, F.col("head")), F.when(F.col("fourcc") == fourcc, F.col("idx")))
    frame = riff.read_anmf(F.when(F.col("fourcc") == "ANMF", F.col("head")))
    per_file = head.groupBy("path").agg(riff.read_vp8x(first("VP8X")).alias("x"), riff.read_anim(first("ANIM")).alias("a"), F.count(frame).alias("frame_count"), F.coalesce(F.sum(frame["duration_ms"]), F.lit(0)).alias("total"))
    return per_file.where("x.is_animated and a is not null").select("path", F.col("x.width").alias("canvas_w"), F.col("x.height").alias("canvas_h"), "a.background", "a.loop_count", "frame_count", F.least("total", F.lit(MAX_DURATION)).alias("total_duration_ms"))


def codecs(files: DataFrame) -> DataFrame:
    """(path, codec): lossless, lossy or mixed over all frames; unknown if a frame starts with neither kind of image (after its alpha)."""
    inner = frames(files).select("path", F.explode_outer(riff.places(F.col("payload"), start=0, lenient=True)).alias("c"), "frame_idx")
    per_frame = inner.groupBy("path", "frame_idx").agg(F.min_by(F.when(F.col("c.fourcc").isin("VP8L", "VP8 "), F.col("c.fourcc")), F.when(F.col("c.fourcc").isin("VP8L", "VP8 "), F.col("c.idx"))).alias("f"))
    has = lambda x: F.bool_or(F.col("f").eqNullSafe(F.lit(x)))
    kind = F.when(has(None), "unknown").when(has("VP8L") & has("VP8 "), "mixed").when(has("VP8L"), "lossless").otherwise("lossy")
    return per_frame.groupBy("path").agg(kind.alias("codec"))


def reindexed(rows: DataFrame) -> DataFrame:
    """Frames with their indexes closed up, in the order of frame_idx; ``rank`` breaks ties if there is such a column."""
    order = ["frame_idx", *(["rank"] if "rank" in rows.columns else [])]
    return rows.withColumn("frame_idx", F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1).drop("rank")


def without_frame(rows: DataFrame, index: int) -> DataFrame:
    return reindexed(rows.where(F.col("frame_idx") != index))


def with_frame(rows: DataFrame, new: DataFrame, index: int) -> DataFrame:
    """Frames with those of ``new`` (one for each path) inserted before ``index``."""
    return reindexed(rows.withColumn("rank", F.lit(1)).unionByName(new.withColumns({"frame_idx": F.lit(index), "rank": F.lit(0)})))


def replaced_frame(rows: DataFrame, new: DataFrame, index: int) -> DataFrame:
    return rows.where(F.col("frame_idx") != index).unionByName(new.withColumn("frame_idx", F.lit(index)))


def write(rows: DataFrame, loop_count: int = 0, background: int = 0, alpha: bool = True) -> DataFrame:
    """(path, content): one animated file for each path of a frame table; the canvas is the smallest that holds all frames."""
    one = riff.anmf(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("duration_ms"), F.col("blend") == "blend", F.col("dispose") == "background", F.col("payload"))
    framed = rows.select("path", "frame_idx", "x", "y", "width", "height", one.alias("anmf"))
    per_file = framed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("frame_idx", riff.chunk("ANMF", F.col("anmf")).alias("b")))).alias("f"), F.max(F.col("x") + F.col("width")).alias("w"), F.max(F.col("y") + F.col("height")).alias("h"))
    head = riff.chunk("VP8X", riff.vp8x(F.lit(riff.ANIMATION + riff.ALPHA * alpha), F.col("w"), F.col("h")))
    # As hex digits, which are joined in one go; a fold would copy the growing body for each frame.
    body = F.concat(head, riff.chunk("ANIM", riff.anim(F.lit(background), F.lit(loop_count))), F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["b"])), "")))
    return per_file.select("path", body.alias("body")).select("path", riff.envelope(F.col("body")).alias("content"))


def as_stills(rows: DataFrame) -> DataFrame:
    """(path, frame_idx, content): each frame as a file of its own, its image's bytes unchanged; null content without an image.

    Of repeated chunks the first counts. A lossless image makes a simple file; a lossy one with alpha an extended file of the frame's size.
    """
    walked = rows.select("path", "frame_idx", "width", "height", F.col("payload").alias("content"), riff.places(F.col("payload"), start=0).alias("places"))
    image = F.get(F.filter("places", lambda c: c["fourcc"].isin("VP8L", "VP8 ")), F.lit(0))
    cut = walked.select("path", "frame_idx", "width", "height", image["fourcc"].alias("kind"), chunk_bytes(image).alias("image"), chunk_bytes(first_chunk("ALPH")).alias("alpha"))
    head = riff.chunk("VP8X", riff.vp8x(F.lit(riff.ALPHA), F.col("width"), F.col("height")))
    lossy = F.concat(F.when(F.col("alpha").isNotNull(), head).otherwise(F.lit(b"")), riff.chunk("ALPH", F.col("alpha")), riff.chunk("VP8 ", F.col("image")))
    body = F.when(F.col("kind") == "VP8L", riff.chunk("VP8L", F.col("image"))).when(F.col("kind") == "VP8 ", lossy)
    return cut.select("path", "frame_idx", body.alias("body")).select("path", "frame_idx", riff.envelope(F.col("body")).alias("content"))


def from_stills(files: DataFrame, x: Column, y: Column, duration_ms: Column, blend: Column, dispose: Column) -> DataFrame:
    """(path, x, y, width, height, duration_ms, blend, dispose, payload, error): still files as frames, their image's bytes unchanged.

    The columns are expressions over ``files``. error is invalid_frame (odd or negative offsets, a duration beyond 24 bits, or nulls among
    them), that of ``container.images``, unsupported_feature (an animation) or null; with an error the payload is null.
    """
    options = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), duration_ms.cast("long").alias("duration_ms"), blend.alias("blend"), dispose.alias("dispose"))
    parts = {name: chunk_bytes(first_chunk(fourcc)) for name, fourcc in (("_l", "VP8L"), ("_v", "VP8 "), ("_a", "ALPH"))}
    found = described(files.select("path", "content", options.alias("options")), ("options",), parts)
    o = lambda name: F.col(f"options.{name}")
    fine = (o("x") >= 0) & (o("y") >= 0) & (o("x") % 2 == 0) & (o("y") % 2 == 0) & o("duration_ms").between(0, (1 << 24) - 1)
    error = F.when(~F.coalesce(fine, F.lit(False)), "invalid_frame").when(F.col("error").isNotNull(), F.col("error")).when(F.col("is_animated"), "unsupported_feature").when(F.coalesce("_l", "_v").isNull(), "missing_image")
    body = F.when(F.col("_l").isNotNull(), riff.chunk("VP8L", F.col("_l"))).otherwise(F.concat(riff.chunk("ALPH", F.col("_a")), riff.chunk("VP8 ", F.col("_v"))))
    made = found.select("path", "options", "width", "height", error.alias("error"), body.alias("body"))
    size = lambda c: F.col(c).cast("long").alias(c)
    return made.select("path", "options.x", "options.y", size("width"), size("height"), "options.duration_ms", "options.blend", "options.dispose", F.when(F.col("error").isNull(), F.col("body")).alias("payload"), "error")


def with_settings(files: DataFrame, loop_count: Column | None = None, background: Column | None = None) -> DataFrame:
    """(path, content): animated files with another loop count or background colour (expressions over ``files``; null or none: as it was).

    Everything else keeps its bytes; files without an ANIM chunk are returned as they are. Nothing is shuffled.
    """
    none = F.lit(None).cast("long")
    asked = files.select("path", "content", (none if loop_count is None else loop_count).alias("loops"), (none if background is None else background).alias("colour"), riff.places(F.col("content")).alias("places"))
    # The old bytes are taken over as they are, not read and written again.
    placed = asked.select("path", "content", "loops", "colour", F.get(F.filter("places", lambda c: (c["fourcc"] == "ANIM") & (c["size"] >= 6)), F.lit(0))["payload_start"].cast("int").alias("at"))
    bytes_at = lambda skip, n: F.substring(F.col("content"), F.col("at") + 1 + skip, F.lit(n))
    new = F.concat(F.coalesce(le_bytes(F.col("colour"), 4), bytes_at(0, 4)), F.coalesce(le_bytes(F.col("loops"), 2), bytes_at(4, 2)))
    content = F.concat(F.substring(F.col("content"), F.lit(1), F.col("at")), new, F.expr("substring(content, at + 7)"))
    return placed.select("path", F.when(F.col("at").isNull(), F.col("content")).otherwise(content).alias("content"))


def changed_boxes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(img, x, y, width, height) around the pixels in which two pixel tables differ, the corner at even places; equal images have no row."""
    both = now.alias("n").join(before.alias("p"), ["img", "x", "y"]).where(F.col("n.argb") != F.col("p.argb"))
    box = both.groupBy("img").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    even = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(2))
    return box.select("img", even("x0").alias("x"), even("y0").alias("y"), (F.col("x1") - even("x0") + 1).alias("width"), (F.col("y1") - even("y0") + 1).alias("height"))


def frame_plan(frames: DataFrame, kmin: int = 0, kmax: int = 0) -> DataFrame:
    """(img, frame_idx, kind, x, y, width, height) for animations of full-canvas frames (img, frame_idx, x, y, argb): how each is to be stored.

    The first frame is a key frame, and with ``kmax`` over 0 one after every max(kmin, kmax) others. Other frames hold the changed box, its corner at even places (delta), or
    one pixel if nothing changed (keep). Frames are numbered without gaps; each meets the one before it by place, in one join.
    """
    cadence = max(kmin, kmax) + 1 if kmax > 0 else 0
    key = (F.col("frame_idx") == 0) if not cadence else F.pmod("frame_idx", F.lit(cadence)) == 0
    before = frames.select("img", (F.col("frame_idx") + 1).alias("frame_idx"), "x", "y", F.col("argb").alias("was"))
    both = frames.join(before, ["img", "frame_idx", "x", "y"], "left").withColumn("changed", key | F.coalesce(F.col("argb") != F.col("was"), F.lit(True)))
    edge = lambda f, c: f(F.when(F.col("changed"), F.col(c)))
    box = both.groupBy("img", "frame_idx").agg(edge(F.min, "x").alias("x0"), edge(F.min, "y").alias("y0"), edge(F.max, "x").alias("x1"), edge(F.max, "y").alias("y1"))
    even = lambda c: F.coalesce(F.col(c) - F.pmod(F.col(c), F.lit(2)), F.lit(0))
    kind = F.when(key, "key").when(F.col("x0").isNull(), "keep").otherwise("delta")
    size = lambda a, b: F.coalesce(F.col(b) - even(a), F.lit(0)) + 1
    return box.select("img", "frame_idx", kind.alias("kind"), even("x0").alias("x"), even("y0").alias("y"), size("x0", "x1").alias("width"), size("y0", "y1").alias("height"))


def blend_deltas(now: DataFrame, before: DataFrame) -> DataFrame:
    """(img, x, y, argb, valid): unchanged pixels become transparent; valid tells of the image whether all changed ones are opaque, so that blending restores it."""
    same = F.col("n.argb") == F.col("p.argb")
    both = now.alias("n").join(before.alias("p"), ["img", "x", "y"]).select("img", "x", "y", F.when(same, F.lit(0).cast("long")).otherwise(F.col("n.argb")).alias("argb"), (same | (argb.channel(F.col("n.argb"), "a") == 255)).alias("fine"))
    return both.join(both.groupBy("img").agg(F.bool_and("fine").alias("valid")), "img").drop("fine")


def disposals(now: DataFrame, following: DataFrame, canvas: tuple[int, int] | None = None) -> DataFrame:
    """(img, dispose): background if the image shows something and the next one is transparent in the same place, else keep.

    Given the ``canvas`` (width, height), images that fill it are kept whatever follows; without it all are taken for parts.
    """
    a = lambda t: argb.channel(F.col(f"{t}.argb"), "a")
    both = now.alias("n").join(following.alias("f"), ["img", "x", "y"], "left")
    clear = F.bool_and(F.coalesce(a("f") == 0, F.lit(False)))
    part = F.lit(True) if canvas is None else F.count("*") < canvas[0] * canvas[1]
    return both.groupBy("img").agg(F.when(part & F.bool_or(a("n") > 0) & clear, "background").otherwise("keep").alias("dispose"))


def last_drawn(pixels: DataFrame) -> DataFrame:
    """(img, x, y, argb): what stays on the canvas when opaque and fully transparent frame pixels (with frame_idx) are drawn in order; no fold is needed for that."""
    drawn = pixels.where(argb.channel(F.col("argb"), "a") > 0)
    return drawn.groupBy("img", "x", "y").agg(F.max_by("argb", "frame_idx").alias("argb"))


def _over(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Source over destination for int64 arrays of 0xAARRGGBB."""
    a, d = src >> 24 & 255, dst >> 24 & 255
    rest = d * (256 - a) >> 8
    total = np.maximum(a + rest, 1)
    scale = (1 << 24) // total
    out = total << 24
    for s in (16, 8, 0):
        out |= (((src >> s & 255) * a + (dst >> s & 255) * rest) * scale >> 24 & 255) << s
    return np.where(a == 255, src, np.where(a == 0, dst, out))


def composited(rows: DataFrame) -> DataFrame:
    """(path, frame_idx, duration_ms, width, height, argb array<long>, error): the canvas after each frame.

    ``rows``: path, frame_idx, x, y, width, height, canvas_w, canvas_h, duration_ms, blend, dispose, has_alpha, argb (array<long>, row by
    row). A disposal to background clears the frame's rectangle before the next frame. Key frames are
    written onto an empty canvas: the first one, a full-canvas one that is opaque or not to be blended, and any after
    a full-canvas or key frame that was disposed. Where a blended frame meets a rectangle that was just
    cleared, its pixels are taken as they are. One animation is folded in one task, since each canvas needs the one before.
    A frame that leaves the canvas or has another number of pixels ends its animation with a row without pixels and the error
    invalid_container; other animations go on.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame_idx")
        w, h = int(group["canvas_w"].iloc[0]), int(group["canvas_h"].iloc[0])
        canvas, out = np.zeros((h, w), np.int64), []
        cleared = None  # the rectangle that the last frame left to be cleared
        key_next = True
        for f in group.itertuples():
            pixels = np.asarray([] if f.argb is None else f.argb, np.int64)
            if min(f.x, f.y, f.width, f.height) < 0 or f.x + f.width > w or f.y + f.height > h or len(pixels) != f.width * f.height:
                out.append((f.path, f.frame_idx, f.duration_ms, w, h, None, "invalid_container"))
                break
            at = np.s_[f.y : f.y + f.height, f.x : f.x + f.width]
            raw = np.zeros((h, w), bool)
            if cleared is not None:
                canvas[cleared] = 0
                raw[cleared] = True
            full = (f.x, f.y, f.width, f.height) == (0, 0, w, h)
            key = key_next or full and (f.blend != "blend" or not f.has_alpha)
            pixels = pixels.reshape(f.height, f.width)
            if key:
                canvas[:] = 0
            if key or f.blend != "blend":
                canvas[at] = pixels
            else:
                canvas[at] = np.where(raw[at], pixels, _over(pixels, canvas[at]))
            out.append((f.path, f.frame_idx, f.duration_ms, w, h, canvas.ravel().copy(), None))
            cleared = at if f.dispose == "background" else None
            key_next = cleared is not None and (full or key)
        return pd.DataFrame(out, columns=["path", "frame_idx", "duration_ms", "width", "height", "argb", "error"])

    kind = dict(rows.dtypes)["path"]
    return rows.groupBy("path").applyInPandas(fold, f"path {kind}, frame_idx int, duration_ms int, width int, height int, argb array<long>, error string")
