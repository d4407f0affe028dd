"""Batch work over many files: formats, names, what to skip, totals, ledgers, and the choice of a quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bytes that formats start with; fixed values.
MAGIC = {
    "png": "89504E470D0A1A0A",
    "jpeg": "FFD8FF",
    "gif": "47494638",
    "tiff": "49492A00|4D4D002A",
    "bmp": "424D",
    "ppm": "5036",
    "pam": "5037",
}
#: Formats by file name.
EXTENSIONS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "ppm": "ppm", "pam": "pam", "raw": "raw", "rgba": "raw", "webp": "webp"}
#: A command's exit codes by kind of outcome; fixed values.
EXIT_CODES = {"success": 0, "predicate": 1, "usage": 2, "read": 3, "write": 4, "codec": 5, "unsupported": 6, "limit": 7, "dimensions": 8, "format": 9}
#: The kind of each error code that the operators here report.
KINDS = {"not_webp": "codec", "truncated": "codec", "missing_image": "codec", "invalid_container": "codec", "size_mismatch": "usage", "unsupported_feature": "unsupported", "limit_exceeded": "limit", "invalid_dimensions": "dimensions", "pixel_buffer_mismatch": "dimensions", "crop_out_of_bounds": "usage", "invalid_frame": "codec", "conflicting_options": "usage"}
#: Search levels of 0 to 9 for the scale of methods 0 to 6; fixed values.
METHOD_LEVELS = (0, 1, 3, 4, 6, 7, 9)


def exit_code(error: Column) -> Column:
    """The exit code for an error code; 0 for none, 5 for an unknown one."""
    codes = F.create_map(*[F.lit(x) for e, kind in KINDS.items() for x in (e, EXIT_CODES[kind])])
    return F.when(error.isNull(), 0).otherwise(F.coalesce(F.try_element_at(codes, error), F.lit(EXIT_CODES["codec"])))


def effort(method: Column, level: Column, quality: Column) -> Column:
    """The search level that options ask for: a method of 0 to 6, else a level of 0 to 9, else a quality of 0 to 100; null (choose by content) if none is given."""
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c))
    by_method = F.element_at(F.array(*map(F.lit, METHOD_LEVELS)), clip(method, 6).cast("int") + 1)
    return F.when(method.isNotNull(), by_method).when(level.isNotNull(), clip(level, 9).cast("int")).when(quality.isNotNull(), clip(F.floor(quality / 10), 9).cast("int"))


def breadth(level: Column) -> Column:
    """struct(tile_bits, cross_colour, optimal_parse, blockwise_codes): what a search level (0 to 9) tries; fixed values."""
    tiles = F.when(level <= 1, F.array(F.lit(4))).when(level == 2, F.array(*map(F.lit, (3, 4)))).when(level == 3, F.array(*map(F.lit, (2, 3, 4)))).otherwise(F.array(*map(F.lit, (2, 3, 4, 5))))
    return F.struct(tiles.alias("tile_bits"), (level >= 1).alias("cross_colour"), (level >= 1).alias("optimal_parse"), (level >= 6).alias("blockwise_codes"))


#: The highest level of the two lower tiers, and the most pixels of the two deeper ones.
TIER_LEVELS, TIER_PIXELS = (2, 7), (1 << 20, 1 << 24)


def lossy_tier(level: Column, pixels: Column) -> Column:
    """How deep a lossy search goes, fast, full or best: by its level (0 to 9), or without one by the image's number of pixels; null if neither is known."""
    by_level = F.when(level <= TIER_LEVELS[0], "fast").when(level <= TIER_LEVELS[1], "full").when(level > TIER_LEVELS[1], "best")
    by_size = F.when(pixels <= TIER_PIXELS[0], "best").when(pixels <= TIER_PIXELS[1], "full").when(pixels > TIER_PIXELS[1], "fast")
    return F.coalesce(by_level, by_size)


def encode_mode(kind: Column, lossless: Column, near_lossless: Column, lossy: Column, quality: Column) -> Column:
    """struct(codec, quality, near_lossless, derived, error): the codec that options ask for; without any, JPEG stays lossy at 75 and the rest lossless.

    lossless and lossy are booleans, near_lossless and quality numbers; null means not given. Options for both codecs are the error conflicting_options.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    exact, loose = yes(lossless) | near_lossless.isNotNull(), yes(lossy) | quality.isNotNull()
    clash, derived = exact & loose, ~exact & ~loose
    codec = F.when(clash, None).when(exact, "lossless").when(loose | (derived & F.coalesce(kind == "jpeg", F.lit(False))), "lossy").otherwise("lossless")
    return F.struct(codec.alias("codec"), F.when(codec == "lossy", F.coalesce(quality, F.lit(75))).cast("int").alias("quality"), F.when(codec == "lossless", near_lossless).cast("int").alias("near_lossless"), derived.alias("derived"), F.when(clash, "conflicting_options").alias("error"))


def strategy(codec: Column, derived: Column, optimise: Column, has_target: Column) -> Column:
    """struct(strategy, error): once, optimise (every lossless level) or search (a quality for a target).

    Optimising goes with neither a target nor a lossy codec that was asked for (one that follows from the input is encoded once);
    a target goes with lossy only. What contradicts is the error conflicting_options.
    """
    lossy = codec == "lossy"
    clash = (optimise & (has_target | (lossy & ~derived))) | (~optimise & has_target & ~lossy)
    choice = F.when(optimise & ~lossy, "optimise").when(has_target, "search").otherwise("once")
    return F.struct(F.when(~clash, choice).alias("strategy"), F.when(clash, "conflicting_options").alias("error"))


def effective(*layers: tuple[str, Column]) -> Column:
    """struct(value, origin) of a setting: the first layer (origin, value) that is not null."""
    value = F.coalesce(*[v for _, v in layers])
    origin = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in layers])
    return F.struct(value.alias("value"), origin.alias("origin"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def format_by_content(content: Column) -> Column:
    """The format that a file's first bytes show; raw if none does."""
    digits = F.hex(F.substring(content, 1, 16))
    out = F.when(digits.rlike("^52494646.{8}57454250"), "webp")
    for name, magic in MAGIC.items():
        out = out.when(digits.rlike(f"^({magic})"), name)
    return out.otherwise("raw")


def file_format(path: Column, content: Column) -> Column:
    """The format by file name, else by content."""
    by_name = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(by_name, extension(path)), format_by_content(content))


def output_name(path: Column, folder: str | None = None, suffix: str = "webp") -> Column:
    """The path with another suffix, in another folder if one is given."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    where = F.lit(f"{folder.rstrip('/')}/") if folder else F.regexp_extract(path, r"^(.*[/\\])", 1)
    return F.concat(where, stem, F.lit(f".{suffix}"))


def numbered_name(stem: Column, index: Column, suffix: str = "png") -> Column:
    return F.concat(stem, F.format_string("-%03d", index.cast("int")), F.lit(f".{suffix}"))


def pending(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Inputs whose output (column output) isn't among the existing paths."""
    return inputs.join(existing.select(F.col("path").alias("output")), "output", "left_anti")


def totals(status: DataFrame) -> DataFrame:
    """One row of counts and bytes over per-file outcomes (outcome: converted, failed or skipped; in_bytes, out_bytes)."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("converted", "failed", "skipped")]
    done = lambda c: F.coalesce(F.sum(F.when(F.col("outcome") == "converted", F.col(c))), F.lit(0)).alias(c)
    return status.agg(*counts, done("in_bytes"), done("out_bytes"))


def ledger_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) for every field that differs between two ledgers; rows in one of them only have field null."""
    both = old.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("n")), key, "full")
    cell = lambda side, f: F.col(f"{side}.{f}").cast("string")
    one_side = F.col("o").isNull() | F.col("n").isNull()
    whole = F.struct(F.lit(None).cast("string").alias("field"), F.when(F.col("o").isNotNull(), "present").alias("before"), F.when(F.col("n").isNotNull(), "present").alias("after"))
    changed = [F.when(~cell("o", f).eqNullSafe(cell("n", f)), F.struct(F.lit(f).alias("field"), cell("o", f).alias("before"), cell("n", f).alias("after"))) for f in fields]
    return both.select(key, F.explode(F.when(one_side, F.array(whole)).otherwise(F.array_compact(F.array(*changed)))).alias("c")).select(key, "c.*")


def best_quality(trials: DataFrame, keys: list[str], max_bytes: Column | None = None, min_psnr: Column | None = None) -> DataFrame:
    """(keys, quality, bytes, psnr, met) from encoding trials (keys, quality, bytes, psnr).

    With a budget the largest quality that fits, with a floor the smallest that reaches it; with both the
    floor wins. met tells whether what was asked for holds; if nothing does, the nearest end of the range is taken.
    """
    fits = F.col("bytes") <= max_bytes if max_bytes is not None else F.lit(True)
    good = F.col("psnr") >= min_psnr if min_psnr is not None else F.lit(True)
    q, row = F.col("quality"), F.struct("quality", "bytes", "psnr")
    small = F.coalesce(F.max_by(F.when(fits, row), F.when(fits, q)), F.min_by(row, q))
    fine = F.coalesce(F.min_by(F.when(good, row), F.when(good, q)), F.max_by(row, q))
    per = trials.groupBy(*keys).agg(small.alias("small"), fine.alias("fine"))
    if min_psnr is None:
        choice = F.col("small")
    elif max_bytes is None:
        choice = F.col("fine")
    else:
        choice = F.when(F.col("fine.quality") > F.col("small.quality"), F.col("fine")).otherwise(F.col("small"))
    met = F.lit(True)
    if max_bytes is not None:
        met = met & (F.col("choice.bytes") <= max_bytes)
    if min_psnr is not None:
        met = met & (F.col("choice.psnr") >= min_psnr)
    return per.select(*keys, choice.alias("choice")).select(*keys, "choice.*", met.alias("met"))


def nearest_name(typed: Column, names: list[str], most: int = 3) -> Column:
    """The known name with the least edit distance, if that is at most ``most``."""
    options = F.array(*[F.struct(F.levenshtein(typed, F.lit(n)).alias("d"), F.lit(n).alias("n")) for n in names])
    best = F.array_min(options)
    return F.when(best["d"] <= most, best["n"])


def size_in_bytes(text: Column) -> Column:
    """A size with an optional k, m or g (times 1024 each); null if it isn't one."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)([kmg]?)$", 1)
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)([kmg]?)$", 2)
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(number != "", number.cast("long") * factor)
