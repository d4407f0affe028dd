"""Pixel, frame and file relations derived from the driver's tables, as Spark plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.functions import argb, riff

#: 8 x 8 images from vectors: colour channels are neighbouring values, every third label is translucent.
PX_SQL = """e AS (SELECT vec_id AS img, label, embedding, unnest(range(0, 64)) AS i FROM embeddings),
v AS (SELECT img, label, i, {}),
px AS (SELECT img, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, label, r, g, b, CASE WHEN label % 3 = 0 THEN a0 ELSE 255 END AS a FROM v)""".format(
    ", ".join(f"least(255, greatest(0, CAST(floor((CAST(embedding[(i + {d}) % 64 + 1] AS DOUBLE) + 1) * 127) AS BIGINT))) AS {c}" for c, d in (("r", 0), ("g", 1), ("b", 8), ("a0", 5))) + " FROM e"
)
ARGB = "(a << 24) | (r << 16) | (g << 8) | b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, argb): PX_SQL in Spark."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    value = lambda d: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.element_at("embedding", (F.pmod(F.col("i") + d, F.lit(64)) + 1).cast("int")).cast("double") + 1) * 127)))
    a = F.when(F.pmod("label", F.lit(3)) == 0, value(5)).otherwise(255)
    return e.select(F.col("vec_id").alias("img"), F.pmod("i", F.lit(8)).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), argb.pack(a, value(0), value(1), value(8)).alias("argb"))


#: Luma planes of 64 x 64 from 64 vectors each, as 8 x 8 tiles; every third tile is flat and every fifth is coarse.
LUMA_SQL = """lu AS (SELECT vec_id // 64 AS img, CAST(vec_id % 8 * 8 + i % 8 AS INT) AS x, CAST(vec_id // 8 % 8 * 8 + i // 8 AS INT) AS y,
  CASE WHEN (vec_id // 2) % 3 = 0 THEN 128 WHEN vec_id % 5 = 0 THEN v // 64 * 64 ELSE v END AS v
  FROM (SELECT vec_id, i, least(255, greatest(0, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127) AS BIGINT))) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)))"""


def luma_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, v): LUMA_SQL in Spark."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).where("i < 64")
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 127)))
    n, div = F.col("vec_id"), lambda c, k: F.call_function("div", c, F.lit(k))
    tile = F.when(F.pmod(div(n, 2), F.lit(3)) == 0, F.lit(128).cast("long")).when(F.pmod(n, F.lit(5)) == 0, div(v, 64) * 64).otherwise(v)
    return e.select(div(n, 64).alias("img"), (F.pmod(n, F.lit(8)) * 8 + F.pmod("i", F.lit(8))).cast("int").alias("x"), (F.pmod(div(n, 8), F.lit(8)) * 8 + div(F.col("i"), 8)).cast("int").alias("y"), tile.alias("v"))


#: Sparse images from order lines: the place is the line's number and the order's, so that no window is needed.
LINES_SQL = """px AS (SELECT l_orderkey // 8 AS img, CAST(l_linenumber - 1 AS INT) AS x, CAST(l_orderkey % 8 AS INT) AS y, l_returnflag AS flag, l_linestatus AS status,
  l_partkey & 255 AS r, l_suppkey & 255 AS g, CAST(l_quantity AS BIGINT) & 255 AS b, CASE l_returnflag WHEN 'R' THEN 128 WHEN 'A' THEN 64 ELSE 255 END AS a FROM lineitem)"""


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, argb): LINES_SQL in Spark."""
    low = lambda c: F.col(c).cast("long").bitwiseAND(F.lit(255))
    a = F.when(F.col("l_returnflag") == "R", 128).when(F.col("l_returnflag") == "A", 64).otherwise(255)
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("img"), (F.col("l_linenumber") - 1).cast("int").alias("x"), F.pmod("l_orderkey", F.lit(8)).cast("int").alias("y"), argb.pack(a, low("l_partkey"), low("l_suppkey"), low("l_quantity")).alias("argb"))


#: Animation frames from events: an animation for each user, frames in the order of time.
FRAMES_SQL = """fr AS (SELECT user_id AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx,
  CAST(2 * (event_id % 13) AS BIGINT) AS x, CAST(2 * (event_id % 7) AS BIGINT) AS y, CAST(1 + event_id % 31 AS BIGINT) AS width, CAST(1 + event_id % 17 AS BIGINT) AS height,
  CAST(10 + event_id % 990 AS BIGINT) AS duration_ms, CASE WHEN event_type = 'click' THEN 'overwrite' ELSE 'blend' END AS blend,
  CASE WHEN event_id % 5 = 0 THEN 'background' ELSE 'keep' END AS dispose, event_type AS payload FROM events)"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FRAMES_SQL in Spark; payload is binary."""
    from pyspark.sql import Window

    n = F.col("event_id")
    size = lambda k, f=1, d=0: (d + f * F.pmod(n, F.lit(k))).cast("long")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), (F.row_number().over(order) - 1).alias("frame_idx"), size(13, 2).alias("x"), size(7, 2).alias("y"), size(31, 1, 1).alias("width"), size(17, 1, 1).alias("height"), size(990, 1, 10).alias("duration_ms"),
        F.when(F.col("event_type") == "click", "overwrite").otherwise("blend").alias("blend"), F.when(F.pmod(n, F.lit(5)) == 0, "background").otherwise("keep").alias("dispose"), F.col("event_type").cast("binary").alias("payload"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for each page, with VP8X, a lossless header and the page's text as image, and its address as EXIF."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    w, h, alpha = F.pmod("page_id", F.lit(500)) + 1, F.pmod("page_id", F.lit(300)) + 1, F.pmod("page_id", F.lit(2)) == 1
    # One step at a time: a chunk's payload is named several times in it, and would be computed each time.
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), text("url").alias("exif"), F.concat(riff.vp8l_header(w, h, alpha), text("html")).alias("image"), riff.vp8x(F.lit(riff.EXIF) + F.when(alpha, riff.ALPHA).otherwise(0), w, h).alias("head"))
    body = F.concat(riff.chunk("VP8X", F.col("head")), riff.chunk("VP8L", F.col("image")), riff.chunk("EXIF", F.col("exif")))
    return pages.select("path", body.alias("body")).select("path", riff.envelope(F.col("body")).alias("content"))


PAGES_SQL = """pg AS (SELECT page_id AS path, page_id % 500 + 1 AS w, page_id % 300 + 1 AS h, page_id % 2 = 1 AS alpha,
  CAST(strlen(coalesce(html, '')) AS BIGINT) + 5 AS image, CAST(strlen(coalesce(url, '')) AS BIGINT) AS exif FROM pages),
ck AS (SELECT path, 0 AS idx, 'VP8X' AS fourcc, CAST(20 AS BIGINT) AS payload_start, CAST(10 AS BIGINT) AS size FROM pg
  UNION ALL SELECT path, 1, 'VP8L', 38, image FROM pg
  UNION ALL SELECT path, 2, 'EXIF', 46 + image + image % 2, exif FROM pg)"""
