"""Queries over image files: frames read by range, depth, keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.operators import image
from lumenfold.sources import files, pictures

from .q_parts import _PX, PIXEL_SQL, _pictures
from .tables import read

D = "CAST({} AS DOUBLE)".format


def _put_frames(spark: SparkSession, sf_dir: str) -> str:
    """Image files of grey frames of 8 x 8, a folder for each clip."""
    sized = _pictures(spark, sf_dir, 64).withColumns({"height": F.lit(8), "width": F.lit(8), "channels": F.lit(1)})
    at = scratch.folder(spark, "frames")
    files.write_many(pictures.encode_frames(sized, F.format_string("clip%d/frame_%06d.png", "video", "frame_idx")), at)
    return at


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness and motion of frames read from image files: as those of the same frames in a table."""
    scored = image.with_motion(image.score_frames(pictures.frame_files(spark, _put_frames(spark, sf_dir)), proc_width=4))
    return scored.select("video", "frame_idx", F.round(F.col("sharpness") * 4096, 0).alias("sharpness"), F.round("motion", 6).alias("motion"))


def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame from the fourth on of some clips: the filters leave the other files unread."""
    frames = pictures.frame_files(spark, _put_frames(spark, sf_dir), 3).where("frame_idx >= 4 and frame_idx < 30 and video in (1, 3, 7)")
    return frames.select("video", "frame_idx", F.hex("pixels").alias("pixels"), "height", "width")


_HEX = "list_aggregate(list_transform(px, lambda v: printf('%02X', CAST(v AS BIGINT))), 'string_agg', '')"
FRAME_RANGE_SQL = f"""
WITH x AS ({_PX}) SELECT CAST(video AS BIGINT) AS video, frame_idx, {_HEX} AS pixels, 8 AS height, 8 AS width FROM x
WHERE frame_idx % 3 = 0 AND frame_idx >= 4 AND frame_idx < 30 AND video IN (1, 3, 7)
"""


def keyframe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes and thumbnails of half the width, written and read again: every fifth frame of each clip."""
    at = scratch.folder(spark, "keyframes")
    frames = pictures.frame_files(spark, _put_frames(spark, sf_dir))
    pictures.write_keyframes(frames, frames.where("frame_idx % 5 = 0"), at, 4)
    with files.listing(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path", "content")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    size = F.conv(F.hex(F.substring("content", 17, 8)), 16, 10)  # width and height, four bytes each
    back = pictures.frame_files(spark, at).groupBy("video").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("pixels")).alias("bytes"))
    listed = found.select(F.regexp_extract(part(-2), r"(\d+)", 1).cast("long").alias("video"), part(-1).alias("name"), size.alias("size"))
    return listed.join(back, "video").select("video", "name", (F.col("size").cast("long") / F.lit(4294967296)).cast("long").alias("width"), "frames", "bytes")


KEYFRAME_FILE_SQL = f"""
WITH x AS ({_PX}), k AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS k FROM x WHERE frame_idx % 5 = 0),
n AS (SELECT video, count(*) AS frames, count(*) * 64 AS bytes FROM k GROUP BY video),
f AS (SELECT video, 'frame_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.png' AS name, 8 AS width FROM k UNION ALL SELECT video, 'thumb_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.png', 4 FROM k)
SELECT CAST(f.video AS BIGINT) AS video, name, CAST(width AS BIGINT) AS width, frames, CAST(bytes AS BIGINT) AS bytes FROM f JOIN n USING (video)
"""


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth in metres from 16-bit files of 8 x 8, brought to 6 x 5; some files are missing and some are no images."""
    e = read(spark, sf_dir, "embeddings").where("vec_id % 7 <> 3")
    metres = e.select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 2000) / 1000).alias("depth"), F.lit(8).alias("width"))
    name = F.format_string("depth_%06d.png", "vec_id")
    good = pictures.depth_documents(metres.where("vec_id % 11 <> 5"), name)
    bad = metres.where("vec_id % 11 = 5").select(name.alias("name"), F.lit("no image").cast("binary").alias("content"))
    at = scratch.folder(spark, "depth")
    files.write_many(good.unionByName(bad), at)
    found = pictures.depth_files(spark, at, 6, 5)
    vec = F.regexp_extract("path", r"depth_(\d+)", 1).cast("long").alias("vec_id")
    return found.select(vec, "height", "width", F.posexplode("depth").alias("k", "metres")).select("vec_id", "height", "width", F.col("k").cast("long").alias("k"), F.round("metres", 3).alias("metres"))


DEPTH_SQL = f"""
SELECT vec_id, 6 AS height, 5 AS width, CAST(k AS BIGINT) AS k, round(floor((CAST(embedding[(k // 5 * 8 // 6) * 8 + k % 5 * 8 // 5 + 1] AS DOUBLE) + 1) * 2000) / {D(1000)}, 3) AS metres
FROM embeddings, (SELECT unnest(range(30)) AS k) WHERE vec_id % 7 <> 3 AND vec_id % 11 <> 5
"""

QUERIES = {"q73_frame_file_scores": frame_scores, "q73b_frame_file_range": frame_range, "q74_keyframe_files": keyframe_files, "q75_depth_files": depth}
ORACLE_SQL = {"q73_frame_file_scores": PIXEL_SQL, "q73b_frame_file_range": FRAME_RANGE_SQL, "q74_keyframe_files": KEYFRAME_FILE_SQL, "q75_depth_files": DEPTH_SQL}
