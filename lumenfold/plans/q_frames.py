"""Frame queries: scoring, keyframes, summary, fallback, pose join, stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators import frames as fr

from .tables import FRAMES_SQL, read
from .tables import frames as clip

CFG = fr.IngestConfig(target_frames=12)


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.frame_stats(clip(spark, sf_dir))
    return s.select("video", "i", F.round("time_s", 6).alias("time_s"), F.round("motion", 6).alias("motion"), F.round("cum_motion", 4).alias("cum_motion"))


_SCORED = f"""
f AS ({FRAMES_SQL}),
s AS (
  SELECT video, frame_idx AS i, sharpness, signal, frame_idx / CAST(30 AS DOUBLE) AS time_s,
         coalesce(abs(signal - lag(signal) OVER (PARTITION BY video ORDER BY frame_idx)), CAST(0 AS DOUBLE)) AS motion FROM f
)"""
_STATS = f"""{_SCORED},
c AS (SELECT *, sum(motion) OVER (PARTITION BY video ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum_motion FROM s)
"""

# Motion added frame by frame, as the selection does. A window's sum is added in an order of the engine's own, and where
# a slot's centre is just a frame's cumulated motion, the last bit of the sums decides. Blocks of a clip's frames are
# taken one after the other, each from the sum of those before. For WITH RECURSIVE.
_BLOCK = 64
_SUMS = "list_reduce({}, lambda sums, x: sums || [sums[-1] + x[1]])"
_ORDERED = f"""{_SCORED},
b AS MATERIALIZED (SELECT video, i // {_BLOCK} AS block, list([motion] ORDER BY i) AS motions FROM s GROUP BY video, block),
run AS (
  SELECT video, block, {_SUMS.format("motions")} AS sums FROM b WHERE block = 0
  UNION ALL
  SELECT b.video, b.block, {_SUMS.format("[[run.sums[-1]]] || b.motions")}[2:] FROM run JOIN b ON b.video = run.video AND b.block = run.block + 1
),
c AS (SELECT s.*, run.sums[s.i % {_BLOCK} + 1] AS cum_motion FROM s JOIN run ON run.video = s.video AND run.block = s.i // {_BLOCK})
"""
_ORDERED_TOTAL = "sum(motion ORDER BY i)"

FRAME_STATS_SQL = f"""
WITH {_STATS}
SELECT video, i, round(time_s, 6) AS time_s, round(motion, 6) AS motion, round(cum_motion, 4) AS cum_motion FROM c
"""


def _selection_sql(target: int, total: str = "sum(motion)") -> str:
    return f"""
t AS (
  SELECT video, count(*) AS n, {total} AS total, median(sharpness) AS med, greatest(1, least({target}, count(*))) AS target
  FROM c GROUP BY video
),
k AS (
  SELECT video, n, total, target, unnest(range(0, target)) AS k FROM t WHERE total > 0.000001 AND target < n
),
m AS (
  SELECT k.*, (k + CAST(0.5 AS DOUBLE)) * (total / target) AS tm,
         greatest(1, CAST(floor(CAST(0.5 AS DOUBLE) * n / target) AS BIGINT)) AS half FROM k
),
ctr AS (
  SELECT m.video, m.k, m.n, m.half, least(count(CASE WHEN c.cum_motion < m.tm THEN 1 END), m.n - 1) AS ctr
  FROM m JOIN c ON c.video = m.video GROUP BY m.video, m.k, m.n, m.half
),
win AS (
  SELECT ctr.video, ctr.k, c.i, row_number() OVER (PARTITION BY ctr.video, ctr.k ORDER BY c.sharpness DESC, c.i) AS rn
  FROM ctr JOIN c ON c.video = ctr.video AND c.i BETWEEN ctr.ctr - ctr.half AND ctr.ctr + ctr.half
),
ev AS (
  SELECT video, n, target, unnest(range(0, target)) AS k FROM t WHERE total <= 0.000001 OR target >= n
),
chosen AS (
  SELECT DISTINCT video, i FROM win WHERE rn = 1
  UNION
  SELECT video, CASE WHEN target = 1 THEN 0 WHEN k = target - 1 THEN n - 1
         ELSE CAST(floor(k * (CAST(n - 1 AS DOUBLE) / CAST(greatest(1, target - 1) AS DOUBLE))) AS BIGINT) END AS i FROM ev
),
lab AS (
  SELECT c.*, t.med * CAST(0.6 AS DOUBLE) AS bar, t.med AS med, ch.i IS NOT NULL AS selected,
    CASE WHEN ch.i IS NOT NULL AND c.sharpness < t.med * CAST(0.6 AS DOUBLE) THEN '{fr.REASON_BLUR_SELECTED}'
         WHEN ch.i IS NOT NULL THEN '{fr.REASON_SELECTED}'
         WHEN c.sharpness < t.med * CAST(0.6 AS DOUBLE) THEN '{fr.REASON_BLUR}'
         ELSE '{fr.REASON_REDUNDANT}' END AS reason
  FROM c JOIN t ON c.video = t.video LEFT JOIN chosen ch ON ch.video = c.video AND ch.i = c.i
)
"""


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.select_keyframes(clip(spark, sf_dir), CFG).select("video", "i", "selected", "reason")


KEYFRAMES_SQL = f"WITH RECURSIVE {_ORDERED}, {_selection_sql(12, _ORDERED_TOTAL)} SELECT video, i, selected, reason FROM lab"


def keyframes_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.select_keyframes(clip(spark, sf_dir), fr.IngestConfig()).where("selected").select("video", "i")


KEYFRAMES_DEFAULT_SQL = f"WITH RECURSIVE {_ORDERED}, {_selection_sql(60, _ORDERED_TOTAL)} SELECT video, i FROM lab WHERE selected"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.ingest_summary(fr.select_keyframes(clip(spark, sf_dir), CFG))
    return s.select(
        "video", "analysed_frames", "selected_frames", "dropped_blur", "dropped_redundant",
        *(F.round(c, 4).alias(c) for c in ("median_sharpness", "blur_threshold", "total_motion")),
    )


SUMMARY_SQL = f"""
WITH RECURSIVE {_ORDERED}, {_selection_sql(12, _ORDERED_TOTAL)}
SELECT video, count(*) AS analysed_frames, count(CASE WHEN selected THEN 1 END) AS selected_frames,
       count(CASE WHEN NOT selected AND reason LIKE '%sharpness%' THEN 1 END) AS dropped_blur,
       count(CASE WHEN NOT selected AND reason LIKE '%redundant%' THEN 1 END) AS dropped_redundant,
       round(max(med), 4) AS median_sharpness, round(max(bar), 4) AS blur_threshold, round(sum(motion), 4) AS total_motion
FROM lab GROUP BY video
"""


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third clip stands still; it gets evenly spaced frames."""
    still = clip(spark, sf_dir).withColumn("signal", F.when(F.col("video") % 3 == 0, 1.0).otherwise(F.col("signal")))
    return fr.select_keyframes(still, CFG).where("selected").select("video", "i", "reason")


FALLBACK_SQL = f"""
WITH RECURSIVE {_ORDERED.replace("value AS signal FROM", "CASE WHEN user_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE value END AS signal FROM")}, {_selection_sql(12, _ORDERED_TOTAL)}
SELECT video, i, reason FROM lab WHERE selected
"""


def pose_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th keyframe of a clip meets the k-th order of the customer of that number, if it is there and
    not pending; priorities stand for images, with a fallback for the first keyframe's."""
    k = fr.keyframe_sources(fr.select_keyframes(clip(spark, sf_dir), CFG))
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    o = o.withColumnRenamed("o_custkey", "video")
    first = F.first_value("o_orderpriority", True).over(W.partitionBy("video").orderBy("ordinal"))
    joined = k.join(o.where("o_orderstatus <> 'P'"), ["video", "ordinal"], "left")
    return joined.select(
        "video", "ordinal", "frame_idx", F.col("o_orderkey").alias("pose_key"), F.coalesce("o_orderpriority", first, F.lit("none")).alias("image"), F.col("o_orderkey").isNotNull().alias("has_pose")
    )


POSE_JOIN_SQL = f"""
WITH RECURSIVE {_ORDERED}, {_selection_sql(12, _ORDERED_TOTAL)},
kf AS (SELECT video, i AS frame_idx, row_number() OVER (PARTITION BY video ORDER BY i) - 1 AS ordinal FROM lab WHERE selected),
o AS (SELECT o_custkey AS video, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal,
             o_orderkey, o_orderstatus, o_orderpriority FROM orders),
j AS (SELECT kf.video, kf.ordinal, kf.frame_idx, o.o_orderkey, o.o_orderpriority
      FROM kf LEFT JOIN (SELECT * FROM o WHERE o_orderstatus <> 'P') o ON o.video = kf.video AND o.ordinal = kf.ordinal)
SELECT video, ordinal, frame_idx, o_orderkey AS pose_key,
       coalesce(o_orderpriority, first_value(o_orderpriority IGNORE NULLS) OVER (PARTITION BY video ORDER BY ordinal), 'none') AS image,
       o_orderkey IS NOT NULL AS has_pose
FROM j
"""


def _stream(spark: SparkSession, base: str, scored: DataFrame) -> DataFrame:
    """A stream run until nothing new is left, and all it wrote."""
    from lumenfold.streaming import scorer

    with scorer.state_store(spark):
        q = (
            scored.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").option("path", f"{base}/out")
            .outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental scorer over the same frames, run to its end and read back."""
    from lumenfold import scratch
    from lumenfold.streaming.scorer import score_stream

    base = scratch.folder(spark, "stream")
    rows = clip(spark, sf_dir)
    rows.write.parquet(f"{base}/in")
    out = _stream(spark, base, score_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in")))
    return out.select("video", "i", F.round("motion", 6).alias("motion"), F.round("cum_motion", 4).alias("cum_motion"))


STREAM_SQL = f"WITH {_STATS} SELECT video, i, round(motion, 6) AS motion, round(cum_motion, 4) AS cum_motion FROM c"


IDLE, DELAY = 6, 24  # hours


def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that ended in a stream of two runs. Every fifth event of the last day but one comes in the second,
    with what is newer: those of clips that went on meanwhile are late. A clip ends six hours after its last frame."""
    from lumenfold import scratch
    from lumenfold.streaming.scorer import score_stream

    base = scratch.folder(spark, "ends")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame_idx"), F.col("value").alias("sharpness"), F.col("value").alias("signal"), F.col("ts").cast("timestamp").alias("ts"))
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    kept = F.col("ts") <= F.col("newest") - F.expr("interval 24 hours")
    held_back = (F.col("ts") > F.col("newest") - F.expr("interval 48 hours")) & (F.col("frame_idx") % 5 == 0)
    dealt = scratch.table(e.crossJoin(newest).withColumn("second", ~kept | held_back).drop("newest"), "dealt")
    for second in (False, True):
        dealt.where(F.col("second") == second).drop("second").write.mode("append").parquet(f"{base}/in")
        frames_in = spark.readStream.schema(dealt.drop("second").schema).parquet(f"{base}/in").withWatermark("ts", f"{DELAY} hours")
        out = _stream(spark, base, score_stream(frames_in, "ts", IDLE * 3_600_000))
    return out.where("event = 'end'").select("video", "frame_idx", F.col("i").alias("n_frames"), F.round("cum_motion", 4).alias("motion"), F.col("late").alias("n_late"))


STREAM_ENDS_SQL = f"""
WITH t AS (SELECT user_id AS video, event_id AS frame_idx, value, ts, max(ts) OVER () AS newest FROM events),
d AS (SELECT *, ts > newest - INTERVAL 24 HOUR OR (ts > newest - INTERVAL 48 HOUR AND frame_idx % 5 = 0) AS second FROM t),
f AS (SELECT video, max(ts) + INTERVAL {IDLE} HOUR < (SELECT max(ts) FROM d WHERE NOT second) - INTERVAL {DELAY} HOUR AS over FROM d WHERE NOT second GROUP BY video),
c AS (SELECT d.*, coalesce(f.over, FALSE) AND second AS anew, coalesce(f.over, FALSE) AND NOT second AS over FROM d LEFT JOIN f USING (video)),
l AS (SELECT *, coalesce(second AND frame_idx < max(CASE WHEN NOT second THEN frame_idx END) OVER (PARTITION BY video, anew), FALSE) AS late FROM c),
m AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY video, anew ORDER BY frame_idx)) AS motion FROM l WHERE NOT late),
s AS (SELECT video, anew, max(frame_idx) AS frame_idx, count(*) AS n_frames, round(coalesce(sum(motion), 0), 4) AS motion FROM m GROUP BY video, anew),
a AS (SELECT video, anew, bool_or(over) AS over, max(ts) AS last, max(newest) AS newest, count(*) FILTER (WHERE late) AS n_late FROM l GROUP BY video, anew)
SELECT s.video, s.frame_idx, s.n_frames, s.motion, a.n_late FROM s JOIN a USING (video, anew)
WHERE a.over OR a.last + INTERVAL {IDLE} HOUR < a.newest - INTERVAL {DELAY} HOUR
"""


QUERIES = {
    "q01_frame_stats": frame_stats,
    "q02_keyframe_selection": keyframes,
    "q02b_keyframe_selection_60": keyframes_default,
    "q03_ingest_summary": summary,
    "q04_keyframe_fallback": fallback,
    "q29_pose_join": pose_join,
    "q32_stream_frame_stats": stream_stats,
    "q78_stream_clip_ends": stream_ends,
}
ORACLE_SQL = {
    "q01_frame_stats": FRAME_STATS_SQL,
    "q02_keyframe_selection": KEYFRAMES_SQL,
    "q02b_keyframe_selection_60": KEYFRAMES_DEFAULT_SQL,
    "q03_ingest_summary": SUMMARY_SQL,
    "q04_keyframe_fallback": FALLBACK_SQL,
    "q29_pose_join": POSE_JOIN_SQL,
    "q32_stream_frame_stats": STREAM_SQL,
    "q78_stream_clip_ends": STREAM_ENDS_SQL,
}
