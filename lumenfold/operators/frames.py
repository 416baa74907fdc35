"""Frame scoring and keyframe selection over (video, time)-ordered rows.

Rows are ``video, frame_idx, sharpness`` and a scalar ``signal`` or a given ``motion``. All windows are
partitioned by video, so clips are independent and a clip's frames bound the work of a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IngestConfig:
    target_frames: int = 60
    sample_stride: int = 1
    blur_rel_threshold: float = 0.6
    proc_width: int = 320
    thumb_width: int = 256
    jpeg_quality: int = 92


STATIC = 1e-6  # total motion up to which a clip has no motion to spread frames over

# The four labels.
REASON_SELECTED = "keyframe"
REASON_BLUR_SELECTED = "keyframe (sharpest in window, still soft)"
REASON_BLUR = "dropped: below sharpness threshold"
REASON_REDUNDANT = "dropped: redundant (low parallax)"


def stride_sample(frames: DataFrame, stride: int) -> DataFrame:
    return frames if stride <= 1 else frames.where(F.col("frame_idx") % stride == 0)


def frame_stats(frames: DataFrame, fps: float = 30.0, stride: int = 1) -> DataFrame:
    """Add ``i`` (rank in the clip), ``time_s``, ``motion`` against the previous sampled frame (0 at first)
    and ``cum_motion``."""
    w = W.partitionBy("video").orderBy("frame_idx")
    out = stride_sample(frames, stride)
    if "motion" not in frames.columns:
        out = out.withColumn("motion", F.coalesce(F.abs(F.col("signal") - F.lag("signal").over(w)), F.lit(0.0)))
    return (
        out.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("time_s", F.col("frame_idx") / F.lit(float(fps)))
        .withColumn("cum_motion", F.sum("motion").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )


def clip_totals(stats: DataFrame, cfg: IngestConfig) -> DataFrame:
    t = F.greatest(F.lit(1), F.least(F.lit(cfg.target_frames), F.count(F.lit(1)))).cast("long")
    # The last cumulated motion: a sum of its own might be added in another order and differ from it in its last bits.
    out = stats.groupBy("video").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("cum_motion", "i").alias("total"), F.median("sharpness").alias("median_sharpness"), t.alias("target")
    )
    return out.withColumn("blur_threshold", F.col("median_sharpness") * F.lit(float(cfg.blur_rel_threshold)))


def selected_indices(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct ``video, i`` of the keyframes.

    A clip with motion is cut into slots of equal motion; each takes the sharpest frame (the first of
    equals) near the frame where its centre falls. A clip that stands still, or that has no more
    frames than wanted, takes evenly spaced frames.
    """
    spread = totals.where((F.col("total") > STATIC) & (F.col("target") < F.col("n")))
    slots = spread.select(
        "video", "n", "target",
        (F.col("total") / F.col("target")).alias("step"),
        F.greatest(F.lit(1).cast("long"), F.floor(F.lit(0.5) * F.col("n") / F.col("target")).cast("long")).alias("half"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("target") - 1)).alias("k"),
    ).withColumn("centre_motion", (F.col("k") + F.lit(0.5)) * F.col("step"))
    # Frames before a slot's centre: one sorted union per clip instead of a join of slots with frames.
    marks = stats.select("video", F.col("cum_motion").alias("m"), F.lit(1).alias("frame"), F.lit(None).cast("long").alias("k"))
    marks = marks.unionByName(slots.select("video", F.col("centre_motion").alias("m"), F.lit(0).alias("frame"), "k"))
    order = W.partitionBy("video").orderBy("m", "frame").rowsBetween(W.unboundedPreceding, 0)
    centres = marks.withColumn("before", F.sum("frame").over(order)).where("frame = 0").select("video", "k", "before")
    around = (
        slots.join(centres, ["video", "k"])
        .withColumn("centre", F.least(F.col("before"), F.col("n") - 1))
        .select(
            "video", "k",
            F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("centre") - F.col("half")), F.least(F.col("n") - 1, F.col("centre") + F.col("half")))).alias("i"),
        )
    )
    best = (
        around.join(stats.select("video", "i", "sharpness"), ["video", "i"])
        .groupBy("video", "k")
        .agg(F.max(F.struct(F.col("sharpness"), (-F.col("i")).alias("neg"))).alias("b"))
        .select("video", (-F.col("b.neg")).alias("i"))
    )
    still = totals.where((F.col("total") <= STATIC) | (F.col("target") >= F.col("n")))
    return best.unionByName(even_indices(still)).distinct()


def even_indices(totals: DataFrame) -> DataFrame:
    """``video, i`` of ``target`` evenly spaced ranks of ``n``, truncated; the last is n - 1."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("target") - 1)).alias("k")
    rows = totals.select("video", "n", "target", k)
    step = (F.col("n") - 1).cast("double") / F.greatest(F.lit(1), F.col("target") - 1).cast("double")
    i = (
        F.when(F.col("target") == 1, F.lit(0).cast("long"))
        .when(F.col("k") == F.col("target") - 1, F.col("n") - 1)
        .otherwise(F.floor(F.col("k") * step).cast("long"))
    )
    return rows.select("video", i.alias("i"))


def label_frames(stats: DataFrame, totals: DataFrame, selected: DataFrame) -> DataFrame:
    """Add ``selected`` and ``reason``. Blur labels a frame; it never keeps one from selection."""
    blurry = F.col("sharpness") < F.col("blur_threshold")
    chosen = F.col("chosen").isNotNull()
    reason = (
        F.when(chosen & blurry, REASON_BLUR_SELECTED).when(chosen, REASON_SELECTED).when(blurry, REASON_BLUR).otherwise(REASON_REDUNDANT)
    )
    return (
        stats.join(totals.select("video", "blur_threshold"), "video")
        .join(selected.withColumn("chosen", F.lit(True)), ["video", "i"], "left")
        .withColumn("selected", chosen)
        .withColumn("reason", reason)
        .drop("chosen")
    )


def select_keyframes(frames: DataFrame, cfg: IngestConfig = IngestConfig(), fps: float = 30.0) -> DataFrame:
    stats = frame_stats(frames, fps, cfg.sample_stride)
    totals = clip_totals(stats, cfg)
    return label_frames(stats, totals, selected_indices(stats, totals))


def ingest_summary(labelled: DataFrame) -> DataFrame:
    """One row per video."""
    blur, redundant = F.col("reason").contains("sharpness"), F.col("reason").contains("redundant")
    return labelled.groupBy("video").agg(
        F.count(F.lit(1)).alias("analysed_frames"),
        F.count_if("selected").alias("selected_frames"),
        F.count_if(~F.col("selected") & blur).alias("dropped_blur"),
        F.count_if(~F.col("selected") & redundant).alias("dropped_redundant"),
        F.median("sharpness").alias("median_sharpness"),
        F.max("blur_threshold").alias("blur_threshold"),
        F.sum("motion").alias("total_motion"),
    )


def keyframe_sources(labelled: DataFrame) -> DataFrame:
    """``video, ordinal, frame_idx`` of the selected frames in order."""
    w = W.partitionBy("video").orderBy("frame_idx")
    return labelled.where("selected").select("video", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "frame_idx")


def take_selected(frames: DataFrame, selected: DataFrame, *keys: str) -> DataFrame:
    """Full rows of the selected frames only: the second pass over a clip reads no other frame."""
    return frames.join(selected.select(*(keys or ("video", "frame_idx"))).distinct(), list(keys or ("video", "frame_idx")), "left_semi")
