"""The stream scorer over growing files: totals at a clip's end, late frames, state that goes."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.streaming import scorer

SCHEMA = "video long, frame_idx long, sharpness double, signal double, ts timestamp"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def run(spark, base, rows):
    """One run over what is there now with ``rows`` added; all that was written so far."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    frames = spark.readStream.schema(SCHEMA).parquet(f"{base}/in").withWatermark("ts", "2 hours")
    before = spark.conf.get(scorer.PROVIDER, None)
    with scorer.state_store(spark):
        scorer.score_stream(frames, "ts", 3_600_000).writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    assert spark.conf.get(scorer.PROVIDER, None) == before
    out = spark.read.parquet(f"{base}/out").orderBy("video", "event", "frame_idx").collect()
    return [(r.video, r.event, r.frame_idx, r.i, r.motion, r.cum_motion, r.late) for r in out]


def test_clips_end_and_late_frames_are_told(spark):
    base = scratch.folder(spark, f"stream-{uuid.uuid4().hex}")
    first = run(spark, base, [(1, 0, 1.0, 5.0, at(0)), (1, 2, None, 7.0, at(0.5)), (2, 0, 1.0, 1.0, at(9)), (2, 5, 1.0, 4.0, at(9.5)), (None, 0, 1.0, 1.0, at(9)), (3, None, 1.0, 1.0, at(9))])
    # The newest is at 9.5, so the watermark is 7.5: video 1, idle since 0.5, is over and video 2 isn't.
    assert first == [(1, "end", 2, 2, None, 2.0, 0), (1, "frame", 0, 0, 0.0, 0.0, 0), (1, "frame", 2, 1, 2.0, 2.0, 0), (2, "frame", 0, 0, 0.0, 0.0, 0), (2, "frame", 5, 1, 3.0, 3.0, 0)]
    # Two frames of video 2 are late (3, and 5 again), 6 isn't; video 1 begins anew; one row is older than the watermark.
    second = run(spark, base, [(2, 3, 1.0, 9.0, at(9.2)), (2, 5, 1.0, 9.0, at(9.6)), (2, 6, 1.0, 6.0, at(9.7)), (1, 1, 1.0, 3.0, at(10)), (4, 0, 1.0, 1.0, at(1)), (5, 0, 1.0, 1.0, at(30))])
    new = [r for r in second if r not in first]
    assert new == [(1, "end", 1, 1, None, 0.0, 0), (1, "frame", 1, 0, 0.0, 0.0, 0), (2, "end", 6, 3, None, 5.0, 2), (2, "frame", 6, 2, 2.0, 5.0, 2), (5, "frame", 0, 0, 0.0, 0.0, 0)]
    # Only the clip still open, 5, holds state.
    assert scorer_rows(spark, base) == [5]


def scorer_rows(spark, base):
    state = spark.read.format("statestore").option("path", f"{base}/ck").option("stateVarName", "clip").load()
    return sorted(r[0] for r in state.select(F.col("key.video")).collect())


def test_time_and_idle_go_together(spark):
    with pytest.raises(ValueError):
        scorer.score_stream(spark.createDataFrame([], SCHEMA), idle_ms=5)
