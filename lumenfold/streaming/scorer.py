"""Incremental frame scoring, an extension: motion and running motion as frames arrive, and a clip's totals at its end.

State is one row per video (the last signal, the sums so far and the timer). Selection needs a clip's total, so it
runs in ``foreachBatch`` over what has been scored, or in batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "video long, event string, frame_idx long, i long, sharpness double, motion double, cum_motion double, late long"
STATE = "signal double, n long, cum double, last long, late long, seen long"
FRAME, END = "frame", "end"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Start streams of ``score_stream`` inside: their state needs the store on disk. The setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class ClipScorer(StatefulProcessor):
    """Scores the frames of one video; with ``idle_ms`` a timer ends the clip and drops its state."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        held = self.clip.get()
        signal, n, cum, last, late, seen = held if held is not None else (None, 0, 0.0, None, 0, None)
        new = pd.concat(list(rows)).sort_values("frame_idx", kind="stable")
        idx = new["frame_idx"].to_numpy()
        # A frame counts if it is after all before it: the first of its index, and after the last one scored.
        fresh = np.r_[True, idx[1:] != idx[:-1]] & (True if last is None else idx > last)
        late += int((~fresh).sum())
        latest = int(new["at_ms"].max())
        new = new[fresh]
        if len(new):
            value = new["signal"].to_numpy(float)
            motion = np.abs(np.diff(value, prepend=value[0] if signal is None else signal))
            total = np.cumsum(np.r_[cum, motion])[1:]
            yield pd.DataFrame({
                "video": key[0], "event": FRAME, "frame_idx": new["frame_idx"].to_numpy(), "i": np.arange(n, n + len(new)),
                "sharpness": new["sharpness"].to_numpy(float), "motion": motion, "cum_motion": total, "late": late,
            })
            signal, n, cum, last = float(value[-1]), n + len(new), float(total[-1]), int(new["frame_idx"].iloc[-1])
        if self.idle_ms is not None:
            if seen is not None:
                self.handle.deleteTimer(seen + self.idle_ms)
            latest = max(latest, timerValues.getCurrentWatermarkInMs() - self.idle_ms, latest if seen is None else seen)
            self.handle.registerTimer(latest + self.idle_ms)
        self.clip.update((signal, n, cum, last, late, latest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        _, n, cum, last, late, _ = self.clip.get()
        self.clip.clear()
        yield pd.DataFrame([(key[0], END, last, n, None, None, cum, late)], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"sharpness": float, "motion": float})

    def close(self) -> None:
        pass


def score_stream(frames: DataFrame, time_col: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """``frames`` has ``video, frame_idx, sharpness, signal``; frames of a batch are put in order. A frame that is not
    after all those before it is not scored but counted: ``late`` is their number so far. Rows without a video
    or an index are left out; a missing signal or sharpness counts as 0.

    With ``time_col`` (an event time with a watermark) and ``idle_ms``, a clip of which nothing came until the watermark
    passed its latest frame by ``idle_ms`` ends: an ``end`` row tells its last index, its number of frames (``i``), their
    motion and the late ones, and its state goes. Frames that come later begin a new clip; those older
    than the watermark are dropped by Spark, which counts them in the query's progress."""
    if (time_col is None) != (idle_ms is None):
        raise ValueError("time_col and idle_ms go together")
    at = F.lit(0).cast("long") if time_col is None else F.unix_millis(F.col(time_col))
    src = frames.where("video is not null and frame_idx is not null").select(
        F.col("video").cast("long").alias("video"), F.col("frame_idx").cast("long").alias("frame_idx"),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("sharpness", "signal")),
        F.coalesce(at, F.lit(0)).alias("at_ms"), *([time_col] if time_col else []),
    )
    mode = "None" if time_col is None else "EventTime"
    return src.groupBy("video").transformWithStateInPandas(ClipScorer(idle_ms), OUT, "append", mode)
