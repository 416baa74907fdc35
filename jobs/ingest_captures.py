"""Incremental ingest of captures: frames as they arrive, keyframes and reports of the clips they belong to.

    python -m jobs.ingest_captures --config jobs/ingest_captures.json --input DIR --output DIR --checkpoint DIR

New files of frame rows under ``--input`` are taken by a file stream that ends when all of them are read; the
stream's checkpoint holds which files those are. A clip's keyframes depend on all of its frames, so a batch goes
through three tables under ``--output``:

* ``frames`` (by batch, shard): the batch's valid rows. Its folder is overwritten, so a batch that is run again
  after a failure leaves what it would have left the first time. A shard is a fixed share of the clips.
* ``rejects`` (by batch): rows without a clip, frame, time or score, or whose score is not a number, with the reason.
* ``keyframes`` and ``clips`` (by shard): every frame with its label, and one report a clip. The shards that the
  batch touched are computed anew from ``frames`` up to this batch and replaced by dynamic partition overwrite;
  no other shard is read or written.

The same frame (clip and frame number) may come again: the row of the latest batch counts, in one batch that with
the latest time, then the highest score. So does a frame that arrives late: its clip is selected anew. Running
again without new files changes nothing. A shard should hold what one batch may recompute, some gigabytes; a clip
is sorted in one task.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs.common import command, log
from lumenfold.operators import frames as fr

COLUMNS = ("video", "frame", "time", "sharpness", "signal")
FRAMES = "video long, frame long, time timestamp_ntz, sharpness double, signal double"
LABELLED = f"{FRAMES}, i long, motion double, blur_threshold double, selected boolean, reason string"


@dataclass(frozen=True)
class Config:
    """``columns`` gives an SQL expression over the input rows for each of ``COLUMNS``."""

    format: str = "parquet"
    schema: str = "event_id long, ts timestamp_ntz, user_id long, value double"
    columns: dict = field(default_factory=lambda: {"video": "user_id", "frame": "event_id", "time": "ts", "sharpness": "value", "signal": "value"})
    shards: int = 16
    files_per_batch: int = 1000
    target_frames: int = 12
    sample_stride: int = 1
    blur_rel_threshold: float = 0.6
    fps: float = 30.0

    def __post_init__(self):
        if sorted(self.columns) != sorted(COLUMNS):
            raise ValueError(f"columns must name {', '.join(COLUMNS)}")
        if min(self.shards, self.files_per_batch, self.target_frames, self.sample_stride) < 1 or self.fps <= 0:
            raise ValueError("shards, files_per_batch, target_frames, sample_stride and fps must be positive")

    @property
    def selection(self) -> fr.IngestConfig:
        return fr.IngestConfig(target_frames=self.target_frames, sample_stride=self.sample_stride, blur_rel_threshold=self.blur_rel_threshold)


def parsed(rows: DataFrame, cfg: Config) -> DataFrame:
    """The columns of ``FRAMES`` and ``reject``: why a row can't be used, else null."""
    kinds = dict(c.split(" ") for c in FRAMES.split(", "))
    out = rows.select(*(F.expr(cfg.columns[c]).cast(kinds[c]).alias(c) for c in COLUMNS))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    reason = F.when(F.col("video").isNull(), "no clip").when(F.col("frame").isNull(), "no frame number").when(F.col("time").isNull(), "no time")
    return out.withColumn("reject", reason.when(bad("sharpness") | bad("signal"), "no score"))


def shard_of(video: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(video), F.lit(shards)).cast("int")


def label(stored: DataFrame, cfg: Config) -> DataFrame:
    """``LABELLED`` and ``shard`` of the clips in ``stored`` (rows of ``FRAMES`` with ``shard`` and ``batch``)."""
    # The latest delivery of each frame, by windows over the clip: they and the selection need one shuffle by clip.
    latest = W.partitionBy("video").orderBy("frame", F.desc("batch"), F.desc("time"), F.desc("sharpness"), F.desc("signal"))
    frames = stored.withColumn("before", F.lag("frame").over(latest)).where("before is null or before <> frame")
    at = F.row_number().over(W.partitionBy("video").orderBy("time", "frame")) - 1
    frames = frames.select(*COLUMNS, "shard", at.cast("long").alias("frame_idx"))
    labelled = fr.select_keyframes(frames, cfg.selection, cfg.fps)
    return labelled.select(*(c.split(" ")[0] for c in LABELLED.split(", ")), "shard")


def stored_frames(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{FRAMES}, batch long, shard int").parquet(f"{out}/frames")


def ingest_batch(rows: DataFrame, batch: int, out: str, cfg: Config) -> dict:
    """Store the rows of a batch and bring the shards of their clips up to date."""
    spark = rows.sparkSession
    rows = parsed(rows, cfg)
    kept = rows.where("reject is null").drop("reject").withColumn("shard", shard_of(F.col("video"), cfg.shards))
    # Dealt by shard for few files; adaptive execution splits the shard of a hot clip.
    kept.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/frames/batch={batch}")
    rows.where("reject is not null").write.mode("overwrite").parquet(f"{out}/rejects/batch={batch}")
    counts = {r["reject"]: r["n"] for r in spark.read.schema(f"{FRAMES}, reject string").parquet(f"{out}/rejects/batch={batch}").groupBy("reject").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = stored_frames(spark, out).where(F.col("batch") <= batch)
    mine = held.where(F.col("batch") == batch).groupBy("shard").count().collect()  # at most ``shards`` rows
    report = {"batch": batch, "frames": sum(r["count"] for r in mine), "rejected": counts, "shards": len(mine)}
    if mine:
        touched = sorted(r["shard"] for r in mine)
        label(held.where(F.col("shard").isin(touched)), cfg).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{out}/keyframes")
        labelled = spark.read.schema(f"{LABELLED}, shard int").parquet(f"{out}/keyframes").where(F.col("shard").isin(touched))
        clips = fr.ingest_summary(labelled).withColumn("shard", shard_of(F.col("video"), cfg.shards))
        clips.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{out}/clips")
    log.info("batch %d: stored %d frames, rejected %s, brought %d shards up to date", batch, report["frames"], counts or "none", len(mine))
    return report


def run(spark: SparkSession, source: str, out: str, checkpoint: str, cfg: Config = Config()) -> dict:
    """Take what is new under ``source`` and return what was done."""
    reports: list[dict] = []
    stream = spark.readStream.format(cfg.format).schema(cfg.schema).option("maxFilesPerTrigger", cfg.files_per_batch).load(source)
    log.info("reading new files of %s", source)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: reports.append(ingest_batch(rows, batch, out, cfg)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    total = {
        "batches": len(reports), "frames": sum(r["frames"] for r in reports), "rejected": sum(sum(r["rejected"].values()) for r in reports),
        "shards": sum(r["shards"] for r in reports),
    }
    log.info("read %d frames and rejected %d in %d batches of %s; wrote %d shards under %s", total["frames"], total["rejected"], total["batches"], source, total["shards"], out)
    return total


def result(spark: SparkSession, out: str) -> DataFrame:
    """All of the output: every frame with its label and its clip's report."""
    clips = spark.read.parquet(f"{out}/clips").drop("shard", "blur_threshold")
    return spark.read.parquet(f"{out}/keyframes").drop("shard").join(clips, "video")


PATHS = {"input": "folder of frame rows, or a pattern of folders or files", "output": "folder of the tables", "checkpoint": "folder of the stream's state"}

if __name__ == "__main__":
    sys.exit(command("Incremental ingest of captures.", Config, PATHS, run))
