"""The driver's tables in the engine's roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video per user, its frames in time order; sharpness and signal are the event's value."""
    # Renamed before the window, so that later windows by video find the rows already dealt by it.
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "ts", "event_id", "value")
    i = F.row_number().over(W.partitionBy("video").orderBy("ts", "event_id")) - 1
    return e.select("video", i.cast("long").alias("frame_idx"), F.col("value").alias("sharpness"), F.col("value").alias("signal"))


FRAMES_SQL = """
SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
       value AS sharpness, value AS signal FROM events
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from embeddings: place, colour in 0 to 1, unit normal, label."""
    d = [F.col("embedding")[k].cast("double") for k in range(12)]
    n = F.sqrt(d[6] * d[6] + d[7] * d[7] + d[8] * d[8])
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pid"), *(d[k].alias(c) for k, c in enumerate("xyz")),
        *(((d[3 + k] + 1) / 2).alias(c) for k, c in enumerate("rgb")),
        *((d[6 + k] / n).alias(f"n{c}") for k, c in enumerate("xyz")),
        *(d[9 + k].alias(f"s{k}") for k in range(3)), "label",
    )


_D = [f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(12)]
_N = f"sqrt({_D[6]} * {_D[6]} + {_D[7]} * {_D[7]} + {_D[8]} * {_D[8]})"
POINTS_SQL = (
    "SELECT vec_id AS pid, "
    + ", ".join(f"{_D[k]} AS {c}" for k, c in enumerate("xyz")) + ", "
    + ", ".join(f"({_D[3 + k]} + 1) / 2 AS {c}" for k, c in enumerate("rgb")) + ", "
    + ", ".join(f"{_D[6 + k]} / {_N} AS n{c}" for k, c in enumerate("xyz")) + ", "
    + ", ".join(f"{_D[9 + k]} AS s{k}" for k in range(3)) + ", label FROM embeddings"
)


def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("label % 2 = 0")


def donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("label % 2 = 1")


PARTS_SQL = f"p AS ({POINTS_SQL}), bb AS (SELECT * FROM p WHERE label % 2 = 0), dn AS (SELECT * FROM p WHERE label % 2 = 1)"
DIST = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def dist_sql(a: str, b: str) -> str:
    return DIST.format(a=a, b=b)
