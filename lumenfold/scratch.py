"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sides of a join up to this many rows may be broadcast; beyond it the grid or shuffle form runs.
BROADCAST_ROWS = 500_000


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master may leave it unset and gets a fresh folder; elsewhere each
    executor would write to a disk of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lumenfold_tables", None)
    if not path:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark._lumenfold_tables = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
    return path.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path for files of one run."""
    return f"{root(spark)}/lumenfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once and read back: lineage ends here and survives the loss of executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast hint for an aggregate of a single row."""
    return F.broadcast(df)
