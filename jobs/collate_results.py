"""Comparison table of labelled text: metrics of each scene and method, totals, ranks, as the benchmark table has them.

    python -m jobs.collate_results --config jobs/collate_results.json --items DIR --labels DIR --output DIR

Items are texts with an id and the columns that name their scene and method (with the defaults: the source and the
language); labels say of some of them whether they are good and whether they are bad. The metrics have the keys,
units and directions of the comparison table:

* ``Acc``, the error of what is there: the share of bad ones among the labelled items;
* ``Comp``, the error of what is missing: the share of items without a text of their own, blank or a copy of the
  text of an item with a lesser id (of equal ids, that of the lesser scene and method);
* ``C-L1``: the mean of the two;
* ``NC``: the share of good ones among the labelled items;
* ``F-score``: harmonic mean of the share of items with their own text and of ``NC``.

A cell without labels lacks ``Acc``, ``C-L1``, ``NC`` and ``F-score``; averages over scenes count what is missing
as 0, or leave it out if ``strict``. Two tables are written under ``--output``, each partitioned by method:
``cells`` with the counts behind the metrics and ``table`` with a row for each metric of each scene, and of the
total, its value in the table's unit and the method's rank in the scene. Both are replaced whole, and hold the same
after another run over the same input.

Texts are hashed where they are read and counted by hash and cell before anything is shuffled, so a text, scene or
method that a third of all items share costs one row a task. Labels are reduced to one row an item (bad if any row
says so, good if all that say something do) and joined by id.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lumenfold import scratch
from lumenfold.operators import metrics

UNNAMED = "unnamed"


@dataclass(frozen=True)
class Config:
    """SQL expressions over the items for id, text, scene and method, and over the labels for id, good and bad."""

    format: str = "parquet"
    output_format: str = "parquet"
    item: str = "doc_id"
    text: str = "text"
    scene: str = "source"
    method: str = "lang"
    label_item: str = "doc_id"
    good: str = "quality = 1"
    bad: str = "toxic = 1"
    strict: bool = False

    def __post_init__(self):
        if self.output_format not in ("parquet", "orc", "json"):
            raise ValueError("output_format must be parquet, orc or json")


def named(expression: str):
    """A name that may be a partition: blank and missing ones have a name too."""
    value = F.trim(F.expr(expression).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(UNNAMED)).otherwise(value)


def labels_by_item(labels: DataFrame, cfg: Config) -> DataFrame:
    """``item, good, bad``: one row for each labelled item."""
    rows = labels.select(F.expr(cfg.label_item).alias("item"), F.expr(cfg.good).alias("good"), F.expr(cfg.bad).alias("bad"))
    rows = rows.where("item is not null and (good is not null or bad is not null)")
    return rows.groupBy("item").agg(F.coalesce(F.bool_and("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad"))


def cell_counts(items: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """``scene, method, items, own, labelled, good, bad``."""
    rows = items.select(F.expr(cfg.item).alias("item"), named(cfg.scene).alias("scene"), named(cfg.method).alias("method"), F.expr(cfg.text).cast("string").alias("text"))
    # Two passes over the items; only the first reads texts.
    spoken = rows.where(F.trim("text") != "").select("item", "scene", "method", F.unhex(F.sha2("text", 256)).alias("h"))
    copies = spoken.groupBy("h", "scene", "method").agg(F.min(F.struct(F.col("item").isNull().alias("none"), "item")).alias("least"))
    first = copies.groupBy("h").agg(F.min(F.struct("least", "scene", "method")).alias("first"))
    own = first.groupBy(F.col("first.scene").alias("scene"), F.col("first.method").alias("method")).agg(F.count(F.lit(1)).alias("own"))
    judged = rows.select("item", "scene", "method").join(labels_by_item(labels, cfg), "item", "left")
    counts = judged.groupBy("scene", "method").agg(
        F.count(F.lit(1)).alias("items"), F.count("good").alias("labelled"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad"),
    )
    out = counts.join(own, ["scene", "method"], "left")
    return out.select("scene", "method", "items", F.coalesce("own", F.lit(0)).cast("long").alias("own"), "labelled", "good", "bad")


def cell_metrics(cells: DataFrame) -> DataFrame:
    """``scene, method, metric, value``: what a metric file would hold; none of a cell that lacks it."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    wide = cells.select("scene", "method", share("bad", "labelled").alias("Acc"), (1 - share("own", "items")).alias("Comp"), share("good", "labelled").alias("NC"))
    present = 1 - F.col("Comp")
    wide = wide.withColumn("C-L1", (F.col("Acc") + F.col("Comp")) / 2).withColumn(
        "F-score", F.when(present + F.col("NC") > 0, 2 * present * F.col("NC") / (present + F.col("NC"))).when(F.col("NC").isNotNull(), 0.0)
    )
    return wide.unpivot(["scene", "method"], [d[0] for d in metrics.DESCRIPTORS], "metric", "value").where("value is not null")


def comparison(values: DataFrame, strict: bool) -> DataFrame:
    """``scene, method, metric, value, shown, rank, is_total``."""
    # To twelve decimals, so that the order in which an average was summed decides no rank.
    every = metrics.macro_average(values, strict).where("value is not null").withColumn("value", F.round("value", 12))
    # A scene may have the total's name: they are ranked apart.
    parts = [metrics.rank_methods(every.where(flag)) for flag in (~F.col("is_total"), F.col("is_total"))]
    return parts[0].unionByName(parts[1]).select("scene", "method", "metric", "value", "shown", "rank", "is_total")


def run(spark: SparkSession, items: str, labels: str, out: str, cfg: Config = Config()) -> dict:
    """Collate the items and write both tables; returns the number of rows of each."""
    read = lambda path: spark.read.format(cfg.format).load(path)
    write = lambda df, name: df.write.mode("overwrite").partitionBy("method").format(cfg.output_format).save(f"{out}/{name}")
    log.info("reading items of %s and labels of %s", items, labels)
    # Scenes x methods: small from here on, and read four times.
    cells = scratch.table(cell_counts(read(items), read(labels), cfg), "cells")
    write(cells, "cells")
    table = comparison(cell_metrics(cells), cfg.strict).coalesce(1)
    write(table, "table")
    sums = cells.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "own", "labelled")), F.count(F.lit(1)).alias("cells")).first().asDict()
    sums["rows"] = result(spark, out, cfg).count()
    log.info("read %(items)d items, %(own)d with a text of their own, %(labelled)d labelled; wrote %(cells)d cells and %(rows)d rows of the table", sums)
    return sums


TABLE = "scene string, method string, metric string, value double, shown double, rank int, is_total boolean"


def result(spark: SparkSession, out: str, cfg: Config = Config()) -> DataFrame:
    """The comparison table as written."""
    return spark.read.format(cfg.output_format).schema(TABLE).load(f"{out}/table")


PATHS = {"items": "texts", "labels": "labels of some of them", "output": "folder of the tables"}

if __name__ == "__main__":
    sys.exit(command("Comparison table of labelled text.", Config, PATHS, run))
