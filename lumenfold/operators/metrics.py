"""Reconstruction metrics and their collation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold import scratch

from . import nn, quantiles

# Key, display name, factor to the displayed unit, whether more is better.
DESCRIPTORS = (
    ("Acc", "Acc", 100.0, False),
    ("Comp", "Comp", 100.0, False),
    ("C-L1", "Chamfer-L1", 100.0, False),
    ("NC", "Normal-C", 1.0, True),
    ("F-score", "F-score", 1.0, True),
)
TOTAL = "AVG"


def descriptors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DESCRIPTORS)], "pos int, metric string, display string, scale double, higher boolean")


def macro_average(metrics: DataFrame, strict: bool = False) -> DataFrame:
    """Long ``scene, method, metric, value`` with the rows of the pseudo-scene ``AVG`` appended and flagged
    by ``is_total``. A method's average runs over the scenes it has; a missing metric counts as 0
    unless ``strict``."""
    spark = metrics.sparkSession
    cells = metrics.select("scene", "method").distinct()
    grid = cells.join(F.broadcast(descriptors(spark).select("metric")), F.lit(True))
    filled = grid.join(metrics, ["scene", "method", "metric"], "left")
    value = F.col("value") if strict else F.coalesce("value", F.lit(0.0))
    avg = filled.groupBy("method", "metric").agg(F.avg(value).alias("value")).withColumn("scene", F.lit(TOTAL))
    return metrics.select("scene", "method", "metric", "value").withColumn("is_total", F.lit(False)).unionByName(avg.withColumn("is_total", F.lit(True)))


def in_display_units(metrics: DataFrame) -> DataFrame:
    d = F.broadcast(descriptors(metrics.sparkSession))
    return metrics.join(d, "metric").withColumn("shown", F.col("value") * F.col("scale"))


def rank_methods(metrics: DataFrame) -> DataFrame:
    """Rank of each method in its scene and metric on unrounded values, the first name on ties."""
    rows = in_display_units(metrics)
    key = F.when(F.col("higher"), -F.col("value")).otherwise(F.col("value"))
    w = W.partitionBy("scene", "metric").orderBy(key.asc_nulls_last(), "method")
    return rows.withColumn("rank", F.row_number().over(w))


def surface_metrics(pred: DataFrame, truth: DataFrame, tau: float = 0.05, normals: bool = False, strategy: str = "auto") -> DataFrame:
    """Accuracy, completion, Chamfer distance, precision, recall, F-score and, with ``normals``
    (``nx, ny, nz``), normal consistency: the mean absolute cosine of nearest normals, both ways."""

    def one_way(a: DataFrame, b: DataFrame, dist: str, share: str, cos: str) -> DataFrame:
        near = nn.nearest(a, b, strategy)
        aggs = [F.avg("dist").alias(dist), F.avg((F.col("dist") < tau).cast("int")).alias(share)]
        if normals:
            na = a.select(F.col("pid").alias("qid"), *(F.col(f"n{c}").alias(f"q{c}") for c in "xyz"))
            nb = b.select("pid", *(F.col(f"n{c}").alias(f"p{c}") for c in "xyz"))
            near = near.join(na, "qid").join(nb, "pid")
            aggs.append(F.avg(F.abs(sum((F.col(f"q{c}") * F.col(f"p{c}") for c in "yz"), F.col("qx") * F.col("px")))).alias(cos))
        return near.agg(*aggs)

    both = one_way(pred, truth, "accuracy", "precision", "nc_pred").join(
        F.broadcast(one_way(truth, pred, "completion", "recall", "nc_truth")), F.lit(True)
    )
    p, r = F.col("precision"), F.col("recall")
    out = both.withColumn("chamfer_l1", (F.col("accuracy") + F.col("completion")) / 2).withColumn(
        "f_score", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    )
    return out.withColumn("normal_consistency", (F.col("nc_pred") + F.col("nc_truth")) / 2) if normals else out


def error_summary(dist: DataFrame, column: str = "dist") -> DataFrame:
    """Median, mean and 90th percentile in centimetres."""
    dist = scratch.table(dist.select(column), "errors")
    both = dist.agg(F.avg(column).alias("mean")).join(F.broadcast(quantiles.row(dist, q=(column, [0.5, 0.9]))), F.lit(True))
    return both.select((F.col("q")[0] * 100).alias("median_cm"), (F.col("mean") * 100).alias("mean_cm"), (F.col("q")[1] * 100).alias("p90_cm"))


def observed_share(dist: DataFrame, margin: float, column: str = "dist") -> DataFrame:
    """How many vertices are within ``margin`` of an observation, how many are not, and the share in percent."""
    near = F.col(column) <= margin
    return dist.agg(F.count_if(near).alias("observed"), F.count_if(~near).alias("unobserved"), (100 * F.avg(near.cast("int"))).alias("observed_pct"))


def collate_table(metrics: DataFrame) -> list[dict]:
    """Rows of the comparison table in print order: scenes by name, then the total; methods by name.
    A table of scenes x methods, so small enough for the driver."""
    wide = (
        metrics.groupBy("scene", "method", "is_total")
        .pivot("metric", [d[0] for d in DESCRIPTORS])
        .agg(F.first("value"))
        .orderBy("is_total", "scene", "method")
    )
    return [r.asDict() for r in wide.collect()]


def markdown(rows: list[dict]) -> str:
    from lumenfold.functions.names import fixed

    head = ["Scene", "Method", *(f"{name} {'↑' if higher else '↓'}" for _, name, _, higher in DESCRIPTORS)]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows:
        cells = [fixed(None if r.get(k) is None else r[k] * s, 2 if s != 1.0 else 3) for k, _, s, _ in DESCRIPTORS]
        lines.append("| " + " | ".join([r["scene"], r["method"], *cells]) + " |")
    return "\n".join(lines)
